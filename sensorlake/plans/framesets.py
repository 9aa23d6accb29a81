"""Registered multisensor frame sets: what all cameras see of one master image, with LiDAR layers and soil cover."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions import color
from sensorlake.functions import geometry as gm
from sensorlake.operators import asof, fit, neighbourhood as nb, rasterize as rz
from sensorlake.operators.ordered import _null_safe
from sensorlake.operators.pointfilters import MIN_RANGE_M, in_range, projected
from sensorlake.session import cut_lineage

# Points nearer to the image plane than this are behind the
# camera; rows that a trimmed crop keeps at least; sizes of the opening and the
# closing of the vegetation mask.
MIN_DEPTH_M = 0.05
MIN_TRIMMED_ROWS = 32
VEGETATION_OPEN, VEGETATION_CLOSE = 5, 7

BOX = ("x0", "y0", "x1", "y1")


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def synchronise(master: DataFrame, messages: DataFrame, keys: Sequence[str], cameras: Sequence[str], tolerance_ns: int, cloud: str = "cloud") -> DataFrame:
    """Per master frame the number of the nearest frame of every camera and of the nearest cloud, NULL beyond the tolerance.

    ``master`` has ``keys, frame, ts_ns, seq``; ``messages`` has ``keys, st,
    frame, ts_ns, seq`` with the stream's name in ``st``.  ``synced`` says
    whether all cameras were found; the cloud may be missing.
    """
    streams = [*cameras, cloud]
    got = asof.nearest_per_stream(master, messages, keys, dict.fromkeys(streams, tolerance_ns), "st", ["frame"])
    found = [F.col(f"{s}.frame").isNotNull() for s in cameras]
    every = found[0]
    for f in found[1:]:
        every = every & f
    return got.select(*keys, "frame", "ts_ns", *[F.col(f"{s}.frame").alias(s) for s in streams], every.alias("synced"))


def registered_cells(sync: DataFrame, master_pixels: DataFrame, pixels: Mapping[str, DataFrame], keys: Sequence[str], homographies: Mapping[str, Sequence[float]]) -> DataFrame:
    """Every master pixel with the value of each camera warped onto it, NULL where the camera does not see it.

    ``master_pixels`` has ``keys, frame, r, c`` and any value columns;
    ``pixels[s]`` has ``keys, frame, r, c, v`` in the camera's own frame
    numbers.  All layers meet in one aggregate.
    """
    ids = [*keys, "frame"]
    sets = sync.where("synced")
    values = [c for c in master_pixels.columns if c not in (*ids, "r", "c")]
    grid = _null_safe(master_pixels, sets.select(*ids), ids, "left_semi")
    layers = grid
    for s, px in pixels.items():
        own = _null_safe(px.withColumnRenamed("frame", s), sets.select(*ids, s), [*keys, s], "inner")
        seen = nb.warp(own.select(*ids, "r", "c", F.col("v").cast("double").alias("v")), grid, ids, gm.h_inverse_of(homographies[s]), "v").where("valid")
        layers = layers.unionByName(seen.select(*ids, "r", "c", F.col("v").alias(s)), allowMissingColumns=True)
    return layers.groupBy(*ids, "r", "c").agg(*[F.max(v).alias(v) for v in (*values, *pixels)])


def safe_crops(sync: DataFrame, cells: DataFrame, keys: Sequence[str], layers: Sequence[str], margin: int, trim_bottom: int, min_width: int, min_height: int) -> DataFrame:
    """Largest rectangle without a hole inside the eroded common mask, one row per master frame with its ``status``.

    A cell counts if no layer is NULL there; the mask loses ``margin`` cells at
    every hole (not at the image border).  ``trim_bottom`` rows are cut from the
    box, but at least 32 (or all it has) stay.  The box is half-open and kept
    even when it is too small.
    """
    ids = [*keys, "frame"]
    whole = F.lit(1)
    for v in layers:
        whole = F.when(F.col(v).isNotNull(), whole).otherwise(0)
    mask = cells.select(*ids, "r", "c", whole.alias("ok"))
    if margin > 0:
        mask = nb.erode(mask, ids, "ok", 2 * margin + 1)
    box = nb.largest_rectangle(mask.where("ok = 1"), ids).drop("area")
    if trim_bottom > 0:
        box = box.withColumn("y1", F.least(F.col("y1"), F.greatest(F.col("y0") + MIN_TRIMMED_ROWS, F.col("y1") - trim_bottom)))
    d = _null_safe(sync, box, ids, "left")
    small = (F.col("x1") - F.col("x0") < min_width) | (F.col("y1") - F.col("y0") < min_height)
    status = F.when(~F.col("synced"), "no_sync").when(F.col("x0").isNull(), "no_common_intersection").when(small, "common_intersection_too_small").otherwise("ok")
    return d.withColumn("status", status)


def lidar_layers(crops: DataFrame, points: DataFrame, keys: Sequence[str], tie: Sequence[str], lens: Sequence[float], dist: Sequence[float], rotation: Sequence[float], shift: Sequence[float], max_range: float, splat: int, cloud: str = "cloud") -> DataFrame:
    """``depth_mm, height, intensity`` of the set's cloud at the pixels of its crop.

    ``points`` has ``keys, frame`` (number of the cloud), ``x, y, z,
    intensity`` and the ``tie`` columns.  The nearest point of a pixel wins,
    the first to arrive on a tie; height is measured against the ground plane of
    the points inside the crop, against negative z.  Each layer then grows to
    its maximum over ``splat`` x ``splat`` pixels (odd; 1: not at all).
    """
    ids = [*keys, "frame"]
    own = in_range(points, MIN_RANGE_M["rgb_master"], max_range).withColumnRenamed("frame", cloud)
    d = _null_safe(own, crops.select(*ids, cloud, *BOX), [*keys, cloud], "inner")
    cx, cy, cz = gm.rigid_apply(_array(rotation), _array(shift), [F.col(v) for v in "xyz"])
    d = d.select(*ids, *BOX, *tie, "x", "y", (-F.col("z")).alias("up"), "intensity", cx.alias("_cx"), cy.alias("_cy"), F.when(cz > MIN_DEPTH_M, cz).alias("_cz"))
    d = projected(d, F.col("_cx"), F.col("_cy"), F.col("_cz"), lens, dist, "_u", "_v").withColumn("depth_mm", F.col("_cz") * 1000.0).drop("_cx", "_cy", "_cz")
    d = d.where((F.col("_u") >= F.col("x0")) & (F.col("_u") < F.col("x1")) & (F.col("_v") >= F.col("y0")) & (F.col("_v") < F.col("y1")))
    c, r = F.col("x0") + F.bround(F.col("_u") - F.col("x0")).cast("int"), F.col("y0") + F.bround(F.col("_v") - F.col("y0")).cast("int")
    d = d.withColumn("c", c).withColumn("r", r).where((F.col("c") < F.col("x1")) & (F.col("r") < F.col("y1"))).drop("_u", "_v", *BOX)
    d = fit.ground_height(d, ids, "x", "y", "up")
    layers = ["depth_mm", "height", "intensity"]
    near = rz.zbuffer(d, [*ids, "r", "c"], "depth_mm", tie, layers[1:])
    return nb.splat(near, ids, layers, splat) if splat > 1 else near


def vegetation(cells: DataFrame, keys: Sequence[str], red: str = "red", green: str = "green", blue: str = "blue") -> DataFrame:
    """``veg`` (0 or 1) per cell: leaf index above its Otsu cut and a green hue, opened, then closed."""
    rgb = [F.col(v) for v in (red, green, blue)]
    d = cells.select(*keys, "r", "c", color.gli_u8(*rgb).alias("_gli"), color.is_green(color.hsv(*rgb)).alias("_green"))
    d = _null_safe(d, rz.otsu(d, keys, "_gli"), keys, "inner")
    d = cut_lineage(d.select(*keys, "r", "c", ((F.col("_gli") > F.col("threshold")) & F.col("_green")).cast("int").alias("veg")))
    return nb.closed(nb.opened(d, keys, "veg", VEGETATION_OPEN), keys, "veg", VEGETATION_CLOSE)


def multisensor_frame_sets(
    master: DataFrame, messages: DataFrame, master_pixels: DataFrame, pixels: Mapping[str, DataFrame], points: DataFrame, keys: Sequence[str], homographies: Mapping[str, Sequence[float]], tolerance_ns: int,
    tie: Sequence[str], lens: Sequence[float], dist: Sequence[float], rotation: Sequence[float], shift: Sequence[float], margin: int, trim_bottom: int = 0, min_width: int = 1, min_height: int = 1, splat: int = 3, max_range: float = 8.0,
) -> dict[str, DataFrame]:
    """Nearest-stamp sync, warp, safe crop, LiDAR layers and soil cover of every master frame.

    ``sets`` has one row per master frame with the numbers of the frames used,
    the box, ``status`` and, where it is ``ok``, the vegetation and soil share
    in percent.  ``cells`` has every pixel of the crops with the master's
    columns, one column per camera (none of them NULL), the LiDAR layers (NULL
    where no point fell) and ``veg``.  Rows without a key take no part; the
    master pixels need ``red, green, blue``.
    """
    ids = [*keys, "frame"]
    for k in keys:
        master = master.where(F.col(k).isNotNull())
    sync = cut_lineage(synchronise(master, messages, keys, list(pixels), tolerance_ns))
    wide = cut_lineage(registered_cells(sync, master_pixels, pixels, keys, homographies))
    values = [c for c in wide.columns if c not in (*ids, "r", "c")]
    sets = cut_lineage(safe_crops(sync, wide, keys, values, margin, trim_bottom, min_width, min_height))
    good = sets.where("status = 'ok'")
    inside = (F.col("c") >= F.col("x0")) & (F.col("c") < F.col("x1")) & (F.col("r") >= F.col("y0")) & (F.col("r") < F.col("y1"))
    cells = cut_lineage(wide.join(good.select(*ids, *BOX), ids).where(inside).drop(*BOX))
    veg = cut_lineage(vegetation(cells, ids))
    lidar = lidar_layers(good, points, keys, tie, lens, dist, rotation, shift, max_range, splat)
    at = [*ids, "r", "c"]
    cells = cells.join(veg.hint("merge"), at).join(lidar.hint("merge"), at, "left")
    share = rz.cover(veg, ids, {"vegetation_cover_pct": F.col("veg") == 1, "soil_visible_pct": F.col("veg") == 0})
    return {"sets": _null_safe(sets, share, ids, "left"), "cells": cells.select(*at, *values, "depth_mm", "height", "intensity", "veg")}
