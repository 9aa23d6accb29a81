"""Frame-level choices on boxes and masks: guide boxes, unions, common valid boxes, coverage, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.geometry import box, box_area, box_iou, clip_box


def union_boxes(df: DataFrame, keys: Sequence[str], b: str, width: int, height: int) -> DataFrame:
    """Hull of the non-NULL boxes per key inside the image; NULL if empty."""
    g = df.where(F.col(b).isNotNull()).groupBy(*keys).agg(F.min(f"{b}.x0").alias("a"), F.min(f"{b}.y0").alias("c"), F.max(f"{b}.x1").alias("e"), F.max(f"{b}.y1").alias("f"))
    u = box(F.greatest(F.col("a"), F.lit(0.0)), F.greatest(F.col("c"), F.lit(0.0)), F.least(F.col("e"), F.lit(width - 1.0)), F.least(F.col("f"), F.lit(height - 1.0)))
    return g.select(*keys, F.when((u["x1"] > u["x0"]) & (u["y1"] > u["y0"]), u).alias("box"))


# An old thermal box counts only below this share of the frame;
# a checker box replaces the guide only up to this multiple of its area.
OLD_BOX_MAX_SHARE = 0.75
CHECKER_BOX_MAX_RATIO = 1.15


def guide_boxes(labels: DataFrame, projected: DataFrame, own: DataFrame, keys: Sequence[str], width: int, height: int, own_max_share: float | None = None) -> DataFrame:
    """Projected box if there is one, else the sensor's own box, else the whole frame; clipped, with its origin."""
    p = projected.select(*keys, F.col("box").alias("_p"))
    o = own.select(*keys, F.col("box").alias("_o"))
    d = labels.join(p, list(keys), "left").join(o, list(keys), "left")
    mine = F.col("_o") if own_max_share is None else F.when(box_area(F.col("_o")) < own_max_share * width * height, F.col("_o"))
    frame = box(0.0, 0.0, width - 1.0, height - 1.0)
    src = F.when(F.col("_p").isNotNull(), "projected").when(mine.isNotNull(), "panel").otherwise("frame")
    return d.select(*labels.columns, src.alias("src"), clip_box(F.coalesce(F.col("_p"), mine, frame), width, height).alias("guide"))


def accept_checker_box(guide: Column, panel: Column) -> Column:
    """Panel box when it is not much larger than the guide, else the guide."""
    return F.when(panel.isNotNull() & (guide.isNull() | (box_area(panel) <= CHECKER_BOX_MAX_RATIO * box_area(guide))), panel).otherwise(guide)


def common_valid_box(masks: DataFrame, keys: Sequence[str], sensor: str, n_sensors: int, margin: int = 0, shave_bottom: int = 0, r: str = "r", c: str = "c") -> DataFrame:
    """Box (half-open) of the cells valid in all ``n_sensors`` masks, reduced by a margin; NULL if empty."""
    cells = masks.groupBy(*keys, r, c).agg(F.count_distinct(sensor).alias("_n")).where(F.col("_n") == n_sensors)
    g = cells.groupBy(*keys).agg(
        (F.min(c) + margin).alias("x0"), (F.min(r) + margin).alias("y0"), (F.max(c) + 1 - margin).alias("x1"), (F.max(r) + 1 - margin - shave_bottom).alias("y1"), F.count(F.lit(1)).alias("cells")
    )
    ok = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    return g.select(*keys, *[F.when(ok, F.col(v)).alias(v) for v in ("x0", "y0", "x1", "y1")], "cells")


def coverage(crops: DataFrame, keys: Sequence[str], width: int, height: int, min_w: int, min_h: int) -> DataFrame:
    """Crop width, height, area, share of the frame and a status per frame."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    d = crops.withColumn("w", F.coalesce(w, F.lit(0))).withColumn("h", F.coalesce(h, F.lit(0)))
    status = F.when(F.col("w") * F.col("h") == 0, "no_valid_intersection").when((F.col("w") < min_w) | (F.col("h") < min_h), "crop_too_small").otherwise("ok")
    return d.select(*keys, "w", "h", (F.col("w") * F.col("h")).alias("area"), (F.col("w") * F.col("h") / float(width * height)).alias("fraction"), status.alias("status"))


def valid_fraction(masks: DataFrame, frame: str, sensor: str, sensors: Sequence[str], frame_cells: int, r: str = "r", c: str = "c") -> DataFrame:
    """Share of valid cells per sensor (``masks`` holds valid cells) and of cells valid in all of them."""
    per = masks.groupBy(frame).pivot(sensor, list(sensors)).agg(F.count(F.lit(1)))
    both = masks.groupBy(frame, r, c).agg(F.count_distinct(sensor).alias("_n")).where(F.col("_n") == len(sensors)).groupBy(frame).agg(F.count(F.lit(1)).alias("_all"))
    d = per.join(both, frame, "left")
    share = lambda col: F.coalesce(F.col(col), F.lit(0)) / F.lit(float(frame_cells))
    return d.select(frame, *[share(s).alias(s) for s in sensors], share("_all").alias("common"))


# Weights, gates and pads of the two component scores.
GUIDED_WEIGHTS = {"iou": 4.0, "fill": 1.2, "area": 0.8, "centre": 0.8, "size": 0.5, "aspect": 1.0}
GUIDED_ASPECT = (0.55, 4.0)
CONTRAST_GATES = {"area": 80, "width": 25, "height": 18, "aspect": (0.7, 4.5)}
CONTRAST_SIDE, CONTRAST_CENTRE = 15.0, 0.8


def component_score(df: DataFrame, guide: Column, roi_area: float) -> DataFrame:
    """Score connected components (``x0, y0, x1, y1, area``) against the guide box within a region of ``roi_area`` pixels.

    Overlap, fill and size raise it; distance from the guide's centre, a
    differing width or height and an unusual shape lower it.
    """
    k = GUIDED_WEIGHTS
    one = F.lit(1.0)
    d = df.withColumn("_b", box(F.col("x0") * 1.0, F.col("y0") * 1.0, F.col("x1") * 1.0, F.col("y1") * 1.0)).withColumn("_g", guide)
    w, h = F.greatest(F.col("x1") - F.col("x0"), one), F.greatest(F.col("y1") - F.col("y0"), one)
    gw, gh = F.greatest(F.col("_g.x1") - F.col("_g.x0"), one), F.greatest(F.col("_g.y1") - F.col("_g.y0"), one)
    dx = (F.col("x0") + F.col("x1")) * 0.5 - (F.col("_g.x0") + F.col("_g.x1")) * 0.5
    dy = (F.col("y0") + F.col("y1")) * 0.5 - (F.col("_g.y0") + F.col("_g.y1")) * 0.5
    off = F.sqrt(dx * dx + dy * dy) / F.greatest(F.sqrt(gw * gw + gh * gh), one)
    size = F.abs(F.log(F.greatest(w / gw, F.lit(0.1)))) + F.abs(F.log(F.greatest(h / gh, F.lit(0.1))))
    odd = F.when((w / h).between(*GUIDED_ASPECT), 0.0).otherwise(k["aspect"])
    gain = k["iou"] * box_iou(F.col("_b"), F.col("_g")) + k["fill"] * F.least(F.col("area") / (w * h), one) + k["area"] * F.least(F.col("area") / F.lit(max(1.0, float(roi_area))), one)
    return d.withColumn("score", gain - k["centre"] * off - k["size"] * size - odd).drop("_b", "_g")


def contrast_component_score(df: DataFrame, projected: Column | None = None) -> DataFrame:
    """Components that pass the size gates, scored by area and short side, less the distance from the projected box's centre."""
    g = CONTRAST_GATES
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    d = df.where((F.col("area") >= g["area"]) & (w >= g["width"]) & (h >= g["height"]) & (w / F.greatest(h, F.lit(1))).between(*g["aspect"]))
    score = F.col("area") + CONTRAST_SIDE * F.least(w, h)
    if projected is None:
        return d.withColumn("score", score)
    d = d.withColumn("_g", projected)
    dx = (F.col("x0") + w * 0.5) - (F.col("_g.x0") + F.col("_g.x1")) * 0.5
    dy = (F.col("y0") + h * 0.5) - (F.col("_g.y0") + F.col("_g.y1")) * 0.5
    return d.withColumn("score", F.when(F.col("_g").isNull(), score).otherwise(score - CONTRAST_CENTRE * F.sqrt(dx * dx + dy * dy))).drop("_g")
