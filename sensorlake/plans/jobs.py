"""End-to-end jobs composed of the operators.

Inputs are tables; outputs are DataFrames (or a dict of them) for the writers
in ``sinks``.  Nothing here collects; tables that are small and used more than
once are written to the checkpoint folder.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions import color
from sensorlake.functions import geometry as gm
from sensorlake.functions import labels as lb
from sensorlake.operators import asof, fit, frames, merging, neighbourhood as nb
from sensorlake.operators import pairing, rasterize as rz, ranking, robust, sampling, spatial, trajectory
from sensorlake.operators.ordered import _null_safe, previous_row, running_index
from sensorlake.operators.pointfilters import computed, projected
from sensorlake.operators.quantiles import attach_quantiles, exact_quantiles
from sensorlake.session import cut_lineage
from sensorlake.sources import recordings


def _one(df: DataFrame) -> Column:
    return df.select(F.struct(*df.columns)).scalar()


def georeference(odometry: DataFrame, fixes: DataFrame, keys: Sequence[str], tolerance_ns: int, rigid: bool = False) -> dict[str, DataFrame]:
    """Align a local track to UTM: ``pairs``, ``alignment`` (one row per recording), ``poses`` and ``residuals``.

    ``odometry`` has ``ts_ns, seq, x, y``; ``fixes`` has ``ts_ns, seq, lat,
    lon``.  The zone comes from each recording's first fix.
    """
    zone = fixes.groupBy(*keys).agg(F.min(F.struct("ts_ns", "seq", "lon", "lat")).alias("_f")).select(*keys, gm.utm_zone(F.col("_f.lon")).alias("zone"), gm.utm_epsg(F.col("_f.lon"), F.col("_f.lat")).alias("epsg"))
    near = asof.nearest_join(odometry, fixes, keys, tolerance_ns, ["lat", "lon"], how="inner")
    near = _null_safe(near, zone, keys, "inner")
    near = near.withColumn("_u", gm.utm_forward(F.col("r_lon"), F.col("r_lat"), F.col("zone")))
    pairs = cut_lineage(near.select(*keys, "ts_ns", "seq", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("_u.e").alias("dx"), F.col("_u.n").alias("dy"), "dt_ns", "epsg"))
    align = cut_lineage(fit.similarity_fit(pairs, keys, rigid=rigid))

    def placed(df: DataFrame, x: str, y: str) -> DataFrame:
        j = _null_safe(df, align, keys, "inner")
        e, n = gm.similarity_apply(F.col(x), F.col(y), F.col("scale"), F.col("theta"), F.col("tx"), F.col("ty"))
        return j.select(*df.columns, e.alias("e"), n.alias("north"))

    poses = placed(odometry, "x", "y")
    res = placed(pairs, "sx", "sy")
    err = F.sqrt((F.col("e") - F.col("dx")) * (F.col("e") - F.col("dx")) + (F.col("north") - F.col("dy")) * (F.col("north") - F.col("dy")))
    return {"pairs": pairs, "alignment": align, "poses": poses, "residuals": robust.residual_metrics(res.select(*keys, err.alias("err")), keys, "err")}


def surface_model(
    points: DataFrame, key: Sequence[str], track: DataFrame, track_order: Sequence[str], res: float, half_width: float, end_pad: float, fill_radius: int, clip: tuple[float, float] = (0.01, 0.995), payload: Sequence[str] = ("intensity",), mode: str = "p95"
) -> dict[str, DataFrame]:
    """Height clip, corridor, surface per cell, hole filling and height above ground: ``points, meta, cells``."""
    p = attach_quantiles(points, [], "z", {"_lo": clip[0], "_hi": clip[1]})
    p = p.where(F.col("z").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    if half_width > 0:
        seg = spatial.track_segments(track, [], track_order)
        p = spatial.corridor(p, seg, key, half_width, end_pad).drop("d2")
    p = cut_lineage(p)
    meta = rz.raster_meta(p, res)
    c = rz.with_cells(p, meta)
    surf = rz.surface_p95(c, ["row", "col"], "z", key, payload) if mode == "p95" else rz.surface_max(c, ["row", "col"], "z", key, payload)
    surf = cut_lineage(surf)
    filled = nb.nearest_fill(surf, [], ["z", *payload], fill_radius)
    ground = exact_quantiles(surf, [], "z", {"g": 0.05})
    filled = filled.withColumn("height", F.col("z") - ground.select("g").scalar())
    n = surf.select("row", "col", "n")
    return {"points": p, "meta": meta, "cells": filled.join(n, ["row", "col"], "left")}


def paint_cells(cells: DataFrame, meta: DataFrame, views: DataFrame, pixels: DataFrame, k: Sequence[float], dist: Sequence[float], width: int, height: int, min_z: float = 0.05) -> DataFrame:
    """Colour each surface cell from the frame that sees it nearest to its centre.

    ``views`` has ``frame, r`` (map to camera, 9 values) and ``t``; cells meet
    views through buckets of the ground each view can see (``vx0..vy1``), then
    the pixel by equi-join.
    """
    m = _one(meta)
    d = cells.withColumn("_m", m)
    d = d.select(*cells.columns, (F.col("_m.emin") + (F.col("col") + 0.5) * F.col("_m.res")).alias("ex"), (F.col("_m.nmax") - (F.col("row") + 0.5) * F.col("_m.res")).alias("ny"))
    size = 5.0
    v = views.withColumn("_cx", F.explode(F.sequence(spatial.cell(F.col("vx0"), size), spatial.cell(F.col("vx1"), size))))
    v = v.withColumn("_cy", F.explode(F.sequence(spatial.cell(F.col("vy0"), size), spatial.cell(F.col("vy1"), size))))
    d = d.withColumn("_cx", spatial.cell(F.col("ex"), size)).withColumn("_cy", spatial.cell(F.col("ny"), size))
    j = d.join(v.select("frame", "r", "t", "vx0", "vx1", "vy0", "vy1", "_cx", "_cy"), ["_cx", "_cy"])
    j = j.where(F.col("ex").between(F.col("vx0"), F.col("vx1")) & F.col("ny").between(F.col("vy0"), F.col("vy1")))
    cam = gm.rigid_apply(F.col("r"), F.col("t"), [F.col("ex"), F.col("ny"), F.col("z")])
    j = j.select("row", "col", "frame", *[c.alias(f"_q{i}") for i, c in enumerate(cam)]).where(F.col("_q2") > min_z)
    j = projected(j, F.col("_q0"), F.col("_q1"), F.col("_q2"), k, dist, "_u", "_v")
    j = computed(j.select("row", "col", "frame", "_u", "_v"), F.bround("_u").cast("int").alias("c"), F.bround("_v").cast("int").alias("r")).drop("_u", "_v").where((F.col("c") >= 0) & (F.col("c") < width) & (F.col("r") >= 0) & (F.col("r") < height))
    j = j.withColumn("score", rz.centre_score(F.col("c"), F.col("r"), (0.0, 0.0, float(width), float(height))))
    j = j.join(pixels, ["frame", "r", "c"])
    return rz.best_view(j, ["row", "col"], "score", "frame", ["r", "c"], [c for c in pixels.columns if c not in ("frame", "r", "c")])


def coloured_cloud(points: DataFrame, frames_: DataFrame, pixels: DataFrame, keys: Sequence[str], tolerance_ns: int, k: Sequence[float], dist: Sequence[float], width: int, height: int, res: float, tie: Sequence[str]) -> DataFrame:
    """Colour points from the nearest frame in time and raster them, highest point per cell.

    ``points`` are in the camera frame (``x, y, z``) with map coordinates
    ``e, n, h``.  The frame is looked up once per stamp, the image position
    does not depend on it, and the coloured points are written once: both the
    extent of the raster and its cells read them.
    """
    near = asof.nearest_of_stamps(points, frames_, keys, tolerance_ns, ["frame"], "f_")
    d = projected(points.where(F.col("z") > 0.05), F.col("x"), F.col("y"), F.col("z"), k, dist, "_u", "_v")
    d = computed(d, F.bround("_u").cast("int").alias("c"), F.bround("_v").cast("int").alias("r")).drop("_u", "_v")
    d = d.where((F.col("c") >= 0) & (F.col("c") < width) & (F.col("r") >= 0) & (F.col("r") < height))
    d = d.join(near.select(*keys, "ts_ns", "f_frame"), [*keys, "ts_ns"])
    px = pixels.withColumnRenamed("frame", "f_frame")
    bands = [c for c in pixels.columns if c not in ("frame", "r", "c")]
    d = cut_lineage(d.join(px, ["f_frame", "r", "c"]).select("e", "n", "h", *tie, "z", *bands))
    cells = rz.with_cells(d, rz.raster_meta(d, res, "e", "n"), "e", "n")
    return rz.surface_max(cells, ["row", "col"], "h", tie, ["z", *bands])


# Stopping rule of the pairwise registration.
ICP_MAX_ITERATIONS = 25
ICP_MIN_PAIRS = 80
ICP_RMSE_STEP = 1e-5


def try_guesses(scans: DataFrame, pairs: DataFrame, max_corr: float, iterations: int = ICP_MAX_ITERATIONS, min_pairs: int = ICP_MIN_PAIRS) -> DataFrame:
    """Point-to-point registration of scan pairs from several first guesses, all in parallel; a written table with one row per (pair, guess).

    ``scans`` has ``scan, pid, x, y, z``; ``pairs`` has ``pair, src, dst,
    guess, r, t``.  Each round joins the moved source points to their nearest
    destination points and refits; a (pair, guess) stops when its RMSE changes
    by less than 1e-5 or it has too few matches.  ``open`` says whether it was still moving after
    ``iterations`` (``rounds`` it took); without a match the guess stays as it was and ``rmse`` is NULL.
    Returns ``pair, guess, r, t, n, rmse, open, rounds``.
    """
    key = ["pair", "guess"]
    src = pairs.select(*key, F.col("src").alias("scan")).join(scans, "scan").select(*key, "pid", "x", "y", "z")
    dst = pairs.select(*key, F.col("dst").alias("scan")).join(scans, "scan").select(*key, "pid", "x", "y", "z")
    state = cut_lineage(pairs.select(*key, "r", "t", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("rmse"), F.lit(True).alias("open"), F.lit(0).alias("rounds")))
    for _ in range(iterations):
        live = state.where("open").select(*key, "r", "t")
        m = src.join(live, key)
        moved = gm.rigid_apply(F.col("r"), F.col("t"), [F.col(c) for c in "xyz"])
        m = m.select(*key, "pid", *[c.alias(n) for c, n in zip(moved, "xyz")])
        hit = spatial.nearest_point(m, dst.join(live.select(*key), key, "left_semi"), key, ["pid"], "pid", ["x", "y", "z"], max_corr, (8.0, 2.0, 1.0))
        hit = cut_lineage(hit.select(*key, "x", "y", "z", "t_x", "t_y", "t_z", "d2"))
        delta = fit.rigid3d_fit(hit, key, ["x", "y", "z"], ["t_x", "t_y", "t_z"]).withColumnRenamed("r", "_dr").withColumnRenamed("t", "_dt").withColumnRenamed("n", "_n")
        rm = hit.groupBy(*key).agg(F.sqrt(F.avg("d2")).alias("_rmse"))
        j = state.join(delta.join(rm, key), key, "left")
        step = F.col("open") & (F.coalesce("_n", F.lit(0)) >= min_pairs)
        new_r = trajectory.matmul(F.col("_dr"), F.col("r"), 3)
        new_t = F.array(*gm.rigid_apply(F.col("_dr"), F.col("_dt"), [F.get("t", F.lit(i)) for i in range(3)]))
        still = step & (F.col("rmse").isNull() | (F.abs(F.col("rmse") - F.col("_rmse")) >= ICP_RMSE_STEP))
        state = cut_lineage(
            j.select(
                *key, F.when(step, new_r).otherwise(F.col("r")).alias("r"), F.when(step, new_t).otherwise(F.col("t")).alias("t"),
                F.when(step, F.col("_n")).otherwise(F.col("n")).alias("n"), F.when(step, F.col("_rmse")).otherwise(F.col("rmse")).alias("rmse"), F.coalesce(still, F.lit(False)).alias("open"), (F.col("rounds") + F.col("open").cast("int")).alias("rounds"),
            )
        )
        if state.where("open").isEmpty():
            break
    return state


def best_guess(tried: DataFrame) -> DataFrame:
    """Per pair the guess with the lowest RMSE - 1e-6 * matches, the first on a tie; ``converged`` if it stopped by the rule."""
    score = F.coalesce("rmse", F.lit(999.0)) - 1e-6 * F.col("n")
    return ranking.first_by(tried, ["pair"], [score, F.col("guess")]).select("pair", "guess", "r", "t", "n", "rmse", "rounds", (~F.col("open") & F.col("rmse").isNotNull()).alias("converged"))


def register_scans(scans: DataFrame, pairs: DataFrame, max_corr: float, iterations: int = ICP_MAX_ITERATIONS, min_pairs: int = ICP_MIN_PAIRS) -> DataFrame:
    """The best guess of each pair: ``pair, guess, r, t, n, rmse, rounds, converged``."""
    return best_guess(try_guesses(scans, pairs, max_corr, iterations, min_pairs))


def initial_guesses(pairs: DataFrame, distance: str) -> DataFrame:
    """Identity and a step of ``distance`` along -x, +x, -y, +y for each pair, in that order."""
    o, d = F.lit(0.0), F.col(distance)
    eye = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    shifts = F.array(F.array(o, o, o), F.array(-d, o, o), F.array(d, o, o), F.array(o, -d, o), F.array(o, d, o))
    return pairs.select("*", F.posexplode(shifts).alias("guess", "t")).withColumn("r", eye)


# Number of each axis among the first guesses, and the order that decides equal scores.
AXES = {"x_plus": 2, "x_minus": 1, "y_plus": 4, "y_minus": 3}


def bounded_corrections(moves: DataFrame, max_shift: float, max_turn_deg: float) -> DataFrame:
    """Registered motions ``r, t`` held near their priors ``r0, t0``.

    The correction ``(r, t) . (r0, t0)^-1`` is cut to ``max_shift`` in length and ``max_turn_deg`` in angle (0: no
    limit), then applied to the prior: ``r, t`` are replaced, ``shift`` is the length of the correction that was applied.
    A half turn has no axis in its skew part; such a correction is left without rotation.  Each step is a column of its
    own, so no expression holds another one many times.
    """
    at = lambda a, i: F.get(F.col(a), F.lit(i))
    vec = lambda a, n=3: [at(a, i) for i in range(n)]
    rest = [c for c in moves.columns if c not in ("r", "t", "r0", "t0")]
    back_r, back_t = gm.rigid_inverse(F.col("r0"), F.col("t0"))
    d = moves.withColumn("_br", back_r).withColumn("_bt", F.array(*[F.get(back_t, F.lit(i)) for i in range(3)]))
    d = d.withColumn("_cr", trajectory.matmul(F.col("r"), F.col("_br"), 3)).withColumn("_ct", F.array(*gm.rigid_apply(F.col("r"), F.col("t"), vec("_bt"))))
    d = d.withColumn("_ct", F.array(*gm.clamp_length(vec("_ct"), max_shift))).withColumn("_angle", F.radians(gm.rotation_angle_deg(F.col("_cr"))))
    turn = F.least(F.col("_angle"), F.lit(math.radians(max_turn_deg))) if max_turn_deg > 0 else F.col("_angle")
    d = d.withColumn("_per", F.when(F.abs(F.sin("_angle")) > 1e-12, turn / (2.0 * F.sin("_angle"))).otherwise(F.lit(0.0)))
    skew = [at("_cr", 7) - at("_cr", 5), at("_cr", 2) - at("_cr", 6), at("_cr", 3) - at("_cr", 1)]
    d = d.withColumn("_v", F.array(*[F.col("_per") * v for v in skew])).withColumn("_h", gm.rodrigues(*vec("_v")))
    d = d.withColumn("r", trajectory.matmul(F.col("_h"), F.col("r0"), 3)).withColumn("t", F.array(*gm.rigid_apply(F.col("_h"), F.col("_ct"), vec("t0"))))
    return d.select(*rest, "r", "t", F.sqrt(sum((v * v for v in vec("_ct")[1:]), vec("_ct")[0] * vec("_ct")[0])).alias("shift"))


def _matrix4(r: Column, t: Column) -> Column:
    rows = [[*[F.get(r, F.lit(3 * i + j)) for j in range(3)], F.get(t, F.lit(i))] for i in range(3)]
    return F.array(*[v for row in rows for v in row], *[F.lit(float(i == 3)) for i in range(4)])


def register_track(
    scans: DataFrame, frames_: DataFrame, keys: Sequence[str], max_corr: float, max_shift: float, max_turn_deg: float, iterations: int = ICP_MAX_ITERATIONS, min_pairs: int = ICP_MIN_PAIRS
) -> dict[str, DataFrame]:
    """Poses of consecutive scans from their pairwise registration: ``pairs, poses, scores``.

    ``frames_`` has ``scan, ts_ns, seq, speed`` (``scan`` unique), ``scans`` has ``scan, pid, x, y, z``.
    Each scan meets the one before it from five first guesses (no motion, and the distance that the speeds
    of both promise along each axis), all pairs and guesses in one loop.  Two kinds of chain come of it:

    * ``free``: each pair takes its best guess.
    * one per axis: the guess along that axis is the prior, and the registration may correct it within
      ``max_shift`` and ``max_turn_deg``.  Of the four whole chains the one with the best score (footprint,
      path length, mean residual, mean correction) is ``constrained``; ``scores`` has all four.

    ``poses`` has ``variant, axis, pose`` (row-major 4 x 4) per frame, the first being the identity.  A pair without
    enough matches keeps its first guess, so the chain never breaks.
    """
    d = trajectory.consecutive_deltas(frames_, keys, "speed")
    d = previous_row(d, keys, ["ts_ns", "seq"], {"scan": "_before"})
    d = cut_lineage(d.select(*keys, "scan", "ts_ns", "seq", "_before", F.coalesce("step", F.lit(0.0)).alias("step")))
    pairs = d.where(F.col("_before").isNotNull()).select(F.col("scan").alias("pair"), F.col("scan").alias("src"), F.col("_before").alias("dst"), "step")
    guesses = cut_lineage(initial_guesses(pairs, "step"))
    tried = try_guesses(scans, guesses.select("pair", "src", "dst", "guess", "r", "t"), max_corr, iterations, min_pairs)

    best = best_guess(tried)
    free = best.select(F.col("pair").alias("scan"), F.lit("free").alias("variant"), _matrix4(F.col("r"), F.col("t")).alias("m"), "rmse", F.lit(0.0).alias("shift"))
    prior = guesses.select("pair", "guess", F.col("r").alias("r0"), F.col("t").alias("t0"))
    axis = F.element_at(F.create_map(*[x for a, g in AXES.items() for x in (F.lit(g), F.lit(a))]), F.col("guess"))
    held = tried.where(F.col("guess").isin(*AXES.values())).join(prior, ["pair", "guess"])
    held = cut_lineage(bounded_corrections(held.select(F.col("pair").alias("scan"), axis.alias("variant"), "r", "t", "r0", "t0", "rmse"), max_shift, max_turn_deg))
    held = held.select("scan", "variant", _matrix4(F.col("r"), F.col("t")).alias("m"), "rmse", "shift")
    steps = cut_lineage(free.unionByName(held))

    variants = F.explode(F.array(*[F.lit(v) for v in ("free", *AXES)])).alias("variant")
    every = d.select(*keys, "scan", "ts_ns", "seq", variants).join(steps, ["scan", "variant"], "left")
    chain = [*keys, "variant"]
    poses = trajectory.pose_chain(every, chain, "m", 4)
    poses = cut_lineage(poses.select(*chain, "scan", "ts_ns", "seq", "rmse", "shift", "pose", *[F.get("pose", F.lit(4 * i + 3)).alias(c) for i, c in enumerate("xyz")]))

    held_poses = poses.where(F.col("variant") != "free")
    span = trajectory.path_and_span(held_poses, chain, ["x", "y", "z"])
    means = held_poses.groupBy(*chain).agg(F.count(F.lit(1)).alias("_n"), F.avg("rmse").alias("rmse"), F.avg("shift").alias("corr"))
    area = F.greatest("span_x", F.lit(1e-6)) * F.greatest("span_y", F.lit(1e-6))
    scores = _null_safe(span, means, chain, "inner").withColumn("area", area)
    scores = trajectory.trajectory_score(scores).withColumn("score", F.when(F.col("_n") < 2, F.lit(-1e9)).otherwise(F.col("score"))).drop("_n")
    scores = cut_lineage(scores)
    order = F.element_at(F.create_map(*[x for i, a in enumerate(AXES) for x in (F.lit(a), F.lit(i))]), F.col("variant"))
    chosen = ranking.first_by(scores, list(keys), [-F.col("score"), order]).select(*keys, F.col("variant").alias("axis"))
    axis_of = _null_safe(held_poses, chosen, keys, "inner").where("variant = axis").withColumn("variant", F.lit("constrained"))
    out = poses.where("variant = 'free'").withColumn("axis", F.lit(None).cast("string")).unionByName(axis_of)
    return {"pairs": best, "poses": out, "scores": scores}


def registered_frames(sync: DataFrame, pixels: Mapping[str, DataFrame], h_to_rgb: Mapping[str, Sequence[float]], width: int, height: int) -> dict[str, DataFrame]:
    """Warp every sensor of each frame set into the master image, then crop to what all see.

    ``sync`` has ``frame`` and a column per sensor with the sensor's own frame
    number.  Gives ``cells`` (one value column per sensor) and ``crop``.
    """
    grid = sync.select("frame", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("r")).select("frame", "r", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("c"))
    layers, masks = [], []
    for s, px in pixels.items():
        own = px.withColumnRenamed("frame", s).join(sync.select("frame", s), s).select("frame", "r", "c", "v")
        w = nb.warp(own, grid, ["frame"], gm.h_inverse_of(h_to_rgb[s]), "v").where("valid")
        layers.append(w.select("frame", "r", "c", F.lit(s).alias("sensor"), "v"))
        masks.append(layers[-1])
    allv = cut_lineage(merging.union_sources(*layers))
    crop = frames.common_valid_box(allv, ["frame"], "sensor", len(pixels))
    wide = allv.groupBy("frame", "r", "c").pivot("sensor", list(pixels)).agg(F.max("v"))
    inside = wide.join(crop, "frame").where((F.col("c") >= F.col("x0")) & (F.col("c") < F.col("x1")) & (F.col("r") >= F.col("y0")) & (F.col("r") < F.col("y1")))
    return {"cells": inside.select("frame", "r", "c", *pixels), "crop": frames.coverage(crop, ["frame"], width, height, 1, 1)}


def _strip_weight(u: Column, v: Column, width: int, height: int, feather: float) -> Column:
    """Weight of a source position: highest in the middle row, interpolated between rows, falling to 0 at the frame's edge."""
    spread = max(height * feather, 1.0)

    def row(r: Column) -> Column:
        off = (r - height * 0.5) / spread
        return F.when((r >= 0) & (r < height), F.exp(-0.5 * off * off)).otherwise(0.0)

    def column(c: Column) -> Column:
        return ((c >= 0) & (c < width)).cast("double")

    fu, fv = F.floor(u), F.floor(v)
    a, b = u - fu, v - fv
    return ((1.0 - b) * row(fv) + b * row(fv + 1)) * ((1.0 - a) * column(fu) + a * column(fu + 1))


def plot_mosaic(pixels: DataFrame, matches: DataFrame, width: int, height: int, mode: str = "vertical_strip", feather: float = 0.18) -> dict[str, DataFrame]:
    """Mosaic per plot from given pair matches: ``transforms, canvas, crop, cells, quality``.

    ``matches`` has ``plot, frame, ts_ns, seq`` and the match results of
    :func:`pairing.pair_transform` against the previous frame (NULL for the
    first).  Every canvas cell below a frame's footprint asks that frame for its
    value, so enlarged and turned frames leave no hole; frames are blended with
    a weight that falls off from the middle row.  ``crop`` is the box of the
    valid cells on the canvas (half-open), and ``row, col`` of ``cells`` count
    from its corner.
    """
    d = pairing.pair_transform(matches, width, height, mode)
    d = running_index(d, ["plot"], ["ts_ns", "seq"], "_i")
    d = d.withColumn("_first", F.col("_i") == 0).withColumn("h", F.when(F.col("_first"), F.lit(None)).otherwise(F.col("h")))
    chain = cut_lineage(trajectory.pose_chain(d.select("plot", "frame", "ts_ns", "seq", "h", "method", "_first"), ["plot"], "h", 3))
    can = cut_lineage(pairing.canvas(chain, ["plot"], "pose", width, height))
    corners = [gm.h_apply(F.col("pose"), F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (width, 0), (width, height), (0, height))]
    edge = lambda pick, to, i, name: to(pick(*[p[i] for p in corners])).cast("int").alias(name)
    back = chain.select("plot", "frame", gm.h_inverse(F.col("pose")).alias("_back"), edge(F.least, F.floor, 0, "_c0"), edge(F.least, F.floor, 1, "_r0"), edge(F.greatest, F.ceil, 0, "_c1"), edge(F.greatest, F.ceil, 1, "_r1"))
    back = cut_lineage(back)
    cells = back.withColumn("r", F.explode(F.sequence("_r0", "_r1"))).withColumn("c", F.explode(F.sequence("_c0", "_c1")))
    seen = nb.warp(pixels.select("plot", "frame", "r", "c", F.col("v").cast("double").alias("v")), cells, ["plot", "frame"], F.col("_back"), "v").where("valid")
    seen = seen.join(back.select("plot", "frame", "_back"), ["plot", "frame"])
    u, v = gm.h_apply(F.col("_back"), F.col("c").cast("double"), F.col("r").cast("double"))
    seen = seen.withColumn("_u", u).withColumn("_v", v).withColumn("w", _strip_weight(F.col("_u"), F.col("_v"), width, height, feather))
    blended = cut_lineage(rz.weighted_blend(seen, ["plot", "r", "c"], ["v"], "w").where("valid").drop("valid"))
    crop = blended.groupBy("plot").agg(F.min("c").alias("x0"), F.min("r").alias("y0"), (F.max("c") + 1).alias("x1"), (F.max("r") + 1).alias("y1"))
    cells = blended.join(crop.select("plot", "x0", "y0"), "plot").select("plot", (F.col("r") - F.col("y0")).alias("row"), (F.col("c") - F.col("x0")).alias("col"), "v", "weight")
    shifted = crop.join(can.select("plot", "tx", "ty"), "plot")
    crop = shifted.select("plot", *[(F.col(e) + F.col(t)).alias(e) for e, t in (("x0", "tx"), ("y0", "ty"), ("x1", "tx"), ("y1", "ty"))])
    pairs = chain.where(~F.col("_first"))
    quality = trajectory.trajectory_quality(pairs, ["plot"], "method", [f"rgb_feature_{mode}", f"soil_feature_{mode}", f"rgb_ecc_{mode}"])
    return {"transforms": chain, "canvas": can, "crop": crop, "cells": cells, "quality": quality}


def plot_windows(frames_: DataFrame, fixes: DataFrame, plots: DataFrame, keys: Sequence[str], windows: int, half_ns: int, tolerance_ns: int, min_frames: int, cell_size: float) -> DataFrame:
    """Best time window per recording and plot: most frames, the earlier window on a tie.

    Frames get the nearest fix, fixes get the plot that contains them; the
    recording is read once for all windows.
    """
    counts = _window_counts(frames_, _frames_in_plots(frames_, fixes, plots, keys, tolerance_ns, cell_size), keys, windows, half_ns)
    g = counts.where(F.col("frames") >= min_frames).groupBy(*keys, "plot_id").agg(_best_window().alias("_b"))
    return g.select(*keys, "plot_id", "_b.win", "_b.center_ns", "_b.frames")


def _frames_in_plots(frames_: DataFrame, fixes: DataFrame, plots: DataFrame, keys: Sequence[str], tolerance_ns: int, cell_size: float) -> DataFrame:
    at = asof.nearest_join(frames_, fixes, keys, tolerance_ns, ["x", "y"], how="inner")
    at = spatial.assign_plot(at.select(*keys, "ts_ns", "seq", F.col("r_x").alias("x"), F.col("r_y").alias("y")), plots, [*keys, "ts_ns", "seq"], cell_size)
    return at.where(F.col("plot_id").isNotNull())


def _best_window() -> Column:
    return F.max(F.struct("frames", (-F.col("win")).alias("o"), "win", "center_ns"))


def _window_counts(frames_: DataFrame, at: DataFrame, keys: Sequence[str], windows: int, half_ns: int) -> DataFrame:
    win = sampling.window_centres(sampling.stream_bounds(frames_, keys), windows, half_ns)
    win = win.select(*keys, "win", "ts_ns", F.col("win").cast("bigint").alias("seq"))
    hit = asof.within_interval(win, at.select(*keys, "ts_ns", "seq", "plot_id"), keys, half_ns)
    return hit.groupBy(*keys, F.col("r_plot_id").alias("plot_id"), "win", F.col("ts_ns").alias("center_ns")).agg(F.count(F.lit(1)).alias("frames"))


def plot_window_status(frames_: DataFrame, fixes: DataFrame, plots: DataFrame, keys: Sequence[str], windows: int, half_ns: int, tolerance_ns: int, min_frames: int, cell_size: float) -> DataFrame:
    """What became of every plot: ``assigned`` frames, the best window and a ``status`` per recording and plot.

    selected; too_few_frames, with the best window there is; outside_windows; and
    no_frames, one row with NULL keys for a plot that no recording has seen. The selected rows are those of :func:`plot_windows`.
    """
    at = cut_lineage(_frames_in_plots(frames_, fixes, plots, keys, tolerance_ns, cell_size).select(*keys, "ts_ns", "seq", "plot_id"))
    best = _window_counts(frames_, at, keys, windows, half_ns).groupBy(*keys, "plot_id").agg(_best_window().alias("_b"))
    seen = cut_lineage(at.groupBy(*keys, "plot_id").agg(F.count(F.lit(1)).alias("assigned")))
    status = F.when(F.col("_b").isNull(), "outside_windows").when(F.col("_b.frames") < min_frames, "too_few_frames").otherwise("selected")
    d = _null_safe(seen, best, [*keys, "plot_id"], "left").select(*keys, "plot_id", "assigned", "_b.win", "_b.center_ns", "_b.frames", status.alias("status"))
    unseen = plots.select("plot_id").distinct().join(seen.select("plot_id").distinct(), "plot_id", "left_anti")
    return d.unionByName(unseen.select("plot_id", F.lit(0).cast("bigint").alias("assigned"), F.lit("no_frames").alias("status")), allowMissingColumns=True)


def homography_to_master(a: DataFrame, b: DataFrame, group: str, label: str, min_common: tuple[int, int], seed_px: float, final_px: float, max_hint_px: float, composed: DataFrame | None = None, hypotheses: int = 64) -> dict[str, DataFrame]:
    """Sensor-to-master homography per ``group`` from grids that may show different parts of the board.

    All sub-grid placements are fitted robustly together; per label the
    placement with the smallest median error stays, labels above the hint
    limit are rejected with a reason; the rest gives the final fit.  With a
    ``composed`` chain (``group, h``) the better of both is selected.
    """
    lab = [group, label]
    ga, gb = a.withColumn("_l", F.struct(*lab)), b.withColumn("_l", F.struct(*lab))
    p = pairing.subgrid_pairs(pairing.subgrid_options(ga, gb, "_l", min_common), "_l")
    p = p.select("_l.*", *[c for c in p.columns if c != "_l"])
    p = cut_lineage(p.withColumn("pid", F.struct(label, "opt", "corner")))
    seed = cut_lineage(fit.homography_ransac(p, [group], "pid", seed_px, hypotheses=hypotheses).select(group, "h"))
    best = cut_lineage(ranking.best_option(fit.with_error(p, seed, [group]), lab, "opt", "err", max_hint_px))
    good = p.join(best.where("accepted").select(*lab, "opt"), [*lab, "opt"])
    final = cut_lineage(fit.homography_ransac(good, [group], "pid", final_px, hypotheses=hypotheses))
    direct = exact_quantiles(fit.with_error(good, final, [group]), [group], "err", {"direct_median": 0.5}, moments=True)
    out = final.join(direct.select(group, "direct_median", F.col("rms").alias("direct_rms")), group, "left")
    pairs_n = best.groupBy(group).agg(F.count_if("accepted").alias("pairs"), F.count_if(~F.col("accepted")).alias("rejected"))
    out = out.join(pairs_n, group, "left")
    if composed is not None:
        c = exact_quantiles(fit.with_error(good, composed, [group]), [group], "err", {"composed_median": 0.5})
        out = ranking.select_homography(out.join(c, group, "left"), "direct_median", "composed_median")
        out = out.join(composed.select(group, F.col("h").alias("_hc")), group, "left")
        out = out.withColumn("h", F.when(F.col("selected") == "direct", F.col("h")).otherwise(F.col("_hc"))).drop("_hc")
    return {"homography": out, "choices": best}


def calibration_package(candidates: Sequence[DataFrame], solver: DataFrame, stereo: DataFrame, min_pattern: Mapping[str, tuple[int, int]], master: str = "rgb", **fit_args) -> DataFrame:
    """Compact calibration table from detection sources and given solver results.

    One detection per sensor and label is chosen by confidence, area and frame;
    patterns below the sensor's minimum are dropped; every other sensor is then
    registered to the master.
    """
    from sensorlake.sinks.tables import compact_calibration

    allc = merging.union_sources(*candidates)
    keep = F.coalesce(*[F.when(F.col("sensor") == s, (F.col("cols") >= c) & (F.col("rows") >= r)) for s, (c, r) in min_pattern.items()], F.lit(True))
    d = allc.withColumn("_sl", F.struct("sensor", "label"))
    chosen = cut_lineage(ranking.candidate_by_confidence(d, "_sl", "confidence", "area", "frame_index", ["source"]).where(keep).drop("_sl"))
    others = chosen.where(F.col("sensor") != master)
    mast = chosen.where(F.col("sensor") == master).drop("sensor")
    mast = others.select("sensor", "label").join(mast, "label")
    reg = homography_to_master(others, mast, "sensor", "label", **fit_args)["homography"]
    views = chosen.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    i = solver.join(views, "sensor").select("sensor", lb.intrinsics_status(F.col("sensor"), F.col("rms_px"), F.col("median_px")).alias("status"), "n", F.col("rms_px").alias("error_px"), none.alias("notes"))
    h = reg.select("sensor", lb.homography_status(F.col("sensor"), F.col("direct_median")).alias("status"), F.col("pairs").alias("n"), F.col("direct_median").alias("error_px"), none.alias("notes"))
    s = stereo.join(views, "sensor").select("sensor", lb.stereo_status(F.col("rms_px")).alias("status"), "n", F.col("rms_px").alias("error_px"), none.alias("notes"))
    return compact_calibration(i, h, s)


def slam_export(messages: DataFrame, topics: Mapping[str, str], centre_ns: int | None, half_ns: int) -> dict[str, DataFrame]:
    """Indexed messages of the wanted topics inside a window, and their counts per stream."""
    from sensorlake.sinks.tables import stream_table

    d = recordings.select_topics(messages, topics)
    if centre_ns is not None:
        d = sampling.centred_window(d, centre_ns, half_ns)
    rows = stream_table(d)
    n = d.groupBy("bag_id", "sensor").agg(F.count(F.lit(1)).alias("rows"), F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"))
    return {"streams": rows, "manifest": n}


def frame_extraction_index(messages: DataFrame, fixes: DataFrame, plots: DataFrame, keys: Sequence[str], every: int, tolerance_ns: int, cell_size: float) -> DataFrame:
    """Sampled frames per recording and sensor with fix, distance in ms, plot and image path."""
    d = sampling.every_nth(messages, [*keys, "sensor"], ["ts_ns", "seq"], every, "frame_index")
    d = asof.nearest_join(d, fixes, keys, tolerance_ns, ["x", "y"])
    d = d.withColumnRenamed("r_x", "x").withColumnRenamed("r_y", "y")
    d = spatial.assign_plot(d, plots, [*keys, "sensor", "frame_index"], cell_size)
    path = lb.frame_name(F.col("sensor"), F.col("frame_index"), F.col("ts_ns"))
    return d.select(*keys, "sensor", "frame_index", "ts_ns", "seq", "x", "y", (F.col("dt_ns") / F.lit(1e6)).alias("gps_dt_ms"), "plot_id", path.alias("image_path"))


# Fixed value: largest time gap between the colour frame and the cloud, in ns.
PANEL_MAX_DT_NS = 180_000_000


def panel_evidence(poses: DataFrame, clouds: DataFrame, points: DataFrame, keys: Sequence[str], pid: str, max_dt_ns: int = PANEL_MAX_DT_NS, hypotheses: int = 64, min_points: int = 12) -> DataFrame:
    """Plane in the nearest cloud near the panel predicted from each colour pose.

    ``poses`` has ``label, ts_ns, seq, cx, cy, cz, nx, ny, nz`` (LiDAR frame);
    ``clouds`` has ``cloud, ts_ns, seq``; ``points`` has ``cloud, x, y, z``.
    The tight window counts when it holds 12 points, else the broad one.
    """
    near = asof.nearest_join(poses, clouds, keys, None, ["cloud"], "c_", "inner")
    near = near.where(F.col("dt_ns") <= max_dt_ns)
    j = points.join(near.withColumnRenamed("c_cloud", "cloud"), [*keys, "cloud"])
    n, _ = gm.plane_normalise([F.col(c) for c in ("nx", "ny", "nz")], F.lit(0.0))
    p, c = [F.col(v) for v in "xyz"], [F.col(v) for v in ("cx", "cy", "cz")]
    j = j.where(gm.panel_window(p, c, n, gm.PANEL_BROAD)).withColumn("_tight", gm.panel_window(p, c, n, gm.PANEL_TIGHT))
    k = [*keys, "label"]
    enough = j.groupBy(*k).agg(F.count_if("_tight").alias("_nt"))
    j = cut_lineage(_null_safe(j, enough, k, "inner").where(F.col("_tight") | (F.col("_nt") < min_points)).select(*k, pid, "x", "y", "z"))
    return fit.ransac_plane(j, k, pid, hypotheses=hypotheses, min_points=min_points)


def presentation_samples(messages: DataFrame, fixes_key: str, plots: DataFrame, keys: Sequence[str], targets: int, tolerance_ns: Mapping[str, int], cell_size: float) -> DataFrame:
    """Per recording and target time the nearest message of every stream, and the plot (or nearest plot) of its fix.

    ``messages`` has ``sensor, ts_ns, seq, x, y`` (position only on fixes).
    """
    b = sampling.stream_bounds(messages, keys)
    t = sampling.target_times(b, targets).select(*keys, "target", "ts_ns", F.col("target").cast("bigint").alias("seq"))
    got = asof.reverse_nearest(messages, t, keys, "target", "sensor", tolerance_ns, ["x", "y"])
    sensors = [s for s in tolerance_ns]
    wide = got.groupBy(*keys, "target").agg(*[F.max(F.when(F.col("sensor") == s, F.col("seq"))).alias(f"{s}_seq") for s in sensors], *[F.max(F.when(F.col("sensor") == fixes_key, F.col(c))).alias(c) for c in ("x", "y")])
    return spatial.assign_plot(wide, plots, [*keys, "target"], cell_size, levels=3)


def consolidate_campaign(attempts: DataFrame, existing: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Best attempt per recording and sensor, against an existing detection: ``best`` and ``counts``.

    ``attempts`` has ``confidence, score, quality, pos``; ``existing`` has ``score, method``.
    """
    new = ranking.best_attempt(attempts, keys, "confidence", "score", "quality", ["pos"])
    new = new.select(*keys, F.col("combined_score").alias("score"), "method")
    best = merging.keep_better(new, existing.select(*keys, "score", "method"), keys, "score", ["method"])
    sensor = keys[-1]
    counts = merging.detection_counts(best, [sensor], {"kept_existing": F.col("used_existing"), "with_alternative": F.col("alternative_score").isNotNull()})
    return {"best": best, "counts": counts}


# Sweep intensity display curve and the weight of vegetation.
SWEEP_LOW, SWEEP_HIGH, SWEEP_GAMMA = 0.08, 0.97, 0.75
VEG_BASE, VEG_GAIN = 0.18, 0.82


def sweep_intensity(cells: DataFrame, vegetation: DataFrame, pixel: Sequence[str], value: str = "intensity", sigma: float = 3.0) -> DataFrame:
    """Brightest sweep value per pixel on a display curve, weighted by the blurred vegetation mask.

    ``cells`` has one row per sweep and pixel; ``vegetation`` one row per pixel
    of a dense frame with a 0/1 ``veg``.  The last two entries of ``pixel`` are
    row and column.
    """
    *key, r, c = pixel
    top = cells.where(F.col(value).isNotNull()).groupBy(*pixel).agg(F.max(value).alias("v"))
    q = attach_quantiles(top, key, "v", {"_lo": SWEEP_LOW, "_hi": SWEEP_HIGH})
    tone = color.gamma_curve(F.col("v"), F.col("_lo"), F.col("_hi"), SWEEP_GAMMA, 1.0)
    veg = nb.blur(vegetation, key, "veg", sigma, "_veg", r, c)
    d = q.join(veg, list(pixel))
    return d.select(*pixel, (tone * (VEG_BASE + VEG_GAIN * F.col("_veg"))).alias("value"))
