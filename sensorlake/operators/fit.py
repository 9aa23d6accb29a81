"""Model fits from sums: similarity, rigid, plane and homography, with hypothesis sampling.

Every fit reduces its points to a fixed number of sums per group (map-side
combined); only those sums, one row per group, reach a small NumPy step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sensorlake.functions.geometry import h_apply
from sensorlake.operators.ordered import _null_safe
from sensorlake.operators.quantiles import attach_quantiles, exact_quantiles
from sensorlake.session import cut_lineage

VEC = T.ArrayType(T.DoubleType())


def similarity_fit(pairs: DataFrame, keys: Sequence[str], src: tuple[str, str] = ("sx", "sy"), dst: tuple[str, str] = ("dx", "dy"), rigid: bool = False) -> DataFrame:
    """Least-squares turn, scale and shift per key: ``n, scale, theta, tx, ty``.

    Closed form from centred sums; a source without extent gives the identity
    turn and scale.  No reflection is ever produced.
    """
    a, b, c, d = (F.col(v) for v in (*src, *dst))
    mean = pairs.groupBy(*keys).agg(F.avg(a).alias("_a"), F.avg(b).alias("_b"), F.avg(c).alias("_c"), F.avg(d).alias("_d"))
    j = _null_safe(pairs, mean, keys, "inner") if keys else pairs.withColumn("_m", mean.select(F.struct("*")).scalar()).select("*", "_m.*")
    xa, xb, xc, xd = a - F.col("_a"), b - F.col("_b"), c - F.col("_c"), d - F.col("_d")
    g = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(xa * xc + xb * xd).alias("_p"),
        F.sum(xa * xd - xb * xc).alias("_q"),
        F.sum(xa * xa + xb * xb).alias("_r"),
        *[F.max(v).alias(v) for v in ("_a", "_b", "_c", "_d")],
    )
    flat = F.col("_r") <= 1e-12
    theta = F.when(flat, F.lit(0.0)).otherwise(F.atan2("_q", "_p"))
    scale = F.lit(1.0) if rigid else F.when(flat, F.lit(1.0)).otherwise(F.hypot("_p", "_q") / F.when(~flat, F.col("_r")))
    g = g.withColumn("theta", theta).withColumn("scale", scale)
    co, si = F.cos("theta"), F.sin("theta")
    tx = F.col("_c") - F.col("scale") * (co * F.col("_a") - si * F.col("_b"))
    ty = F.col("_d") - F.col("scale") * (si * F.col("_a") + co * F.col("_b"))
    return g.select(*keys, "n", "scale", "theta", tx.alias("tx"), ty.alias("ty"))


def rigid3d_fit(pairs: DataFrame, keys: Sequence[str], src: Sequence[str], dst: Sequence[str]) -> DataFrame:
    """Best rotation and shift ``dst = R src + t`` per key: ``n, r`` (9 values), ``t`` (3 values)."""
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.avg(s).alias(f"_s{i}") for i, s in enumerate(src)] + [F.avg(d).alias(f"_d{i}") for i, d in enumerate(dst)]
    sums += [F.covar_pop(s, d).alias(f"_c{i}{j}") for i, s in enumerate(src) for j, d in enumerate(dst)]
    g = pairs.groupBy(*keys).agg(*sums)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def turn(h: pd.Series) -> pd.Series:
        out = []
        for v in h:
            u, _, vt = np.linalg.svd(np.asarray(v, float).reshape(3, 3))
            fix = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
            out.append((vt.T @ fix @ u.T).ravel().tolist())
        return pd.Series(out)

    g = g.withColumn("r", turn(F.array(*[F.col(f"_c{i}{j}") for i in range(3) for j in range(3)])))
    t = [F.col(f"_d{i}") - sum((F.get("r", F.lit(3 * i + j)) * F.col(f"_s{j}") for j in range(1, 3)), F.get("r", F.lit(3 * i)) * F.col("_s0")) for i in range(3)]
    return g.select(*keys, "n", "r", F.array(*t).alias("t"))


def plane_lsq(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """``z = a x + b y + c`` per key from centred second moments; ``a, b, c, n``."""
    g = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.avg(z).alias("_z"),
        F.covar_pop(x, x).alias("_xx"), F.covar_pop(x, y).alias("_xy"), F.covar_pop(y, y).alias("_yy"), F.covar_pop(x, z).alias("_xz"), F.covar_pop(y, z).alias("_yz"),
    )
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    det = F.when(F.abs(det) > 1e-18, det)
    a = (F.col("_xz") * F.col("_yy") - F.col("_yz") * F.col("_xy")) / det
    b = (F.col("_yz") * F.col("_xx") - F.col("_xz") * F.col("_xy")) / det
    return g.select(*keys, "n", a.alias("a"), b.alias("b"), (F.col("_z") - a * F.col("_x") - b * F.col("_y")).alias("c"))


def ground_height(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", z: str = "z", low: float = 0.65, base: float = 0.05, fallback: float = 0.08) -> DataFrame:
    """Height above a plane fitted to the lowest part of each key's points, shifted by p5, not below 0.

    Keys with fewer than 20 points get 0; with fewer than 12 low points all
    points enter the fit; a singular fit falls back to a low percentile.
    """
    d = attach_quantiles(points, keys, z, {"_zl": low, "_zf": fallback}, settle=True)
    counts = cut_lineage(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(z) <= F.col("_zl")).alias("_nl")))
    d = _null_safe(d, counts, keys, "inner")
    low_points = d.where((F.col(z) <= F.col("_zl")) | (F.col("_nl") < 12)).select(*keys, x, y, z)
    p = cut_lineage(plane_lsq(low_points, keys, x, y, z).select(*keys, *[F.col(v).alias(f"_{v}") for v in "abc"]))
    d = _null_safe(d, p, keys, "left")
    rel = F.coalesce(F.col(z) - (F.col("_a") * F.col(x) + F.col("_b") * F.col(y) + F.col("_c")), F.col(z) - F.col("_zf"))
    d = attach_quantiles(d.withColumn("_rel", rel), keys, "_rel", {"_p": base})
    h = F.when(F.col("_n") < 20, F.lit(0.0)).otherwise(F.greatest(F.col("_rel") - F.col("_p"), F.lit(0.0)))
    return d.select(*points.columns, h.alias("height"))


def plane_pca(points: DataFrame, keys: Sequence[str], xyz: Sequence[str] = ("x", "y", "z"), up: bool = True) -> DataFrame:
    """Plane of least variance per key: ``n, normal, d, centroid, rms``; normal turned up when ``up``."""
    g = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(xyz)],
        *[F.covar_pop(xyz[i], xyz[j]).alias(f"_c{i}{j}") for i in range(3) for j in range(i, 3)],
    )

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def smallest(c: pd.Series) -> pd.Series:
        out = []
        for v in c:
            a = np.asarray(v, float)
            m = np.array([[a[0], a[1], a[2]], [a[1], a[3], a[4]], [a[2], a[4], a[5]]])
            w, e = np.linalg.eigh(m)
            out.append([*e[:, 0].tolist(), max(float(w[0]), 0.0)])
        return pd.Series(out)

    g = g.withColumn("_e", smallest(F.array(*[F.col(f"_c{i}{j}") for i in range(3) for j in range(i, 3)])))
    flip = F.when(F.get("_e", F.lit(2)) < 0, -1.0).otherwise(1.0) if up else F.lit(1.0)
    nrm = [F.get("_e", F.lit(i)) * flip for i in range(3)]
    d = -(nrm[0] * F.col("_m0") + nrm[1] * F.col("_m1") + nrm[2] * F.col("_m2"))
    return g.select(*keys, "n", F.array(*nrm).alias("normal"), d.alias("d"), F.array("_m0", "_m1", "_m2").alias("centroid"), F.sqrt(F.get("_e", F.lit(3))).alias("rms"))


def sample_sets(points: DataFrame, keys: Sequence[str], pid: str, size: int, hypotheses: int, columns: Sequence[str], seed: int = 0) -> DataFrame:
    """``hypotheses`` random sets of ``size`` rows per key, drawn by hash order (repeatable).

    First ``hypotheses * size`` rows per key are drawn; that ranking is cut on
    the map side, so a dominant key sends no more than this per partition.
    The sets are then drawn from this bounded sample.
    """
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), pid), pid)
    few = points.select(*keys, pid, *columns).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= hypotheses * size).drop("_rn")
    d = few.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(hypotheses - 1))))
    w = Window.partitionBy(*keys, "_h").orderBy(F.xxhash64(F.lit(seed), "_h", pid), pid)
    d = d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size)
    return d.groupBy(*keys, "_h").agg(F.array_sort(F.collect_list(F.struct("_rn", *columns))).alias("_set")).where(F.size("_set") == size)


def ransac_plane(
    points: DataFrame, keys: Sequence[str], pid: str, xyz: Sequence[str] = ("x", "y", "z"), threshold: float = 0.035, hypotheses: int = 64, min_points: int = 12, seed: int = 1
) -> DataFrame:
    """Best-supported plane per key, refitted to its inliers.

    Gives ``n`` (inliers), ``normal, d, centroid, rms, extent`` (p95 - p5 per
    axis), ``detected`` and ``reason``.
    """
    hyp = sample_sets(points, keys, pid, 3, hypotheses, xyz, seed)
    p = [[F.col("_set")[i][c] for c in xyz] for i in range(3)]
    u, v = [p[1][i] - p[0][i] for i in range(3)], [p[2][i] - p[0][i] for i in range(3)]
    nrm = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    ln = F.sqrt(nrm[0] * nrm[0] + nrm[1] * nrm[1] + nrm[2] * nrm[2])
    hyp = hyp.withColumn("_l", ln).where("_l >= 1e-9").select(*keys, "_h", *[(nrm[i] / F.col("_l")).alias(f"_n{i}") for i in range(3)], *[p[0][i].alias(f"_p{i}") for i in range(3)])
    hyp = hyp.withColumn("_d", -(F.col("_n0") * F.col("_p0") + F.col("_n1") * F.col("_p1") + F.col("_n2") * F.col("_p2")))
    models = hyp.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_h", "_n0", "_n1", "_n2", "_d"))).alias("_m"))

    def dist(e: Column) -> Column:
        return F.abs(e["_n0"] * F.col(xyz[0]) + e["_n1"] * F.col(xyz[1]) + e["_n2"] * F.col(xyz[2]) + e["_d"])

    j = _null_safe(points, models, keys, "inner") if keys else points.withColumn("_m", models.select("_m").scalar())
    votes = j.select(*keys, F.explode("_m").alias("_e"), *xyz).groupBy(*keys, "_e").agg(F.count_if(dist(F.col("_e")) < threshold).alias("_v"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("_v", (-F.col("_e._h")).alias("o"), F.col("_e").alias("e"))).alias("_b"))
    best = cut_lineage(best.select(*keys, F.col("_b._v").alias("_v"), F.col("_b.e").alias("_e")))
    k = _null_safe(points, best, keys, "inner") if keys else points.withColumn("_b", best.select(F.struct("*")).scalar()).select("*", "_b.*")
    inl = k.where(dist(F.col("_e")) < threshold)
    fit = plane_pca(inl, keys, xyz, up=False)
    for c in xyz:
        q = exact_quantiles(inl, keys, c, {f"_lo_{c}": 0.05, f"_hi_{c}": 0.95})
        fit = _null_safe(fit, q, keys, "left") if keys else fit.withColumn("_q", q.select(F.struct("*")).scalar()).select("*", "_q.*").drop("_q")
    total = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))
    out = _null_safe(total, fit, keys, "left") if keys else total.withColumn("_f", fit.select(F.struct("*")).scalar()).select("points", "_f.*")
    ok = F.coalesce(F.col("n") >= min_points, F.lit(False)) & (F.col("points") >= min_points)
    reason = F.when(F.col("points") < min_points, "too_few_points").when(~ok, "ransac_failed")
    ext = F.array(*[F.col(f"_hi_{c}") - F.col(f"_lo_{c}") for c in xyz])
    return out.select(*keys, "points", "n", "normal", "d", "centroid", "rms", ext.alias("extent"), ok.alias("detected"), reason.alias("reason"))


def _normal_sums(src: Sequence[str], dst: Sequence[str], sc: Sequence[str]) -> list[Column]:
    """The 45 sums of A'A for the direct linear transform, in centred and scaled coordinates."""
    x, y = ((F.col(src[i]) - F.col(f"_c{src[i]}")) * F.col(sc[0]) for i in range(2))
    u, v = ((F.col(dst[i]) - F.col(f"_c{dst[i]}")) * F.col(sc[1]) for i in range(2))
    one, o = F.lit(1.0), F.lit(0.0)
    r1 = [-x, -y, -one, o, o, o, u * x, u * y, u]
    r2 = [o, o, o, -x, -y, -one, v * x, v * y, v]
    return [F.sum(r1[i] * r1[j] + r2[i] * r2[j]).alias(f"_s{i}_{j}") for i in range(9) for j in range(i, 9)]


@F.pandas_udf(VEC)
def _solve_dlt(sums: pd.Series, frame: pd.Series) -> pd.Series:
    """Smallest eigenvector of the 9x9, taken back to image coordinates and scaled to h22 = 1."""
    out = []
    iu = np.triu_indices(9)
    for s, f in zip(sums, frame):
        if s is None or any(v is None or v != v for v in s):
            out.append(None)
            continue
        a = np.zeros((9, 9))
        a[iu] = s
        a = a + np.triu(a, 1).T
        h = np.linalg.eigh(a)[1][:, 0].reshape(3, 3)
        cx, cy, k, du, dv, q = f
        ts = np.array([[k, 0, -k * cx], [0, k, -k * cy], [0, 0, 1.0]])
        back = np.array([[1 / q, 0, du], [0, 1 / q, dv], [0, 0, 1.0]])
        h = back @ h @ ts
        out.append((h / h[2, 2]).ravel().tolist() if abs(h[2, 2]) > 1e-300 else None)
    return pd.Series(out)


def homography_dlt(pairs: DataFrame, keys: Sequence[str], src: Sequence[str] = ("sx", "sy"), dst: Sequence[str] = ("dx", "dy")) -> DataFrame:
    """Linear least-squares homography ``dst ~ H src`` per key: ``n, h``; fewer than 4 pairs give NULL."""
    rms = lambda p: F.sqrt(F.var_pop(p[0]) + F.var_pop(p[1]))
    c = pairs.groupBy(*keys).agg(
        *[F.avg(v).alias(f"_c{v}") for v in (*src, *dst)],
        (F.lit(2.0**0.5) / F.nullif(rms(src), F.lit(0.0))).alias("_k"),
        (F.lit(2.0**0.5) / F.nullif(rms(dst), F.lit(0.0))).alias("_q"),
        F.count(F.lit(1)).alias("n"),
    )
    j = _null_safe(pairs, c, keys, "inner") if keys else pairs.withColumn("_g", c.select(F.struct("*")).scalar()).select("*", "_g.*")
    g = j.groupBy(*keys).agg(*_normal_sums(src, dst, ("_k", "_q")), *[F.max(v).alias(v) for v in (*[f"_c{v}" for v in (*src, *dst)], "_k", "_q", "n")])
    frame = F.array(f"_c{src[0]}", f"_c{src[1]}", "_k", f"_c{dst[0]}", f"_c{dst[1]}", "_q")
    sums = F.array(*[F.col(f"_s{i}_{j}") for i in range(9) for j in range(i, 9)])
    return g.select(*keys, "n", F.when(F.col("n") >= 4, _solve_dlt(sums, frame)).alias("h"))


@F.pandas_udf(VEC)
def _solve_four(xs: pd.Series) -> pd.Series:
    """Exact homography of four correspondences given as 16 numbers (sx, sy, dx, dy each)."""
    out = []
    for v in xs:
        p = np.asarray(v, float).reshape(4, 4)
        a, b = [], []
        for x, y, u, w in p:
            a += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -w * x, -w * y]]
            b += [u, w]
        try:
            out.append([*np.linalg.solve(np.array(a), np.array(b)).tolist(), 1.0])
        except np.linalg.LinAlgError:
            out.append(None)
    return pd.Series(out)


def homography_ransac(
    pairs: DataFrame, keys: Sequence[str], pid: str, threshold: float, src: Sequence[str] = ("sx", "sy"), dst: Sequence[str] = ("dx", "dy"), hypotheses: int = 64, min_inliers: int = 4, seed: int = 7
) -> DataFrame:
    """Homography with outliers: best-supported four-point hypothesis, then a fit to its inliers.

    Gives ``n, inliers, h``; groups below ``min_inliers`` fall back to all pairs.
    """
    sets = sample_sets(pairs, keys, pid, 4, hypotheses, [*src, *dst], seed)
    flat = F.flatten(F.transform("_set", lambda s: F.array(*[s[c].cast("double") for c in (*src, *dst)])))
    hyp = sets.select(*keys, "_h", _solve_four(flat).alias("_mat")).where(F.col("_mat").isNotNull())
    models = hyp.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_h", "_mat"))).alias("_m"))
    j = _null_safe(pairs, models, keys, "left") if keys else pairs.withColumn("_m", models.select("_m").scalar())

    def err(h: Column) -> Column:
        u, v = h_apply(h, F.col(src[0]), F.col(src[1]))
        return F.sqrt((u - F.col(dst[0])) * (u - F.col(dst[0])) + (v - F.col(dst[1])) * (v - F.col(dst[1])))

    votes = j.select(*keys, *src, *dst, F.explode("_m").alias("_e"))
    votes = votes.groupBy(*keys, F.col("_e._h").alias("_h")).agg(F.count_if(F.coalesce(err(F.col("_e._mat")) <= threshold, F.lit(False))).alias("_v"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("_v", (-F.col("_h")).alias("o"))).alias("_b"))
    best = best.select(*keys, F.col("_b._v").alias("inliers"), (-F.col("_b.o")).alias("_h"))
    best = cut_lineage(_null_safe(best, hyp, [*keys, "_h"], "inner").select(*keys, "inliers", F.col("_mat").alias("_fit")))
    k = _null_safe(pairs, best, keys, "left") if keys else pairs.withColumn("_x", best.select(F.struct("*")).scalar()).select("*", "_x.*").drop("_x")
    good = F.coalesce((err(F.col("_fit")) <= threshold) | (F.col("inliers") < min_inliers), F.lit(True))
    fit = homography_dlt(k.where(good), keys, src, dst).withColumnRenamed("n", "used")
    total = k.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("inliers").alias("inliers"))
    out = _null_safe(total, fit, keys, "left") if keys else total.withColumn("_f", fit.select(F.struct("*")).scalar()).select("*", "_f.*").drop("_f")
    return out.select(*keys, "n", "inliers", "used", "h")


def with_error(pairs: DataFrame, models: DataFrame, keys: Sequence[str], h: str = "h", name: str = "err", src: Sequence[str] = ("sx", "sy"), dst: Sequence[str] = ("dx", "dy")) -> DataFrame:
    """Add the transfer error of each pair under its key's homography."""
    j = _null_safe(pairs, models.select(*keys, F.col(h).alias("_H")), keys, "left") if keys else pairs.withColumn("_H", models.select(h).scalar())
    u, v = h_apply(F.col("_H"), F.col(src[0]), F.col(src[1]))
    e = F.sqrt((u - F.col(dst[0])) * (u - F.col(dst[0])) + (v - F.col(dst[1])) * (v - F.col(dst[1])))
    return j.withColumn(name, e).drop("_H")


def grid_residual(corners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Consistency of corner grids (rows ``c, r, x, y`` per key): mean, max, rms error of a lattice homography, ok if max < 2."""
    p = corners.select(*keys, F.col("c").cast("double").alias("sx"), F.col("r").cast("double").alias("sy"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    e = with_error(p, homography_dlt(p, keys), keys)
    g = e.groupBy(*keys).agg(F.avg("err").alias("mean_px"), F.max("err").alias("max_px"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rms_px"))
    return g.withColumn("ok", F.coalesce(F.col("max_px") < 2.0, F.lit(False)))


def alignment_evaluation(poses: DataFrame, folds: int, order: str) -> DataFrame:
    """Per pose: normal angle, centroid-to-plane and centroid error, and fold number (evaluation only).

    ``poses`` has ``cn, cc`` (camera normal, centre) and ``ln, lc`` (the LiDAR
    plane already moved into the camera frame) as 3-arrays.
    """
    from sensorlake.operators.ordered import running_index

    g = lambda c, i: F.get(c, F.lit(i))
    dot = sum((g("cn", i) * g("ln", i) for i in range(1, 3)), g("cn", 0) * g("ln", 0))
    gap = [g("cc", i) - g("lc", i) for i in range(3)]
    d = running_index(poses, [], [order], "_i").withColumn("fold", F.pmod("_i", F.lit(folds)).cast("int")).drop("_i")
    off = gap[0] * g("ln", 0) + gap[1] * g("ln", 1) + gap[2] * g("ln", 2)
    return d.select(
        *poses.columns, "fold",
        F.degrees(F.acos(F.least(F.greatest(F.abs(dot), F.lit(0.0)), F.lit(1.0)))).alias("normal_deg"),
        F.abs(off).alias("plane_m"), F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]).alias("centroid_m"),
    )
