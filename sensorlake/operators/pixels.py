"""Statistics of pixel tables: quality, bands, composites, regions of interest, cleaning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.operators import neighbourhood as nb
from sensorlake.operators.ordered import _null_safe
from sensorlake.operators.quantiles import attach_quantiles, exact_quantiles
from sensorlake.session import cut_lineage

# Weight of the mean absolute gradient and of the saturated share.
QUALITY_WEIGHTS = {"campaign": (0.35, 25.0), "partial_grid": (0.35, 0.0), "thermal": (0.35, 35.0), "intrinsics": (0.25, 18.0)}
SATURATED = (2, 253)
# Fixed values of the mask variants: blur, percentile cuts, block, its deviation and offset, gradient stretch and cut.
BLUR5 = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)
MASK_CUTS = (60, 70, 80)
ADAPTIVE_BLOCK, ADAPTIVE_SIGMA, ADAPTIVE_OFFSET = 41, 6.5, 2
EDGE_STRETCH, EDGE_CUT = (0.05, 0.99), 0.8
# Fixed value: added to the length of the parity product so that flat grids score zero.
PARITY_FLOOR = 1e-6


def image_quality(pixels: DataFrame, keys: Sequence[str], value: str, grad_weight: float, sat_weight: float, r: str = "r", c: str = "c") -> DataFrame:
    """Deviation + weighted mean |gx| + |gy| - weighted saturated share per frame."""
    v = F.col(value)
    g = nb.sobel(pixels, keys, value, r, c).groupBy(*keys).agg(F.avg(F.abs("gx") + F.abs("gy")).alias("grad"))
    s = pixels.groupBy(*keys).agg(F.stddev_pop(v).alias("contrast"), F.avg(((v <= SATURATED[0]) | (v >= SATURATED[1])).cast("double")).alias("sat"))
    d = _null_safe(s, g, keys, "inner")
    return d.withColumn("quality", F.col("contrast") + grad_weight * F.col("grad") - sat_weight * F.col("sat"))


def with_band(pixels: DataFrame, p: int, r: str = "r", c: str = "c") -> DataFrame:
    """Mosaic band ``band`` and super-pixel ``br, bc`` of each pixel."""
    rr, cc = F.col(r), F.col(c)
    return pixels.select("*", (F.pmod(rr, F.lit(p)) * p + F.pmod(cc, F.lit(p))).cast("int").alias("band"), F.floor(rr / p).cast("int").alias("br"), F.floor(cc / p).cast("int").alias("bc"))


def complete_blocks(pixels: DataFrame, keys: Sequence[str], p: int, r: str = "r", c: str = "c") -> DataFrame:
    """Pixels of whole p x p blocks only."""
    size = nb.frame_size(pixels, keys, r, c)
    d = _null_safe(pixels, size, keys, "inner")
    return d.where((F.col(r) < F.col("_nr") - F.pmod("_nr", F.lit(p))) & (F.col(c) < F.col("_nc") - F.pmod("_nc", F.lit(p)))).drop("_nr", "_nc")


def band_statistics(pixels: DataFrame, keys: Sequence[str], value: str, p: int, r: str = "r", c: str = "c") -> DataFrame:
    """Mean, median, max, min, range and deviation over the p x p bands of each super-pixel.

    A super-pixel has p * p values by construction, so ``median`` is bounded.
    """
    d = with_band(complete_blocks(pixels, keys, p, r=r, c=c), p, r, c)
    return d.groupBy(*keys, "br", "bc").agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("max"), F.min(value).alias("min"), (F.max(value) - F.min(value)).alias("range"), F.stddev_pop(value).alias("std")
    )


def band_contrast(pixels: DataFrame, keys: Sequence[str], value: str, p: int, r: str = "r", c: str = "c") -> DataFrame:
    """Bands ranked by deviation + 0.02 * range (larger band number first on a tie)."""
    d = with_band(complete_blocks(pixels, keys, p, r=r, c=c), p, r, c).groupBy(*keys, "band").agg((F.stddev_pop(value) + 0.02 * (F.max(value) - F.min(value))).alias("contrast"))
    w = Window.partitionBy(*keys).orderBy(F.desc("contrast"), F.desc("band"))
    return d.withColumn("rank", F.row_number().over(w))


def band_difference(pixels: DataFrame, keys: Sequence[str], value: str, p: int, r: str = "r", c: str = "c") -> DataFrame:
    """Normalised difference (a - b) / (a + b + 1) of the two bands with most contrast, per super-pixel."""
    top = band_contrast(pixels, keys, value, p, r, c).where("rank <= 2").groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col("band"))).alias("_b1"), F.max(F.when(F.col("rank") == 2, F.col("band"))).alias("_b2"))
    d = _null_safe(with_band(complete_blocks(pixels, keys, p, r=r, c=c), p, r, c), top, keys, "inner")
    pick = lambda b: F.max(F.when(F.col("band") == F.col(b), F.col(value).cast("double")))
    g = d.groupBy(*keys, "br", "bc").agg(pick("_b1").alias("a"), pick("_b2").alias("b"))
    return g.select(*keys, "br", "bc", ((F.col("a") - F.col("b")) / (F.col("a") + F.col("b") + 1.0)).alias("ndi"))


def band_pca(pixels: DataFrame, keys: Sequence[str], value: str, p: int, components: int = 3, r: str = "r", c: str = "c") -> DataFrame:
    """First principal components of the standardised bands per super-pixel.

    The (p*p) x (p*p) correlation sums are one row per frame; only they reach
    the eigenvector step.  Each vector's largest entry is made positive.
    """
    b = p * p
    d = with_band(complete_blocks(pixels, keys, p, r=r, c=c), p, r, c)
    wide = d.groupBy(*keys, "br", "bc").agg(*[F.max(F.when(F.col("band") == i, F.col(value).cast("double"))).alias(f"_v{i}") for i in range(b)])
    st = wide.groupBy(*keys).agg(*[F.avg(f"_v{i}").alias(f"_m{i}") for i in range(b)], *[F.stddev_pop(f"_v{i}").alias(f"_s{i}") for i in range(b)])
    z = _null_safe(wide, st, keys, "inner").select(*keys, "br", "bc", F.array(*[(F.col(f"_v{i}") - F.col(f"_m{i}")) / (F.col(f"_s{i}") + 1e-6) for i in range(b)]).alias("z"))
    cov = z.groupBy(*keys).agg(F.array(*[F.sum(F.get("z", F.lit(i)) * F.get("z", F.lit(j))) for i in range(b) for j in range(i, b)]).alias("_c"))

    @F.pandas_udf("array<array<double>>")
    def axes(cs: pd.Series) -> pd.Series:
        out, iu = [], np.triu_indices(b)
        for v in cs:
            m = np.zeros((b, b))
            m[iu] = v
            m = m + np.triu(m, 1).T
            e = np.linalg.eigh(m)[1][:, ::-1][:, :components].T
            e = e * np.sign(e[np.arange(len(e)), np.abs(e).argmax(1)])[:, None]
            out.append(e.tolist())
        return pd.Series(out)

    j = _null_safe(z, cov.select(*keys, axes("_c").alias("_e")), keys, "inner")
    dot = lambda e: F.aggregate(F.zip_with(e, F.col("z"), lambda a, v: a * v), F.lit(0.0), lambda s, v: s + v)
    return j.select(*keys, "br", "bc", *[dot(F.get("_e", F.lit(i))).alias(f"pc{i}") for i in range(components)])


def composites(pixels: DataFrame, frame: str, value: str, keys: Sequence[str] = (), r: str = "r", c: str = "c", min_frames: int = 2) -> DataFrame:
    """Median and mean over frames of equal shape per pixel; shapes seen in fewer frames are left out."""
    size = pixels.groupBy(*keys, frame).agg((F.max(r) + 1).alias("rows"), (F.max(c) + 1).alias("cols"))
    shapes = size.groupBy(*keys, "rows", "cols").agg(F.count(F.lit(1)).alias("frames")).where(F.col("frames") >= min_frames)
    good = size.join(shapes, [*keys, "rows", "cols"])
    d = pixels.join(good, [*keys, frame])
    q = exact_quantiles(d, [*keys, "rows", "cols", r, c], value, {"median": 0.5}, moments=True)
    return q.select(*keys, "rows", "cols", r, c, "median", "mean", "n")


def gradient_roi(pixels: DataFrame, keys: Sequence[str], value: str, grid: int = 4, top: int = 4, margin: float = 0.10, r: str = "r", c: str = "c") -> DataFrame:
    """Box around the blocks whose squared-gradient energy varies most; NULL if uninformative or blocks are under 8 px."""
    g = nb.sobel(pixels, keys, value, r, c)
    g = _null_safe(g, nb.frame_size(pixels, keys, r, c), keys, "inner")
    bh, bw = F.floor(F.col("_nr") / grid).cast("int"), F.floor(F.col("_nc") / grid).cast("int")
    g = g.withColumn("_bh", bh).withColumn("_bw", bw).where((F.col("_bh") >= 8) & (F.col("_bw") >= 8))
    g = g.withColumn("_i", F.floor(F.col(r) / F.col("_bh")).cast("int")).withColumn("_j", F.floor(F.col(c) / F.col("_bw")).cast("int")).where(f"_i < {grid} AND _j < {grid}")
    e = F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")
    b = g.groupBy(*keys, "_nr", "_nc", "_bh", "_bw", "_i", "_j").agg(F.var_pop(e).alias("_s"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_s"), F.desc("_i"), F.desc("_j"))
    b = b.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top)
    m = b.groupBy(*keys, "_nr", "_nc", "_bh", "_bw").agg(F.min("_i").alias("i0"), F.max("_i").alias("i1"), F.min("_j").alias("j0"), F.max("_j").alias("j1"))
    px, py = (F.col("_nc") * margin).cast("int"), (F.col("_nr") * margin).cast("int")
    x0, y0 = F.greatest(F.lit(0), F.col("j0") * F.col("_bw") - px), F.greatest(F.lit(0), F.col("i0") * F.col("_bh") - py)
    x1, y1 = F.least(F.col("_nc"), (F.col("j1") + 1) * F.col("_bw") + px), F.least(F.col("_nr"), (F.col("i1") + 1) * F.col("_bh") + py)
    ok = (x1 - x0) * (y1 - y0) <= 0.80 * F.col("_nr") * F.col("_nc")
    return m.select(*keys, *[F.when(ok, v).alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])


def repair_bad_pixels(pixels: DataFrame, keys: Sequence[str], value: str, factor: float = 6.0, r: str = "r", c: str = "c") -> DataFrame:
    """Pixels that differ from the 3 x 3 median by more than ``factor`` median deviations take that median."""
    m = nb.median3(pixels, keys, value, "_med", r, c)
    d = pixels.join(m, [*keys, r, c]).withColumn("_diff", F.abs(F.col(value) - F.col("_med")))
    d = attach_quantiles(d, keys, "_diff", {"_mad": 0.5})
    bad = F.col("_diff") > factor * (F.col("_mad") + 1e-6)
    return d.withColumn("bad", bad).withColumn(value, F.when(F.col("bad"), F.col("_med")).otherwise(F.col(value))).drop("_med", "_diff", "_mad")


def destripe(pixels: DataFrame, keys: Sequence[str], value: str, r: str = "r", c: str = "c") -> DataFrame:
    """Subtract column medians, then row medians, each time restoring the frame's median level."""
    d = pixels.withColumn(value, F.col(value).cast("double"))
    for axis in (c, r):
        d = attach_quantiles(d, [*keys, axis], value, {"_line": 0.5}, settle=True)
        d = attach_quantiles(d, keys, value, {"_all": 0.5}, settle=True)
        d = d.withColumn(value, F.col(value) - F.col("_line") + F.col("_all")).drop("_line", "_all")
    return d


def parity_score(cells: DataFrame, keys: Sequence[str], i: str, j: str, mean: str) -> DataFrame:
    """|correlation| of inner-cell means with the checker parity, and 100 * corr + 0.25 * level difference.

    The parity is +1 / -1 and is not centred, so grids with an odd number of cells differ from a textbook correlation.
    """
    sign = F.when(F.pmod(F.col(i) + F.col(j), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    g = cells.withColumn("_p", sign).groupBy(*keys).agg(
        F.abs(F.sum(F.col(mean) * F.col("_p")) - F.avg(mean) * F.sum("_p")).alias("_d"), (F.sqrt(F.var_pop(mean) * F.count(mean) * F.count(mean)) + PARITY_FLOOR).alias("_l"), F.abs(F.avg(F.when(F.col("_p") > 0, F.col(mean))) - F.avg(F.when(F.col("_p") < 0, F.col(mean)))).alias("diff")
    )
    return g.withColumn("corr", F.col("_d") / F.col("_l")).drop("_d", "_l").withColumn("score", 100.0 * F.col("corr") + 0.25 * F.col("diff"))


def inner_cell_means(pixels: DataFrame, cands: DataFrame, keys: Sequence[str], value: str, bucket: int = 32, margin: float = 0.18, r: str = "r", c: str = "c") -> DataFrame:
    """Mean of the inner part of every cell of candidate grids (``cand, x0, y0, w, h, nx, ny``; w, h per cell).

    A candidate is registered in every pixel bucket its box touches, so pixels
    meet only the candidates near them.
    """
    span = lambda a, n, s: F.sequence(F.floor(F.col(a) / bucket).cast("int"), F.floor((F.col(a) + F.col(n) * F.col(s)) / bucket).cast("int"))
    reg = cands.withColumn("_bx", F.explode(span("x0", "nx", "w"))).withColumn("_by", F.explode(span("y0", "ny", "h")))
    p = pixels.withColumn("_bx", F.floor(F.col(c) / bucket).cast("int")).withColumn("_by", F.floor(F.col(r) / bucket).cast("int"))
    j = p.join(reg, [*keys, "_bx", "_by"])
    u, v = (F.col(c) + 0.5 - F.col("x0")) / F.col("w"), (F.col(r) + 0.5 - F.col("y0")) / F.col("h")
    j = j.withColumn("ci", F.floor(v).cast("int")).withColumn("cj", F.floor(u).cast("int"))
    inner = (u - F.col("cj")).between(margin, 1 - margin) & (v - F.col("ci")).between(margin, 1 - margin) & F.col("ci").between(0, F.col("ny") - 1) & F.col("cj").between(0, F.col("nx") - 1)
    return j.where(inner).groupBy(*keys, "cand", "ci", "cj").agg(F.avg(value).alias("mean"))


def threshold_variants(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Candidate masks as flags: Otsu hot/cold and hot/cold percentile cuts (60, 70, 80)."""
    from sensorlake.operators.rasterize import otsu

    d = _null_safe(pixels, otsu(pixels, keys, value).withColumnRenamed("threshold", "_t"), keys, "inner")
    cuts = {f"_p{p}": p / 100 for p in (20, 30, 40, 60, 70, 80)}
    d = attach_quantiles(d, keys, value, cuts)
    v = F.col(value)
    out: dict[str, Column] = {"otsu_hot": v > F.col("_t"), "otsu_cold": v <= F.col("_t")}
    for p in (60, 70, 80):
        out[f"hot_{p}"] = v >= F.col(f"_p{p}")
        out[f"cold_{p}"] = v <= F.col(f"_p{100 - p}")
    return d.select(*pixels.columns, *[e.alias(n) for n, e in out.items()])


def mask_variants(pixels: DataFrame, keys: Sequence[str], value: str, r: str = "r", c: str = "c") -> DataFrame:
    """All candidate masks of a dense frame of 0..255, as flags per cell of ``keys, r, c``.

    The frame is blurred and rounded first. ``otsu_*``, ``hot_*`` / ``cold_*`` cut
    it at one level per frame (percentiles lose their fraction), ``adaptive_*`` at the weighted mean of the block around each
    cell, edge cells repeated, ``edge`` at the percentile of the stretched gradient.
    Frames no larger than the block have no adaptive mask (NULL). Cells without a value count as no part of the frame.
    """
    from sensorlake.operators.rasterize import otsu, robust_stretch

    at = [*keys, r, c]
    given = pixels.where(F.col(value).isNotNull()).select(*at, F.col(value).alias("_v"))
    half_up = lambda v: F.floor(v + 0.5).cast("int")
    # Three kernels start from the blurred frame: it is written once.
    b = cut_lineage(nb.convolve(given, keys, "_v", BLUR5, BLUR5, "_b", r, c).select(*at, half_up(F.col("_b")).alias("_b")))
    block = nb.gaussian_kernel(ADAPTIVE_SIGMA, ADAPTIVE_BLOCK // 2)
    mean = nb.convolve(b, keys, "_b", block, block, "_mean", r, c, repeat=True)
    slope = lambda row, col, name: nb.convolve(b, keys, "_b", row, col, name, r, c)
    gradient = _null_safe(slope(nb.SMOOTH3, nb.DIFF3, "_gx"), slope(nb.DIFF3, nb.SMOOTH3, "_gy"), at, "inner")
    gradient = robust_stretch(gradient.select(*at, (F.abs("_gx") + F.abs("_gy")).alias("_g")), keys, "_g", *EDGE_STRETCH, "_u")
    gradient = attach_quantiles(gradient, keys, "_u", {"_edge": EDGE_CUT}).select(*at, "_u", "_edge")

    levels = exact_quantiles(b, keys, "_b", {f"_p{p}": p / 100 for p in sorted({*MASK_CUTS, *(100 - p for p in MASK_CUTS)})})
    per_frame = [otsu(b, keys, "_b").withColumnRenamed("threshold", "_t"), levels, nb.frame_size(b, keys, r, c)]
    d = _null_safe(_null_safe(b, mean, at, "inner"), gradient, at, "inner")
    for t in per_frame:
        d = _null_safe(d, t, keys, "inner")
    v = F.col("_b")
    whole = lambda name: F.floor(F.col(name)).cast("int")
    out: dict[str, Column] = {"otsu_hot": v > F.col("_t"), "otsu_cold": v <= F.col("_t")}
    for p in MASK_CUTS:
        out[f"hot_{p}"] = v >= whole(f"_p{p}")
        out[f"cold_{100 - p}"] = v <= whole(f"_p{100 - p}")
    above = v > half_up(F.col("_mean")) - ADAPTIVE_OFFSET
    large = F.least("_nr", "_nc") > ADAPTIVE_BLOCK
    out["adaptive_hot"], out["adaptive_cold"] = F.when(large, above), F.when(large, ~above)
    out["edge"] = F.col("_u") >= whole("_edge")
    return d.select(*at, *[e.alias(n) for n, e in out.items()])
