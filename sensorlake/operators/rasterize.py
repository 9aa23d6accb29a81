"""Points to cells: surfaces, densities, z-buffers, fusion, painting and blending.

All reductions are ordinary aggregates with map-side combining, so a cell or
frame that holds a large share of the points is reduced before the shuffle.
Payload travels in the ordered struct; arrival order (``tie`` columns) decides
equal keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.color import clip, stretch_u8
from sensorlake.operators.ordered import ROWS_PER_CHUNK, _null_safe
from sensorlake.operators.quantiles import attach_quantiles, exact_quantiles


def raster_meta(points: DataFrame, res: float, x: str = "x", y: str = "y", pad_cells: float = 2.0) -> DataFrame:
    """One row ``emin, emax, nmin, nmax, res, width, height`` from the extent of the points."""
    pad = res * pad_cells
    b = points.agg(
        (F.min(x) - pad).alias("emin"), (F.max(x) + pad).alias("emax"), (F.min(y) - pad).alias("nmin"), (F.max(y) + pad).alias("nmax")
    )
    size = lambda a, z: F.greatest(F.lit(1), F.ceil((F.col(z) - F.col(a)) / F.lit(res)).cast("int"))
    return b.select("*", F.lit(res).alias("res"), size("emin", "emax").alias("width"), size("nmin", "nmax").alias("height"))


def with_cells(points: DataFrame, meta: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``row`` (from the north edge) and ``col``, truncated and clipped to the raster."""
    d = points.withColumn("_m", meta.select(F.struct(*meta.columns)).scalar())
    m = F.col("_m")

    def at(v: Column, n: Column) -> Column:
        return F.least(F.greatest((v / m["res"]).cast("int"), F.lit(0)), n - 1)

    row, col = at(m["nmax"] - F.col(y), m["height"]), at(F.col(x) - m["emin"], m["width"])
    return d.select(*points.columns, row.alias("row"), col.alias("col"))


def surface_max(points: DataFrame, cell: Sequence[str], z: str, tie: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Highest point of each cell (the last to arrive on a tie) with its payload and the density."""
    top = F.max(F.struct(F.col(z).alias("_z"), *tie, *payload))
    g = points.groupBy(*cell).agg(top.alias("_t"), F.count(F.lit(1)).alias("n"))
    return g.select(*cell, F.col("_t._z").alias(z), *[F.col(f"_t.{p}").alias(p) for p in payload], "n")


def surface_p95(
    points: DataFrame, cell: Sequence[str], z: str, tie: Sequence[str], payload: Sequence[str], prob: float = 0.95, min_points: int = 4, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Per cell the *measured* point nearest to the z percentile; small cells take the highest point."""
    q = exact_quantiles(points, cell, z, {"_q": prob}, rows_per_chunk)
    d = _null_safe(points.select(*cell, z, *tie, *payload), q, cell, "inner")
    near = F.min(F.struct(F.abs(F.col(z) - F.col("_q")).alias("_d"), F.col(z).alias("_z"), *tie, *payload))
    top = F.max(F.struct(F.col(z).alias("_z"), *tie, *payload))
    g = d.groupBy(*cell).agg(near.alias("_n"), top.alias("_t"), F.count(F.lit(1)).alias("_c"))
    pick = lambda f: F.when(F.col("_c") >= min_points, F.col(f"_n.{f}")).otherwise(F.col(f"_t.{f}"))
    return g.select(*cell, pick("_z").alias(z), *[pick(p).alias(p) for p in payload], F.col("_c").alias("n"))


def topdown_max(points: DataFrame, cell: Sequence[str], intensity: str, height: str) -> DataFrame:
    """Independent maxima of intensity and height (never below 0), count and support."""
    zero = F.lit(0.0)
    return points.groupBy(*cell).agg(
        F.greatest(F.max(intensity), zero).alias(intensity),
        F.greatest(F.max(height), zero).alias(height),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("support", F.col("n") > 0)


def zbuffer(points: DataFrame, pixel: Sequence[str], depth: str, tie: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Nearest point per pixel with its payload."""
    near = F.min(F.struct(F.col(depth).alias("_d"), *tie, *payload))
    return points.groupBy(*pixel).agg(near.alias("_n")).select(*pixel, F.col("_n._d").alias(depth), *[f"_n.{p}" for p in payload])


def fuse_sweeps(sweeps: DataFrame, pixel: Sequence[str], depth: str, height: str, intensity: str, support: str | None = None) -> DataFrame:
    """Over sweeps: smallest depth, largest height and intensity, any support."""
    s = F.col(support) if support else F.lit(True)
    return sweeps.groupBy(*pixel).agg(F.min(depth).alias(depth), F.max(height).alias(height), F.max(intensity).alias(intensity), F.max(s).alias("support"))


def centre_score(u: Column, v: Column, box: tuple[float, float, float, float]) -> Column:
    """Preference for observations near the centre of the view box: 0 at the centre, negative outwards."""
    x0, y0, x1, y1 = box
    sx, sy = max((x1 - x0) * 0.35, 1.0), max((y1 - y0) * 0.35, 1.0)
    a, b = (u - (x0 + x1) * 0.5) / sx, (v - (y0 + y1) * 0.5) / sy
    return -(a * a + b * b)


def best_view(views: DataFrame, cell: Sequence[str], score: str, frame: str, tie: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Per cell the view with the greatest score; the first frame wins a tie."""
    pick = F.min(F.struct((-F.col(score)).alias("_s"), F.col(frame).alias("_f"), *tie, *payload))
    return views.groupBy(*cell).agg(pick.alias("_b")).select(*cell, (-F.col("_b._s")).alias(score), F.col("_b._f").alias(frame), *[f"_b.{p}" for p in payload])


def weighted_blend(samples: DataFrame, cell: Sequence[str], values: Sequence[str], weight: str, eps: float = 1e-3, min_weight: float = 0.05) -> DataFrame:
    """Weighted mean of each value, and whether enough weight reached the cell."""
    w = F.col(weight)
    g = samples.groupBy(*cell).agg(F.sum(w).alias("weight"), *[F.sum(w * F.col(v)).alias(f"_s_{v}") for v in values])
    return g.select(
        *cell, *[(F.col(f"_s_{v}") / F.greatest("weight", F.lit(eps))).alias(v) for v in values], "weight", (F.col("weight") > min_weight).alias("valid")
    )


def max_blend(samples: DataFrame, cell: Sequence[str], values: Sequence[str], valid: str) -> DataFrame:
    """Maximum of each value over valid samples."""
    return samples.where(valid).groupBy(*cell).agg(*[F.max(v).alias(v) for v in values])


def balance_channels(pixels: DataFrame, frame: str, channels: Sequence[str], reference: Column) -> DataFrame:
    """Match mean and deviation of every frame to the reference frame (gain within 0.75..1.35)."""
    stats = pixels.groupBy(frame).agg(*[f(c).alias(f"_{n}_{c}") for c in channels for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    ref = stats.where(reference).select(F.struct(*[c for c in stats.columns if c != frame]).alias("r")).scalar()
    d = _null_safe(pixels, stats.withColumn("_r", ref), [frame], "inner")
    out = []
    for c in channels:
        gain = clip(F.col(f"_r._s_{c}") / F.greatest(F.col(f"_s_{c}"), F.lit(1.0)), 0.75, 1.35)
        out.append(clip((F.col(c) - F.col(f"_m_{c}")) * gain + F.col(f"_r._m_{c}"), 0.0, 255.0).cast("int").alias(c))
    return d.select(*[c for c in pixels.columns if c not in channels], *out)


def middle_frame(frames: DataFrame, frame: str) -> Column:
    """Scalar: the frame in the middle of the frame order (position n div 2)."""
    from sensorlake.operators.ordered import running_index

    d = running_index(frames.select(frame).distinct(), [], [frame], "_i", "_n")
    return d.where("_i = _n div 2").select(frame).scalar()


def voxel_first(points: DataFrame, keys: Sequence[str], xyz: Sequence[str], size: float, tie: Sequence[str], payload: Sequence[str] = ()) -> DataFrame:
    """First point per voxel of edge ``size``."""
    v = [F.floor(F.col(c) / F.lit(size)).cast("bigint").alias(f"v{c}") for c in xyz]
    first = F.min(F.struct(*tie, *xyz, *payload))
    return points.groupBy(*keys, *v).agg(first.alias("_f")).select(*keys, *[f"v{c}" for c in xyz], *[f"_f.{c}" for c in (*tie, *xyz, *payload)])


def robust_stretch(
    df: DataFrame, keys: Sequence[str], value: str, lo: float = 0.01, hi: float = 0.99, name: str = "u8", rows_per_chunk: int = ROWS_PER_CHUNK, slack: float = 0.0
) -> DataFrame:
    """Percentile stretch of ``value`` to 0..255 per key; ``slack`` as for ``stretch_u8``."""
    d = attach_quantiles(df, keys, value, {"_lo": lo, "_hi": hi}, rows_per_chunk)
    return d.withColumn(name, stretch_u8(F.col(value).cast("double"), F.col("_lo"), F.col("_hi"), slack)).drop("_lo", "_hi")


def zscore_stretch(df: DataFrame, keys: Sequence[str], value: str, name: str = "u8", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Standardise per key, then stretch between the 0.5 and 99.5 percentiles.

    Standard scores carry rounding errors that depend on the order of summing,
    so a value on a whole step, or 1e-9 below, takes that step.
    """
    s = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    d = _null_safe(df, s, keys, "inner").withColumn("_z", (F.col(value) - F.col("_m")) / (F.col("_s") + 1e-6))
    return robust_stretch(d, keys, "_z", 0.005, 0.995, name, rows_per_chunk, 1e-9).drop("_z", "_m", "_s")


def relative_height(cells: DataFrame, z: str, prob: float = 0.05, keys: Sequence[str] = (), rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``z`` minus its low percentile over all cells (ground level)."""
    d = attach_quantiles(cells, keys, z, {"ground": prob}, rows_per_chunk)
    return d.withColumn("height", F.col(z) - F.col("ground"))


def otsu(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """Otsu threshold of an integer value in 0..bins-1 per key (first maximum wins)."""
    from pyspark.sql.window import Window

    h = df.groupBy(*keys, F.col(value).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = h.select(
        *keys, "bin", F.sum("c").over(upto).alias("w0"), F.sum(F.col("c") * F.col("bin")).over(upto).alias("s0"),
        F.sum("c").over(whole).alias("n"), F.sum(F.col("c") * F.col("bin")).over(whole).alias("s"),
    )
    w1 = F.col("n") - F.col("w0")
    d = F.col("s0") / F.col("w0") - F.when(w1 > 0, (F.col("s") - F.col("s0")) / w1)
    between = F.coalesce(F.col("w0") * w1 * d * d, F.lit(0.0))
    best = F.max(F.struct(between.alias("b"), (-F.col("bin")).alias("o")))
    return h.groupBy(*keys).agg(best.alias("_b")).select(*keys, (-F.col("_b.o")).alias("threshold"))


def cover(pixels: DataFrame, keys: Sequence[str], mask: Mapping[str, Column]) -> DataFrame:
    """Percentage of pixels per key for which each mask holds, rounded to 2 places."""
    return pixels.groupBy(*keys).agg(*[F.round(F.avg(F.coalesce(m, F.lit(False)).cast("double")) * 100.0, 2).alias(n) for n, m in mask.items()])
