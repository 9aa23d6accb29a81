"""Pairing corner grids of two cameras and transforms between consecutive frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.geometry import constrain_pair, grid_at, h_apply


def subgrid_options(a: DataFrame, b: DataFrame, label: str, min_common: tuple[int, int]) -> DataFrame:
    """All placements of the common pattern inside both grids of a label.

    ``a`` and ``b`` have ``cols, rows, corners``.  One row per option with its
    position in offset order (``opt``), the offsets and the common size; the
    number of options is bounded by the pattern sizes.
    """
    l = a.select(label, F.col("cols").alias("ac"), F.col("rows").alias("ar"), F.col("corners").alias("ag"))
    r = b.select(label, F.col("cols").alias("bc"), F.col("rows").alias("br"), F.col("corners").alias("bg"))
    d = l.join(r, label).withColumn("cc", F.least("ac", "bc")).withColumn("cr", F.least("ar", "br"))
    d = d.where((F.col("cc") >= min_common[0]) & (F.col("cr") >= min_common[1]))
    for name, full, common in (("ar0", "ar", "cr"), ("ac0", "ac", "cc"), ("br0", "br", "cr"), ("bc0", "bc", "cc")):
        d = d.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(full) - F.col(common))))
    base = F.greatest(F.lit(64), "ar", "ac", "br", "bc").cast("bigint")
    opt = ((F.col("ar0") * base + F.col("ac0")) * base + F.col("br0")) * base + F.col("bc0")
    return d.withColumn("opt", opt)


def subgrid_pairs(options: DataFrame, label: str) -> DataFrame:
    """Corner correspondences ``sx, sy, dx, dy`` of every option, ``corner`` numbering the common grid."""
    d = options.withColumn("corner", F.explode(F.sequence(F.lit(0), F.col("cc") * F.col("cr") - 1)))
    r, c = F.floor(F.col("corner") / F.col("cc")).cast("int"), F.pmod("corner", "cc")
    s = grid_at(F.col("ag"), F.col("ac"), F.col("ar0") + r, F.col("ac0") + c)
    t = grid_at(F.col("bg"), F.col("bc"), F.col("br0") + r, F.col("bc0") + c)
    return d.select(label, "opt", "ac0", "ar0", "bc0", "br0", "cc", "cr", "corner", s["x"].alias("sx"), s["y"].alias("sy"), t["x"].alias("dx"), t["y"].alias("dy"))


# Smallest inlier counts of the colour and the soil match, and
# the fixed shift used when nothing matched, as a share of the frame height.
MIN_COLOUR_INLIERS = 25
MIN_SOIL_INLIERS = 18
FALLBACK_SHIFT = {"multisensor": -0.28, "plot": -0.18}


def pair_transform(pairs: DataFrame, width: int, height: int, mode: str, product: str = "multisensor") -> DataFrame:
    """First usable match of each frame pair: colour, soil, aligned, phase, else the fixed shift.

    ``pairs`` carries given match results ``h_rgb, n_rgb, h_soil, n_soil,
    h_ecc, h_phase``.  Adds ``h`` and ``method``.
    """
    shift = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, FALLBACK_SHIFT[product] * height, 0.0, 0.0, 1.0)])
    steps = [
        ("rgb_feature", "h_rgb", F.col("n_rgb") >= MIN_COLOUR_INLIERS),
        ("soil_feature", "h_soil", F.col("n_soil") >= MIN_SOIL_INLIERS),
        ("rgb_ecc", "h_ecc", F.lit(True)),
        ("rgb_phase", "h_phase", F.lit(True)),
    ]
    pick = lambda value, other: F.coalesce(*[F.when(F.col(h).isNotNull() & ok, value(n, h)) for n, h, ok in steps], other)
    d = pairs.withColumn("method", pick(lambda n, _: F.lit(f"{n}_{mode}"), F.lit("fallback_translation")))
    return d.withColumn("h", pick(lambda _, h: constrain_pair(F.col(h), width, height, mode), shift))


def canvas(transforms: DataFrame, keys: Sequence[str], h: str, width: int, height: int, pad: int = 120) -> DataFrame:
    """Shift and size of the canvas that holds every transformed frame, with padding."""
    pts = [h_apply(F.col(h), F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (width, 0), (width, height), (0, height))]
    lo = lambda i: F.least(*[p[i] for p in pts])
    hi = lambda i: F.greatest(*[p[i] for p in pts])
    g = transforms.groupBy(*keys).agg(F.floor(F.min(lo(0))).cast("int").alias("x0"), F.floor(F.min(lo(1))).cast("int").alias("y0"), F.ceil(F.max(hi(0))).cast("int").alias("x1"), F.ceil(F.max(hi(1))).cast("int").alias("y1"))
    return g.select(*keys, (pad - F.col("x0")).alias("tx"), (pad - F.col("y0")).alias("ty"), (F.col("x1") - F.col("x0") + 2 * pad).alias("width"), (F.col("y1") - F.col("y0") + 2 * pad).alias("height"))


def crop_edges(n: Column, lo: float, hi: float, rounding: str) -> tuple[Column, Column]:
    """Crop limits as shares of a size: rounded half to even (``gallery``) or truncated (``plot``)."""
    to = (lambda v: F.bround(v).cast("int")) if rounding == "gallery" else (lambda v: v.cast("int"))
    return to(n * lo), to(n * hi)


def overlay_metrics(points: DataFrame, keys: Sequence[str], u: str, v: str, box: str) -> DataFrame:
    """Projected count, share inside the checker box, and offset of the median from its centre."""
    from sensorlake.operators.ordered import _null_safe
    from sensorlake.operators.quantiles import exact_quantiles

    inside = F.col(u).between(F.col(f"{box}.x0"), F.col(f"{box}.x1")) & F.col(v).between(F.col(f"{box}.y0"), F.col(f"{box}.y1"))
    g = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("inside"),
        F.max((F.col(f"{box}.x0") + F.col(f"{box}.x1")) / 2).alias("_cx"), F.max((F.col(f"{box}.y0") + F.col(f"{box}.y1")) / 2).alias("_cy"),
    )
    for c, n in ((u, "_mu"), (v, "_mv")):
        g = _null_safe(g, exact_quantiles(points, keys, c, {n: 0.5}), keys, "left")
    return g.select(*keys, "n", "inside", (F.col("_mu") - F.col("_cx")).alias("du"), (F.col("_mv") - F.col("_cy")).alias("dv"))
