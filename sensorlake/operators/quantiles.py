"""Exact percentiles that never gather a group's values in one task.

``percentile`` keeps every distinct value of a group in the final aggregation
buffer.  Here values are first counted (map-side combined), then ranked by a
chunked running sum, and only the few values around each requested rank remain.
Linear interpolation between neighbouring ranks, as ``percentile`` does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.operators.ordered import ROWS_PER_CHUNK, _null_safe, running_sums
from sensorlake.session import cut_lineage


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    rows_per_chunk: int = ROWS_PER_CHUNK,
    moments: bool = False,
) -> DataFrame:
    """One row per key with a DOUBLE column per entry of ``probs``; NULL and NaN values are ignored.

    ``moments`` adds ``n, mean, max, rms`` from the same counted values.
    """
    x = F.col(value).cast("double")
    seen = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, (x + F.lit(0.0)).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sums(seen, keys, ["_x"], {"_cum": F.col("_c")}, {"_cum": "_n"}, rows_per_chunk, keep=F.col("_c"))
    cells = []
    for i, p in enumerate(probs.values()):
        rank = (F.col("_n") - 1) * F.lit(float(p))
        cells += [_at(F.floor(rank)).alias(f"_lo{i}"), _at(F.ceil(rank)).alias(f"_hi{i}")]
    if moments:
        c, v = F.col("_c"), F.col("_x")
        cells += [(F.sum(c * v) / F.sum(c)).alias("mean"), F.max(v).alias("max"), F.sqrt(F.sum(c * v * v) / F.sum(c)).alias("rms")]
    got = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *cells)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        rank = (F.col("_n") - 1) * F.lit(float(p))
        part = rank - F.floor(rank)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(F.when(part == 0, lo).otherwise(lo + part * (hi - lo)).alias(name))
    more = [F.col("_n").alias("n"), "mean", "max", "rms"] if moments else []
    return got.select(*keys, *out, *more)


def _at(rank: Column) -> Column:
    inside = (F.col("_cum") > rank) & (F.col("_cum") - F.col("_c") <= rank)
    return F.max(F.when(inside, F.col("_x")))


def attach_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    rows_per_chunk: int = ROWS_PER_CHUNK,
    settle: bool = False,
) -> DataFrame:
    """Every row of ``df`` with its key's quantiles; one global row goes in as a scalar subquery.

    ``settle`` writes the one-row-per-key table to the checkpoint folder, so
    that later steps on the result do not compute it again.
    """
    q = exact_quantiles(df, keys, value, probs, rows_per_chunk)
    if settle:
        q = cut_lineage(q)
    if keys:
        return _null_safe(df, q, keys, "left")
    one = q.select(F.struct(*probs).alias("q")).scalar()
    return df.withColumn("_q", one).select(*df.columns, *[F.col(f"_q.{n}").alias(n) for n in probs])
