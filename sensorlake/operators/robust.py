"""Residual statistics and outlier rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.operators.ordered import ROWS_PER_CHUNK, _null_safe
from sensorlake.operators.quantiles import attach_quantiles, exact_quantiles


def residual_metrics(df: DataFrame, keys: Sequence[str], error: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``n, mean, median, p90, max, rms`` of ``error`` per key."""
    q = exact_quantiles(df, keys, error, {"median": 0.5, "p90": 0.9}, rows_per_chunk, moments=True)
    return q.select(*keys, "n", "mean", "median", "p90", "max", "rms")


# Threshold rules for the robust masks, as functions of the
# median m, sigma s = 1.4826 * MAD (population deviation when the MAD vanishes).
MAD_TO_SIGMA = 1.4826
MAD_EPS = 1e-9


def view_rule(m: Column, s: Column) -> Column:
    """Limit for mean view errors of the colour camera, in pixels."""
    return F.greatest(F.lit(3.0), m + 3.0 * s, 3.0 * m)


def calibration_rule(m: Column, s: Column) -> Column:
    """Limit for view errors in the assembled package, in pixels."""
    return F.greatest(F.lit(3.0), 2.8 * m, m + 3.0 * s)


def strict_rule(m: Column, s: Column) -> Column:
    """Limit for view errors of the per-session calibration, in pixels."""
    return F.greatest(F.lit(1.5), 2.5 * m, m + 3.0 * s)


def robust_mask(
    df: DataFrame,
    keys: Sequence[str],
    error: str,
    rule=view_rule,
    max_error: str | None = None,
    min_keep: int = 0,
    tie: Sequence[str] = (),
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add ``median, sigma, limit, keep`` per key.

    A row is kept when its error is within the rule's limit and, if
    ``max_error`` is given, that column is at most ``max(10, 5 * median)``.
    Keys left with fewer than ``min_keep`` rows keep their best ``min_keep``.
    """
    e = F.col(error).cast("double")
    d = attach_quantiles(df, keys, error, {"median": 0.5}, rows_per_chunk, settle=True)
    d = d.withColumn("_dev", F.abs(e - F.col("median")))
    d = attach_quantiles(d, keys, "_dev", {"_mad": 0.5}, rows_per_chunk, settle=bool(min_keep))
    std = df.groupBy(*keys).agg(F.stddev_pop(e).alias("_std"))
    d = _null_safe(d, std, keys, "left") if keys else d.withColumn("_std", std.select("_std").scalar())
    d = d.withColumn("sigma", F.when(F.col("_mad") * MAD_TO_SIGMA > MAD_EPS, F.col("_mad") * MAD_TO_SIGMA).otherwise(F.col("_std")))
    d = d.withColumn("limit", rule(F.col("median"), F.col("sigma")))
    keep = F.coalesce(e <= F.col("limit"), F.lit(False))
    if max_error:
        keep = keep & F.coalesce(F.col(max_error) <= F.greatest(F.lit(10.0), 5.0 * F.col("median")), F.lit(False))
    d = d.withColumn("keep", keep)
    if min_keep:
        d = _keep_best(d, keys, error, min_keep, tie)
    return d.select(*df.columns, "median", "sigma", "limit", "keep")


def _keep_best(d: DataFrame, keys: Sequence[str], error: str, k: int, tie: Sequence[str]) -> DataFrame:
    """Replace ``keep`` by "among the k best" where a key keeps fewer than k rows."""
    kept = d.groupBy(*keys).agg(F.count_if("keep").alias("_kept"))
    d = _null_safe(d, kept, keys, "left") if keys else d.withColumn("_kept", kept.select("_kept").scalar())
    w = Window.partitionBy(*[F.col(c) for c in keys]).orderBy(F.asc_nulls_last(error), *tie)
    short = d.select(*keys, error, *tie).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    edge = short.groupBy(*keys).agg(F.max(F.struct(F.col(error), *[F.col(t) for t in tie])).alias("_edge"))
    d = _null_safe(d, edge, keys, "left") if keys else d.withColumn("_edge", edge.select("_edge").scalar())
    among = F.struct(F.col(error), *[F.col(t) for t in tie]) <= F.col("_edge")
    return d.withColumn("keep", F.when(F.col("_kept") < k, among).otherwise(F.col("keep")))


def pose_gate(df: DataFrame, keys: Sequence[str], rms: str, angle: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    """Keep poses with rms <= max(0.06, 3 * median) and angle <= 30 degrees, else the ``k`` best."""
    d = attach_quantiles(df, keys, rms, {"median": 0.5}, settle=True)
    ok = (F.col(rms) <= F.greatest(F.lit(0.06), 3.0 * F.col("median"))) & (F.col(angle) <= 30.0)
    d = _keep_best(d.withColumn("keep", F.coalesce(ok, F.lit(False))), keys, rms, k, tie)
    return d.select(*df.columns, "median", "keep")
