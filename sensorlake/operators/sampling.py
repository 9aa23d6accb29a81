"""Choosing frames and points: every n-th, evenly spread, around the middle, windows, bounded subsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.operators.ordered import ROWS_PER_CHUNK, _null_safe, running_index, running_sums


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, name: str = "idx", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Rows whose running index in the key is a multiple of ``n``; the index is kept as ``name``."""
    return running_index(df, keys, order, name, rows_per_chunk=rows_per_chunk).where(F.pmod(F.col(name), F.lit(max(1, n))) == 0)


def spread_positions(n: Column, k: int, drop_ends: bool = False) -> Column:
    """ARRAY<BIGINT> of ``k`` evenly spread positions in 0..n-1, truncated (ends dropped on request)."""
    m = k + 2 if drop_ends else k
    last = (n - 1).cast("double")
    step = last / F.lit(float(max(1, m - 1)))
    picks = range(1, m - 1) if drop_ends else range(m)
    cells = [F.when(F.lit(i == m - 1 and m > 1), n - 1).otherwise(F.floor(step * F.lit(float(i)))).cast("bigint") for i in picks]
    return F.array(*cells)


def evenly_spaced(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, drop_ends: bool = False, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """About ``k`` evenly spread rows per key; keys with at most ``k`` rows stay whole."""
    d = running_index(df, keys, order, "idx", "_n", rows_per_chunk)
    hit = F.array_contains(spread_positions(F.col("_n"), k, drop_ends), F.col("idx"))
    return d.where((F.col("_n") <= k) | hit).drop("_n")


def centre_out(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    k: int,
    offsets: Sequence[int] = (0, -1, 1, -2, 2),
    with_ends: bool = True,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """The first ``k`` distinct positions of: middle + offsets, the two ends, an even spread."""
    d = running_index(df, keys, order, "idx", "_n", rows_per_chunk)
    n = F.col("_n")
    mid = F.call_function("div", n, F.lit(2).cast("bigint"))
    wanted = F.array(*[mid + o for o in offsets], *([F.lit(0).cast("bigint"), n - 1] if with_ends else []))
    m = F.least(F.lit(k), n)
    step = (n - 1).cast("double") / F.greatest(m - 1, F.lit(1)).cast("double")
    spread = F.transform(F.sequence(F.lit(0).cast("bigint"), m - 1), lambda i: F.when((i == m - 1) & (m > 1), n - 1).otherwise(F.floor(step * i)).cast("bigint"))
    seq = F.array_distinct(F.filter(F.concat(wanted, spread), lambda i: (i >= 0) & (i < n)))
    pos = F.array_position(seq, F.col("idx"))
    return d.withColumn("pick", pos).where((F.col("pick") >= 1) & (F.col("pick") <= k)).drop("_n")


def middle_window(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, stride: int = 1, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """``k`` rows around the middle of each key, contiguous or with a stride."""
    d = running_index(df, keys, order, "idx", "_n", rows_per_chunk)
    mid = F.call_function("div", F.col("_n"), F.lit(2).cast("bigint"))
    start = F.greatest(mid - (k // 2) * stride, F.lit(0).cast("bigint"))
    rel = F.col("idx") - start
    inside = (rel >= 0) & (rel < k * stride) & (F.pmod(rel, F.lit(stride)) == 0)
    return d.where((F.lit(stride == 1) & (F.col("_n") <= k)) | inside).drop("_n")


def stream_bounds(df: DataFrame, keys: Sequence[str], ts: str = "ts_ns") -> DataFrame:
    """First and last stamp per key."""
    return df.groupBy(*keys).agg(F.min(ts).alias("start_ns"), F.max(ts).alias("end_ns"))


def target_times(bounds: DataFrame, k: int) -> DataFrame:
    """``k`` inner instants between ``start_ns`` and ``end_ns`` (the midpoint if ``k`` <= 1), in whole ns."""
    span = F.col("end_ns") - F.col("start_ns")
    if k <= 1:
        half = F.call_function("div", F.col("start_ns") + F.col("end_ns"), F.lit(2).cast("bigint"))
        return bounds.withColumn("target", F.lit(0)).withColumn("ts_ns", half)
    i = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_i")
    d = bounds.select("*", i)
    t = F.col("start_ns") + F.call_function("div", span, F.lit(k + 1).cast("bigint")) * F.col("_i")
    rest = F.call_function("div", F.pmod(span, F.lit(k + 1).cast("bigint")) * F.col("_i"), F.lit(k + 1).cast("bigint"))
    return d.withColumn("target", (F.col("_i") - 1).cast("int")).withColumn("ts_ns", t + rest).drop("_i")


def window_centres(bounds: DataFrame, windows: int, half_ns: int) -> DataFrame:
    """``windows`` evenly spread window centres that keep ``half_ns`` distance from both ends."""
    lo, hi = F.col("start_ns") + half_ns, F.col("end_ns") - half_ns
    if windows <= 1:
        mid = F.call_function("div", F.col("start_ns") + F.col("end_ns"), F.lit(2).cast("bigint"))
        return bounds.withColumn("win", F.lit(0)).withColumn("ts_ns", mid)
    d = bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("win"))
    m = F.lit(windows - 1).cast("bigint")
    q = F.call_function("div", hi - lo, m) * F.col("win")
    r = F.call_function("div", F.pmod(hi - lo, m) * F.col("win"), m)
    return d.withColumn("ts_ns", lo + q + r)


def centred_window(df: DataFrame, centre_ns: int, half_ns: int, ts: str = "ts_ns") -> DataFrame:
    """Rows within ``half_ns`` of an instant; the literal bounds reach the scan."""
    return df.where(F.col(ts).between(int(centre_ns) - int(half_ns), int(centre_ns) + int(half_ns)))


# Half widths of the widening window, in ns.
WINDOW_LADDER_NS = (400_000_000, 900_000_000, 1_800_000_000)


def window_ladder(
    df: DataFrame,
    key: str,
    stream: str,
    k: int,
    ladder: Sequence[int] = WINDOW_LADDER_NS,
    ts: str = "ts_ns",
    seq: str = "seq",
) -> DataFrame:
    """Smallest ladder window around the middle in which every stream of the recording has a row.

    From that window (the whole recording if none fits) the ``k`` rows per
    stream nearest to the middle.  A stream is declared by having rows at all.
    """
    b = stream_bounds(df, [key], ts)
    mid = F.call_function("div", F.col("start_ns") + F.col("end_ns"), F.lit(2).cast("bigint"))
    d = df.join(b.select(key, mid.alias("_mid")), key).withColumn("_d", F.abs(F.col(ts) - F.col("_mid")))
    need = d.groupBy(key, stream).agg(F.min("_d").alias("_d")).groupBy(key).agg(F.max("_d").alias("_need"))
    rung = F.coalesce(*[F.when(F.col("_need") <= w, F.lit(w).cast("bigint")) for w in ladder], F.lit(2**62))
    d = d.join(need.select(key, rung.alias("_half")), key).where(F.col("_d") <= F.col("_half"))
    w = Window.partitionBy(key, stream).orderBy("_d", ts, seq)
    d = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return d.withColumn("half_ns", F.when(F.col("_half") < 2**62, F.col("_half"))).drop("_mid", "_d", "_half")


def exact_subset(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Exactly ``n`` rows (all if fewer) in hash order of the unique ``keys``.

    Repeatable and independent of partitioning; the hash order is ranked in
    chunks, so ``n`` may be large.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary"))
    d = df.withColumn("_h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))
    d = running_sums(d, [], ["_h", *keys], {"_i": F.lit(1).cast("bigint")}, rows_per_chunk=rows_per_chunk, chunk_by=["_h"])
    return d.where(F.col("_i") <= n).drop("_h", "_i")


def evidence_gate(df: DataFrame, keys: Sequence[str], at_least: int, reason: str) -> DataFrame:
    """One status row per key: ``ok`` or ``reason`` when a key has too few rows."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("status", F.when(F.col("n") >= at_least, F.lit("ok")).otherwise(F.lit(reason)))


def top_quality(df: DataFrame, keys: Sequence[str], quality: str, order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` best rows per key by quality; the earlier row wins a tie.

    ``row_number`` with a limit is cut on the map side, so a dominant key
    never reaches one task with more than ``n`` rows per map partition.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(quality), *order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def stream_statistics(df: DataFrame, keys: Sequence[str], value: str, ts: str = "ts_ns", seq: str = "seq", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Count, duration, mean and median rate, mean and population deviation per key."""
    from sensorlake.operators.ordered import previous_row
    from sensorlake.operators.quantiles import exact_quantiles

    d = previous_row(df.select(*keys, ts, seq, value), keys, [ts, seq], {ts: "_before"}, rows_per_chunk)
    d = d.withColumn("_dt", (F.col(ts) - F.col("_before")) / F.lit(1e9))
    v = F.col(value)
    a = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        ((F.max(ts) - F.min(ts)) / F.lit(1e9)).alias("duration_s"),
        F.avg("_dt").alias("_mean_dt"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
    )
    m = exact_quantiles(d, keys, "_dt", {"_median_dt": 0.5}, rows_per_chunk)
    j = _null_safe(a, m, keys, "left")
    rate = lambda c: F.when(F.col(c) > 0, 1.0 / F.col(c))
    return j.select(*keys, "n", "duration_s", rate("_mean_dt").alias("mean_hz"), rate("_median_dt").alias("median_hz"), "mean", "std")


def best_window(counts: DataFrame, plot: str, win: str, n: str, min_frames: int, payload: Sequence[str] = ()) -> DataFrame:
    """Per plot the window with most frames (the earlier on a tie), plots below ``min_frames`` left out."""
    best = F.max(F.struct(F.col(n).alias("n"), (-F.col(win)).alias("_w"), F.col(win).alias("win"), *payload))
    return counts.where(F.col(n) >= min_frames).groupBy(plot).agg(best.alias("_b")).select(plot, "_b.n", "_b.win", *[f"_b.{p}" for p in payload])


def most_frequent(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key, the smaller value on a tie, with its count."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    top = c.groupBy(*keys).agg(F.max("n").alias("n"))
    j = _null_safe(c.withColumnRenamed("n", "_n"), top, keys, "inner").where(F.col("_n") == F.col("n"))
    return j.groupBy(*keys).agg(F.min(value).alias(value), F.max("n").alias("n"))


def gates(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Add one BOOLEAN column per named check (NULL counts as failed)."""
    return df.select("*", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
