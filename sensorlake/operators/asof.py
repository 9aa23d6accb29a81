"""Nearest-in-time joins and interval joins.

Left and right rows of a key are merged on the time axis in one shuffle and
scanned once in each direction; no candidate pairs are produced.  Chunks of
the time axis (see ``ordered``) keep a dominant key parallel: every chunk also
receives the last right row before it and the first right row after it, taken
from one pre-aggregated row per (key, chunk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.operators.ordered import CHUNK, ROWS_PER_CHUNK, previous_row, with_chunk
from sensorlake.session import cut_lineage


def nearest_per_stream(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    streams: Mapping[str, int | None],
    stream_col: str | None = None,
    payload: Sequence[str] = (),
    ts: str = "ts_ns",
    seq: str = "seq",
    rows_per_chunk: int = ROWS_PER_CHUNK,
    direction: str = "nearest",
) -> DataFrame:
    """Nearest right row of every named stream for each left row, in one pass.

    ``streams`` maps a value of ``stream_col`` to its tolerance in ns (None: no
    limit).  For each stream a struct column of that name is added with
    ``dt_ns`` (always the distance to the nearest row), ``ts``, ``seq`` and the
    payload; the latter are NULL when the distance exceeds the tolerance (an
    equal distance still matches).  Ties in distance go to the earlier right
    row, equal stamps to the smaller ``seq``.  ``direction`` may restrict the
    search to rows not later (``backward``) or not earlier (``forward``).
    """
    key_cols = [f"_k{i}" for i in range(len(keys))]
    name = F.col(stream_col) if stream_col else F.lit(next(iter(streams)))
    wanted = right.where(F.col(ts).isNotNull())
    if stream_col:
        wanted = wanted.where(F.col(stream_col).isin(*streams))
    a = left.select(
        *[F.col(k).alias(c) for k, c in zip(keys, key_cols)],
        F.col(ts).alias("_ts"),
        F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"),
    )
    b = wanted.select(
        *[F.col(k).alias(c) for k, c in zip(keys, key_cols)],
        F.col(ts).alias("_ts"),
        F.col(seq).cast("bigint").alias("_seq"),
        name.alias("_stream"),
        F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"), *payload).alias("_hit"),
    )
    both = a.unionByName(b, allowMissingColumns=True)
    is_left = F.col("_row").isNotNull()
    both = both.withColumn("_tie", F.when(is_left, F.xxhash64("_row")).otherwise(F.col("_seq")))
    both = with_chunk(both, ["_ts", "_tie"], rows_per_chunk).drop("_tie")

    def of(stream: str, value: Column) -> Column:
        return F.when(~is_left & (F.col("_stream") == stream), value)

    up, down = F.struct("_ts", (-F.col("_seq")).alias("_o"), "_hit"), F.struct("_ts", "_seq", "_hit")
    ends = both.groupBy(*key_cols, CHUNK).agg(
        F.max(is_left).alias("_need"),
        *[F.max(of(s, up)).alias(f"_up{i}") for i, s in enumerate(streams)],
        *[F.min(of(s, down)).alias(f"_dn{i}") for i, s in enumerate(streams)],
    )
    asc = Window.partitionBy(*key_cols).orderBy(F.asc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    desc = Window.partitionBy(*key_cols).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *key_cols,
        CHUNK,
        "_need",
        F.array(
            *[F.struct(F.lit(s).alias("s"), F.max(f"_up{i}").over(asc)["_hit"].alias("h")) for i, s in enumerate(streams)],
            *[F.struct(F.lit(s).alias("s"), F.min(f"_dn{i}").over(desc)["_hit"].alias("h")) for i, s in enumerate(streams)],
        ).alias("_c"),
    ).where("_need")
    carried = (
        carried.select(*key_cols, CHUNK, F.explode("_c").alias("_c"))
        .where(F.col("_c.h").isNotNull())
        .select(
            *key_cols,
            CHUNK,
            F.col("_c.h.ts").alias("_ts"),
            F.col("_c.h.seq").cast("bigint").alias("_seq"),
            F.col("_c.s").alias("_stream"),
            F.col("_c.h").alias("_hit"),
        )
    )
    both = both.unionByName(carried, allowMissingColumns=True)
    side = F.when(is_left, F.lit(1)).otherwise(F.lit(0))
    group = Window.partitionBy(*key_cols, CHUNK)
    fwd = group.orderBy(F.asc("_ts"), side, F.desc("_seq")).rowsBetween(Window.unboundedPreceding, 0)
    bwd = group.orderBy(F.desc("_ts"), side, F.desc("_seq")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select(
        *key_cols,
        "_ts",
        "_row",
        *[F.last(of(s, F.col("_hit")), ignorenulls=True).over(fwd).alias(f"_a{i}") for i, s in enumerate(streams)],
        *[F.last(of(s, F.col("_hit")), ignorenulls=True).over(bwd).alias(f"_b{i}") for i, s in enumerate(streams)],
    ).where(is_left)
    usable = F.col("_ts").isNotNull()
    for c in key_cols:
        usable = usable & F.col(c).isNotNull()
    out = []
    for i, (s, tol) in enumerate(streams.items()):
        pa, pb = F.col(f"_a{i}"), F.col(f"_b{i}")
        da, db = F.col("_ts") - pa["ts"], pb["ts"] - F.col("_ts")
        if direction == "backward":
            pb = F.lit(None).cast(seen.schema[f"_b{i}"].dataType)
        elif direction == "forward":
            pa = F.lit(None).cast(seen.schema[f"_a{i}"].dataType)
        later = pa.isNull() | (F.struct(db, pb["ts"], pb["seq"]) < F.struct(da, pa["ts"], pa["seq"]))
        hit = F.when(usable, F.when(pb.isNotNull() & later, pb).otherwise(pa))
        dt = F.abs(hit["ts"] - F.col("_ts"))
        ok = F.lit(True) if tol is None else dt <= F.lit(int(tol))
        fields = ["ts", "seq", *payload]
        out.append(F.struct(dt.alias("dt_ns"), *[F.when(ok, hit[f]).alias(f) for f in fields]).alias(s))
    return seen.select("_row.*", *out)


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    tolerance_ns: int | None = None,
    payload: Sequence[str] = (),
    prefix: str = "r_",
    how: str = "left",
    ts: str = "ts_ns",
    seq: str = "seq",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Nearest right row for each left row as flat ``prefix`` columns plus ``dt_ns``.

    ``how='left'`` keeps unmatched left rows with NULL right columns but still
    reports the distance; ``how='inner'`` keeps matches only.
    """
    got = nearest_per_stream(left, right, keys, {"_n": tolerance_ns}, None, payload, ts, seq, rows_per_chunk)
    if how == "inner":
        got = got.where(F.col("_n.ts").isNotNull())
    return got.select(
        *left.columns,
        F.col("_n.dt_ns").alias("dt_ns"),
        F.col("_n.ts").alias(f"{prefix}ts_ns"),
        F.col("_n.seq").alias(f"{prefix}seq"),
        *[F.col(f"_n.{c}").alias(f"{prefix}{c}") for c in payload],
    )


def nearest_of_stamps(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    tolerance_ns: int | None = None,
    payload: Sequence[str] = (),
    prefix: str = "r_",
    ts: str = "ts_ns",
    seq: str = "seq",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """The matches of ``nearest_join``, once per key and stamp of ``left``; a written table to join by key and stamp.

    Points of a cloud share its stamp, so there are far fewer stamps than
    points, and only stamps are merged on the time axis.
    """
    stamps = left.select(*keys, ts).distinct()
    return cut_lineage(nearest_join(stamps, right, keys, tolerance_ns, payload, prefix, "inner", ts, seq, rows_per_chunk))


def reverse_nearest(
    messages: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    target_id: str,
    stream_col: str,
    tolerance_ns: Mapping[str, int],
    payload: Sequence[str] = (),
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Assign each message to its nearest target; keep the closest message per (target, stream).

    Equal distances keep the message seen first (smaller stamp, then ``seq``).
    """
    hit = nearest_join(messages, targets, keys, None, [target_id], "t_", "inner", rows_per_chunk=rows_per_chunk)
    limit = F.coalesce(*[F.when(F.col(stream_col) == s, F.lit(int(t))) for s, t in tolerance_ns.items()])
    best = F.min(F.struct("dt_ns", "ts_ns", "seq", *payload))
    return (
        hit.where(F.col("dt_ns") <= limit)
        .groupBy(*keys, F.col(f"t_{target_id}").alias(target_id), stream_col)
        .agg(best.alias("_b"))
        .select(*keys, target_id, stream_col, "_b.*")
    )


def time_bucket(ts: Column, width: int) -> Column:
    """Floor division of integer nanoseconds, exact for any sign."""
    w = F.lit(int(width)).cast("bigint")
    return F.call_function("div", ts - F.pmod(ts, w), w)


def within_interval(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    half_width_ns: int,
    ts: str = "ts_ns",
    prefix: str = "r_",
) -> DataFrame:
    """All right rows within ``half_width_ns`` (inclusive) of each left row.

    Time is cut into buckets as wide as the half width: a left row probes three
    buckets and a right row lives in one, so the join is an equi-join whose
    size follows the size of its result.
    """
    w = int(half_width_ns)
    b = time_bucket(F.col(ts), w)
    probe = left.withColumn("_b", F.explode(F.sequence(b - 1, b + 1)))
    found = right.withColumn("_rb", b).select(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns], "_rb")
    cond = [F.col(k) == F.col(f"{prefix}{k}") for k in keys] + [
        F.col("_b") == F.col("_rb"),
        F.abs(F.col(f"{prefix}{ts}") - F.col(ts)) <= w,
    ]
    return probe.join(found, cond).drop("_b", "_rb", *[f"{prefix}{k}" for k in keys])


def bracketed_slice(
    intervals: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    interval_id: str,
    payload: Sequence[str],
    start: str = "t0_ns",
    end: str = "t1_ns",
    bucket_ns: int = 1_000_000_000,
    min_gap_ns: int = 100,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Samples (``ts_ns, seq, payload``) of each interval plus one on each side, as ``clip_ns``.

    Inner samples come from an equi-join on buckets that suit each interval's
    length; the sample before the start
    and the one after the end come from two directional as-of lookups.  Stamps
    are clipped to the interval, rows at most ``min_gap_ns`` after their
    predecessor are dropped, and intervals with fewer than two rows disappear.
    """
    fields = ["ts_ns", "seq", *payload]
    slim = intervals.select(*keys, interval_id, start, end)
    # Buckets are as wide as the interval, in powers of two of bucket_ns, so an interval is in two or three of them whatever its length.
    span = F.greatest((F.col(end) - F.col(start)) / F.lit(float(bucket_ns)), F.lit(1.0))
    probe = slim.withColumn("_level", F.ceil(F.log2(span)).cast("int"))
    place = lambda c: F.floor(F.col(c) / (F.lit(float(bucket_ns)) * F.pow(F.lit(2.0), "_level"))).cast("bigint")
    levels = probe.agg(F.collect_set("_level").alias("l")).scalar()
    probe = probe.where(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(place(start), place(end))))
    inner = (
        probe.join(samples.withColumn("_level", F.explode(levels)).withColumn("_b", place("ts_ns")), [*keys, "_level", "_b"])
        .where(F.col("ts_ns").between(F.col(start), F.col(end)))
        .select(*keys, interval_id, start, end, *fields)
    )
    parts = [inner]
    for way, edge, shift in (("backward", start, -1), ("forward", end, 1)):
        ask = slim.withColumn("ts_ns", F.col(edge) + shift)
        got = nearest_per_stream(ask, samples, keys, {"_n": None}, None, payload, rows_per_chunk=rows_per_chunk, direction=way)
        got = got.where(F.col("_n.ts").isNotNull())
        parts.append(got.select(*keys, interval_id, start, end, F.col("_n.ts").alias("ts_ns"), *[F.col(f"_n.{f}").alias(f) for f in fields[1:]]))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rows = rows.withColumn("clip_ns", F.least(F.greatest("ts_ns", start), F.col(end)))
    # an interval may hold a large share of all samples, so it is not put into one window
    rows = cut_lineage(rows)
    group = [*keys, interval_id]
    rows = previous_row(rows, group, ["ts_ns", "seq"], {"clip_ns": "_before"}, rows_per_chunk)
    rows = rows.where(F.col("_before").isNull() | (F.col("clip_ns") - F.col("_before") > min_gap_ns)).drop("_before")
    enough = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(*group)
    return rows.join(enough, group, "left_semi")
