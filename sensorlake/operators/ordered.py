"""Ordered work on keyed streams without putting a whole key into one task.

A window ``PARTITION BY key ORDER BY ts`` sorts each key in a single task, so
one dominant recording decides the run time of the job.  Here the order axis
is first cut at approximate quantiles of the *whole* table: whatever key a row
has, a (key, chunk) group can hold at most about one chunk's share of all rows.
Work inside a chunk is an ordinary window; what crosses a chunk boundary (an
offset, a previous row) comes from one pre-aggregated row per (key, chunk).

Quantiles are taken in two steps: groups of input partitions are sketched side
by side, then the few values that each group gives are merged by their weights.
The cut points are a scalar subquery of one row, so nothing is collected on the
driver; small inputs get exactly one chunk, large ones as many as their rows ask for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = "_chunk"
ROWS_PER_CHUNK = 2_000_000
#: Groups of input partitions that are sketched in parallel, values that each gives, steps of the search among the cut points.
GROUPS, VALUES, SEARCH_STEPS = 256, 256, 17
_GRID = f"cast(split('{','.join(str((i + 0.5) / VALUES) for i in range(VALUES))}', ',') AS array<double>)"


def _cut_points(df: DataFrame, order: Sequence[str], rows_per_chunk: int, keep: Column | None = None) -> DataFrame:
    """One row: arrays b0, b1 of cut points, one per full chunk of rows below; a value that spans several chunks repeats. NULL if one chunk is enough."""
    columns = list(order[:2])
    held = [] if keep is None else [F.max(keep).alias("keep")]
    sketches = [F.expr(f"percentile_approx(`{c}`, {_GRID}, {16 * VALUES})").alias(f"q{i}") for i, c in enumerate(columns)]
    groups = df.withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).groupBy("_g").agg(F.count(F.lit(1)).alias("n"), *sketches, *held)
    keeps = [F.max("keep").alias("keep")] if held else []
    one = groups.agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", *[f"q{i}" for i in range(len(columns))])).alias("g"), *keeps)

    def merged(q: str, kind: str) -> Column:
        values = F.flatten(F.transform("g", lambda g: F.transform(g[q], lambda x: F.struct(x.alias("x"), (g["n"] / F.lit(float(VALUES))).alias("w")))))
        nothing = F.struct(F.lit(0.0).alias("below"), F.array().cast(f"array<{kind}>").alias("cuts"))

        def take(s: Column, v: Column) -> Column:
            below = s["below"] + v["w"]
            due = (F.floor(below / F.lit(float(rows_per_chunk))) - F.size(s["cuts"])).cast("int")
            return F.struct(below.alias("below"), F.when(due > 0, F.concat(s["cuts"], F.array_repeat(v["x"], due))).otherwise(s["cuts"]).alias("cuts"))

        return F.aggregate(F.array_sort(values), nothing, take)["cuts"]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    many = F.col("n") > F.lit(rows_per_chunk)
    cuts = [F.when(many, merged(f"q{i}", kinds[c])).alias(f"b{i}") for i, c in enumerate(columns)]
    return one.select(F.struct(*cuts, *(["keep"] if held else [])).alias("cuts"))


def _rank_in(cuts: Column, value: Column, strict: bool) -> Column:
    """How many cut points lie below ``value`` (binary search by halving steps)."""
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(SEARCH_STEPS))])

    def step(lo: Column, jump: Column) -> Column:
        probe = F.get(cuts, lo + jump - 1)
        hit = probe < value if strict else probe <= value
        return F.when(hit, lo + jump).otherwise(lo)

    return F.aggregate(steps, F.lit(0), step)


def with_chunk(
    df: DataFrame,
    order: Sequence[str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
    keep: Column | None = None,
) -> DataFrame:
    """Add ``_chunk``, non-decreasing in the lexicographic order of ``order[:2]``.

    Rows that share one value of ``order[0]`` in bulk (a stuck clock) are
    spread over the chunks that value spans by the rank of ``order[1]``.
    ``keep`` names a column the cut-point pass should not prune, so that a
    shuffle below ``df`` is the same in that pass and is run once.
    """
    cuts = _cut_points(df, order, rows_per_chunk, keep)
    df = df.withColumn("_cuts", cuts.scalar())
    first, value = F.col("_cuts.b0"), F.col(order[0])
    low = _rank_in(first, value, strict=True)
    if len(order) > 1:
        span = _rank_in(first, value, strict=False) - low
        tie = _rank_in(F.col("_cuts.b1"), F.col(order[1]), strict=False)
        spread = F.when(span > 0, F.floor((tie * (span + 1)) / (F.size(first) + 1)).cast("int")).otherwise(F.lit(0))
        low = low + spread
    return df.withColumn(CHUNK, F.when(first.isNull(), F.lit(0)).otherwise(low)).drop("_cuts")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    totals: Mapping[str, str] | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    keep: Column | None = None,
    chunk_by: Sequence[str] | None = None,
) -> DataFrame:
    """Inclusive running sums per key; ``totals`` maps a sum to a column for its key total.

    What earlier chunks add up to enters each chunk as one extra first row, so
    the data itself is shuffled once and joined with nothing.  ``chunk_by``
    names the (numeric) leading order columns to cut at, by default the first
    two of ``order``.
    """
    totals = totals or {}
    base = df.select("*", *[e.alias(f"_e_{n}") for n, e in sums.items()])
    base = with_chunk(base, chunk_by or order[:2], rows_per_chunk, keep)
    part = base.groupBy(*keys, CHUNK).agg(*[F.sum(f"_e_{n}").alias(f"_e_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = part.select(
        *keys,
        CHUNK,
        *[F.sum(f"_e_{n}").over(before).alias(f"_e_{n}") for n in sums],
        *[F.sum(f"_e_{n}").over(whole).alias(f"_t_{n}") for n in totals],
        F.lit(0).alias("_turn"),
    )
    both = base.withColumn("_turn", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, CHUNK).orderBy("_turn", *order).rowsBetween(Window.unboundedPreceding, 0)
    done = both.select(
        *df.columns,
        "_turn",
        *[F.sum(f"_e_{n}").over(inside).alias(n) for n in sums],
        *[F.first(f"_t_{n}").over(inside).alias(out) for n, out in totals.items()],
    )
    return done.where("_turn = 1").drop("_turn")


def running_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "idx",
    count: str | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """0-based position of each row in its key, and optionally the key's row count."""
    totals = {name: count} if count else None
    out = running_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, totals, rows_per_chunk)
    return out.withColumn(name, F.col(name) - 1)


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
    forward: bool = False,
) -> DataFrame:
    """``lag`` (or ``lead`` with ``forward``) of ``columns`` per key, NULL at the end of the key."""
    base = with_chunk(df, order[:2], rows_per_chunk)
    pick, near = (F.min, F.lead) if forward else (F.max, F.lag)
    row = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_v_{c}") for c in columns])
    hop = Window.partitionBy(*keys).orderBy(CHUNK)
    ends = base.groupBy(*keys, CHUNK).agg(pick(row).alias("_end")).select(*keys, CHUNK, near("_end").over(hop).alias("_end"))
    carry = ends.where(F.col("_end").isNotNull()).select(*keys, CHUNK, *[F.col(f"_end._v_{c}").alias(f"_v_{c}") for c in columns], F.lit(2 if forward else 0).alias("_turn"))
    both = base.select("*", *[F.col(c).alias(f"_v_{c}") for c in columns], F.lit(1).alias("_turn")).unionByName(carry, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, CHUNK).orderBy("_turn", *order)
    done = both.select(*df.columns, "_turn", *[near(f"_v_{c}").over(inside).alias(o) for c, o in columns.items()])
    return done.where("_turn = 1").drop("_turn")
