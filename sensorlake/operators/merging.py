"""Putting detection sources together: lookups, precedence, gap filling, counts, wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_label(df: DataFrame, label: str, pos: str) -> DataFrame:
    """Lookup table with one row per label; the last duplicate wins."""
    rest = [c for c in df.columns if c not in (label, pos)]
    g = df.groupBy(label).agg(F.max(F.struct(pos, *rest)).alias("_r"))
    return g.select(label, f"_r.{pos}", *[f"_r.{c}" for c in rest])


def precedence_merge(
    first: DataFrame, second: DataFrame, keys: Sequence[str], detected: str, columns: Sequence[str], names: tuple[str, str] = ("raw_production", "scalar_fallback")
) -> DataFrame:
    """Full outer merge: the first source if it detected, else the second if it did, else whichever row exists."""
    a = first.select(*keys, F.struct(detected, *columns).alias("_a"))
    b = second.select(*keys, F.struct(detected, *columns).alias("_b"))
    d = a.join(b, list(keys), "full_outer")
    hit = lambda s: F.coalesce(F.col(f"{s}.{detected}"), F.lit(False))
    source = F.when(hit("_a"), F.lit(names[0])).when(hit("_b"), F.lit(names[1])).otherwise(F.lit("none"))
    row = F.when(hit("_a"), F.col("_a")).when(hit("_b"), F.col("_b")).otherwise(F.coalesce("_a", "_b"))
    d = d.select(*keys, source.alias("source_priority"), row.alias("_r"))
    return d.select(*keys, "source_priority", F.coalesce(F.col(f"_r.{detected}"), F.lit(False)).alias(detected), *[F.col(f"_r.{c}").alias(c) for c in columns])


def fill_gaps(guided: DataFrame, fallback: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("guided", "fallback_intensity")) -> DataFrame:
    """Guided rows, and fallback rows for keys the guided source does not have."""
    extra = fallback.join(guided.select(*keys).distinct(), list(keys), "left_anti")
    return guided.withColumn("source", F.lit(names[0])).unionByName(extra.withColumn("source", F.lit(names[1])))


def keep_better(new: DataFrame, existing: DataFrame, keys: Sequence[str], score: str, columns: Sequence[str]) -> DataFrame:
    """Existing detection if the new one is missing or scores lower; the loser stays as the alternative."""
    n = new.select(*keys, F.struct(score, *columns).alias("_n"), F.col(score).alias("_sn"))
    e = existing.select(*keys, F.struct(score, *columns).alias("_e"), F.col(score).alias("_se"))
    d = n.join(e, list(keys), "full_outer")
    use_old = F.col("_e").isNotNull() & (F.col("_n").isNull() | (F.coalesce("_se", F.lit(0.0)) > F.coalesce("_sn", F.lit(0.0))))
    d = d.withColumn("used_existing", use_old)
    best, other = F.when(F.col("used_existing"), F.col("_e")).otherwise(F.col("_n")), F.when(F.col("used_existing"), F.col("_n"))
    d = d.select(*keys, "used_existing", best.alias("_b"), other.alias("_o"))
    return d.select(*keys, "used_existing", F.col(f"_b.{score}").alias(score), *[F.col(f"_b.{c}").alias(c) for c in columns], F.col(f"_o.{score}").alias(f"alternative_{score}"))


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources, missing columns as NULL."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def label_sets(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """Every label of either side, with the side(s) it occurs in."""
    x = a.select(label, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(label, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    g = x.groupBy(label).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return g.select(label, F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both").when(F.col("_a") == 1, "left").otherwise("right").alias("side"))


def missing_labels(wanted: DataFrame, present: DataFrame, label: str) -> DataFrame:
    return wanted.select(label).distinct().join(present.select(label).distinct(), label, "left_anti")


def keep_first(df: DataFrame, keys: Sequence[str], pos: str, payload: Sequence[str]) -> DataFrame:
    """First row per key in ``pos`` order (distinct crops, patterns, boxes)."""
    g = df.groupBy(*keys).agg(F.min(F.struct(pos, *payload)).alias("_f"))
    return g.select(*keys, f"_f.{pos}", *[f"_f.{p}" for p in payload])


def detection_counts(df: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Rows and number of rows for which each flag holds."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def summary_text(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``value=count`` pairs per key, sorted by value and joined with commas (a small, closed set of values)."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    pair = F.struct(F.col(value).alias("v"), F.col("_c").alias("c"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.concat(p["v"], F.lit("="), p["c"].cast("string"))), ",")
    return c.groupBy(*keys).agg(text.alias(name))


def wide_by_sensor(df: DataFrame, keys: Sequence[str], sensor: str, sensors: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key with a ``<sensor>_<column>`` group for each sensor of a fixed list."""
    g = df.groupBy(*keys).pivot(sensor, list(sensors)).agg(F.max(F.struct(*columns)).alias("s"))
    return g.select(*keys, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in sensors for c in columns])


def resume(todo: DataFrame, done: DataFrame, label: str) -> DataFrame:
    """Rows whose label has no result yet."""
    return todo.join(done.select(label).distinct(), label, "left_anti")


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows) by the error column filled in by a decoder."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())
