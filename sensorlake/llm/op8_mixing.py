"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / w with u from a hash of its id and w its
quality weight. A source takes complete epochs of all its documents, then the
documents with the smallest keys until the rest of its token budget is met: of
the two ends next to the budget, the nearer one.

The keys of a source are first summed in bins of some thousand documents; only the
bin in which the budget ends is sorted row by row. What comes out is one cut per
source, a pair of key and id, so a document's share is a comparison and texts never move.

* null text: size 0; null source: a source of its own, last
* null id: hashed as the empty string, before other ids in ties
* rows that share an id share a key and are taken together or not at all
* a source without words has target 0; an empty table gives an empty mix
* the table of sources is one row per source and small against the documents
* other columns are untouched and may have any name
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from sensorlake.llm.common import map_rows, packed, table, text_bytes, unpacked
from sensorlake.session import cut_lineage

#: Weights of the sources in the order of their names, repeating; share of all words that the mix takes; most epochs of a source.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BIN_ROWS = 2048
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with _mix_size (words) and _mix_weight (share of ASCII letters among bytes, above 0); the text is a column or within ``row``."""

    def run(c: dict) -> dict:
        sizes, weights = [], []
        for t in c["text"] if "text" in c else c["row"].field("text"):
            b = text_bytes(t.as_py())
            sizes.append(len(b.split()))
            weights.append((1 + len(b) - len(b.translate(None, LETTERS))) / (1 + len(b)))
        return {**c, "_mix_size": sizes, "_mix_weight": weights}

    return map_rows(docs, run, StructType([*docs.schema, StructField("_mix_size", LongType()), StructField("_mix_weight", DoubleType())]))


def keyed(measured: DataFrame) -> DataFrame:
    """Adds _mix_key: exponential with rate ``_mix_weight``, the same in every run."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return measured.withColumn("_mix_key", -F.log(u) / F.col("_mix_weight"))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, n) gets its target: the shares by weight, filled up under the caps.

    In the order of cap / weight the capped sources come first: one is capped if
    what is left for it and all behind it would lift it above its cap.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (1 + (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(MOST)).withColumn("ratio", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("all", F.sum("source_size").over(everything) * F.lit(SHARE))
    s = s.withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum("w").over(behind))
    s = s.withColumn("capped", F.col("left") / F.col("rest") > F.col("ratio"))
    spent, open_ = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything), F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0.0)).over(everything)
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", (F.col("all") - spent) / open_ * F.col("w"))))
    return s.select("source", "source_size", "n", "target")


def _order(key: str = "_mix_key", doc: str = "doc_id") -> list[Column]:
    return [F.col(key).asc(), F.col(doc).asc_nulls_first()]


def plan(rows: DataFrame) -> DataFrame:
    """One row per source: source_size, target, epochs and the cut (cut_key, cut_id) up to which documents are taken once more.

    ``rows`` has doc_id, source, _mix_size and _mix_key and is read several times.
    """
    sums = rows.groupBy("source").agg(F.sum("_mix_size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    s = cut_lineage(targets(sums).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")))
    s = s.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("bins", F.ceil(F.col("n") / F.lit(BIN_ROWS))).withColumnRenamed("source", "s_source")
    small = s.select("s_source", "left", "bins")
    place = F.least(F.col("bins") - 1, F.floor(F.col("bins") * (1 - F.exp(-F.col("_mix_key"))))).cast("long")
    placed = rows.join(small, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("bin", place)
    binned = placed.groupBy("s_source", "bin", "left").agg(F.sum("_mix_size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("s_source").orderBy("bin"))
    ends = binned.withColumn("upto", upto).withColumn("nth", F.row_number().over(Window.partitionBy("s_source").orderBy((F.col("upto") <= F.col("left")).cast("int"), "bin")))
    ends = ends.where("nth = 1 AND upto > left").select(F.col("s_source").alias("e_source"), F.col("bin").alias("e_bin"), (F.col("upto") - F.col("words")).alias("before"))
    # Only the bin in which the budget ends is sorted row by row.
    edge = placed.join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bin") == F.col("e_bin")))
    edge = edge.groupBy("source", "doc_id", "_mix_key", "left", "before").agg(F.sum("_mix_size").alias("words"))
    by_key = Window.partitionBy("source").orderBy(*_order())
    edge = edge.withColumn("end", F.col("before") + F.sum("words").over(by_key)).withColumn("start", F.col("end") - F.col("words"))
    edge = edge.where((F.col("end") <= F.col("left")) | ((F.col("start") < F.col("left")) & (F.col("end") - F.col("left") <= F.col("left") - F.col("start"))))
    last = edge.groupBy("source").agg(F.max(F.struct(F.col("_mix_key"), F.col("doc_id").isNotNull().alias("has"), F.col("doc_id"))).alias("last"))
    last = last.select(F.col("source").alias("l_source"), F.col("last._mix_key").alias("l_key"), F.col("last.doc_id").alias("l_id"))
    # Nothing taken in that bin: the cut lies just below its first key. No such bin: everything is below the cut.
    low = ends.join(s.select(F.col("s_source").alias("b_source"), "bins"), F.col("e_source").eqNullSafe(F.col("b_source"))).select("e_source", "e_bin", "bins")
    out = s.join(low.drop("bins"), F.col("s_source").eqNullSafe(F.col("e_source")), "left").join(last, F.col("s_source").eqNullSafe(F.col("l_source")), "left")
    return out.select(F.col("s_source").alias("m_source"), "source_size", "target", "epochs", "bins", F.col("e_bin").alias("cut_bin"), F.col("l_key").alias("cut_key"), F.col("l_id").alias("cut_id"))


def shares(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and _mix_times, how often the mix takes a document. ``cuts`` has one row per source."""
    got = rows.join(cuts, F.col("source").eqNullSafe(F.col("m_source")), "left")
    place = F.least(F.col("bins") - 1, F.floor(F.col("bins") * (1 - F.exp(-F.col("_mix_key"))))).cast("long")
    up_to_cut = (F.col("_mix_key") < F.col("cut_key")) | ((F.col("_mix_key") == F.col("cut_key")) & (F.col("doc_id").isNull() | (F.col("doc_id") <= F.col("cut_id"))))
    once_more = F.col("cut_bin").isNull() | (place < F.col("cut_bin")) | ((place == F.col("cut_bin")) & F.coalesce(up_to_cut, F.lit(False)))
    full = F.col("epochs") * F.col("source_size") >= F.col("target")
    return got.withColumn("_mix_times", F.col("epochs") + (once_more & ~full).cast("int")).drop("m_source", "epochs", "bins", "cut_bin", "cut_key", "cut_id")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated as often as they are taken; same columns. One pass for the cuts, one for the rows."""
    small = cut_lineage(keyed(measure(docs.select("doc_id", "source", "text")).drop("text")))
    got = shares(keyed(measure(packed(docs, "doc_id", "source"))), cut_lineage(plan(small)))
    return unpacked(got.where("_mix_times > 0").select("row", F.explode(F.sequence(F.lit(1), "_mix_times"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: what the mix takes of each of all ``documents``."""
    small = cut_lineage(keyed(measure(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")))
    got = shares(small, cut_lineage(plan(small)))
    return got.select("doc_id", F.col("_mix_size").alias("size"), "source_size", "target", (F.col("_mix_size") * F.col("_mix_times")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (1 + length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))) / CAST(1 + strlen(coalesce(text, '')) AS DOUBLE) AS weight,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), k AS (SELECT *, -ln(u) / weight AS key FROM d
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS cap FROM s
), r AS (SELECT *, cap / w AS ratio, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS everything FROM w
), c AS (
  SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > ratio AS capped FROM r
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, (everything - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () * w) END AS target FROM c
), e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t
), p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND (upto <= rest OR (upto - size < rest AND upto - rest <= rest - (upto - size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
