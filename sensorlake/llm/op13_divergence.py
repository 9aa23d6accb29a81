"""Audit of how far the sources of a language diverge in their term frequencies.

Texts go through a translate table: one ``bytes.translate`` lowers A-Z and turns
every separator into a blank, ``bytes.split`` cuts the terms and a ``Counter`` per
document gives frequencies. Counters of one task are added up per group until they
hold ``HELD`` terms, so what is shuffled is sparse (group, term, occurrences,
documents) rows, not words. Everything after that works on those rows.

* A group's p of a term it lacks is the same for all such terms (its base). The
  divergence of two sources is therefore V times the difference of their bases plus
  a correction on the terms that one of them has. Corrections are summed in
  blocks: (language, slice of terms, block of sources, block of sources), so neither
  a source nor a term with all occurrences reaches one task, and pairs of sources
  are only ever formed as dense sums, one per pair and block.
* The result has every ordered pair of sources of a language; that many rows, and no more, are joined.
* All arithmetic is on whole numbers.

Defined results:

* null text, lang or source: the empty string, which is a language or source like any other
* a group without a term: p is one constant over the kept terms of its language; it is in every pair
* a language without kept terms: all pairs have value 0, no ``term`` rows
* a language with one source: no ``pair`` rows
* repeated rows count each; doc_id plays no part
* an empty table gives no rows; other columns are untouched and may have any name
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.llm.common import table, text_bytes
from sensorlake.session import cut_lineage

MIN_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Terms that a task adds up before it hands them on.
HELD = 400_000
#: Sources of a block, and (source, term) rows that a slice of terms aims at.
BLOCK, SLICE_ROWS = 128, 300_000

#: A-Z lowered; every other ASCII character that is no letter becomes a blank; bytes above ASCII stay.
LOWERED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(LOWERED).split()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; each group has one row with a null term, n = 0."""

    def handed_on(groups: dict) -> pa.RecordBatch:
        out: dict[str, list] = {"lang": [], "source": [], "term": [], "n": [], "docs": []}
        for (lang, source), (seen, held) in groups.items():
            size = 1 + len(seen)
            out["lang"] += [lang] * size
            out["source"] += [source] * size
            out["term"] += [None, *(t.decode("utf-8", "replace") for t in seen)]
            out["n"] += [0, *seen.values()]
            out["docs"] += [0, *map(held.__getitem__, seen)]
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        entries = 0
        for b in batches:
            for text, lang, source in zip(b.column("text"), b.column("lang").to_pylist(), b.column("source").to_pylist()):
                mine = Counter(terms_of(text.as_py()))
                seen, held = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(seen)
                seen.update(mine)
                held.update(mine.keys())
                entries += len(seen) - before
                if entries >= HELD:
                    yield handed_on(groups)
                    groups, entries = {}, 0
        if groups:
            yield handed_on(groups)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(F.col("text"), blank("lang"), blank("source")).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p: 1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * kept)), exact; 1 where no term is kept."""
    top = F.lit(UNIT).cast("decimal(12,0)") * (count + SMOOTH).cast("decimal(20,0)")
    down = F.greatest(total + SMOOTH * kept, F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", top, down).cast("long") + 1


def corrections(a_base: np.ndarray, a: np.ndarray, b_base: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(sources of a, sources of b): sum over terms of |a - b| less what the bases alone give."""
    out = np.empty((len(a), len(b)), np.int64)
    for i in range(len(a)):
        out[i] = np.abs(a[i][None, :] - b).sum(axis=1) - np.abs(a_base[i] - b_base) * a.shape[1]
    return out


def _excess(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, excess) for source numbers a < b of a language; pairs of one sum only."""
    slices = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
    blocks = groups.groupBy("lang").agg((F.floor(F.max("number") / BLOCK) + 1).cast("int").alias("blocks"))
    source = groups.select("lang", "source", "number", "base").join(slices, "lang").join(blocks, "lang")
    rows = kept.join(source, ["lang", "source"]).withColumn("slice", F.pmod(F.xxhash64("term"), "slices").cast("int"))
    # Each slice also hears of every source, with or without one of its terms, by a row without a term.
    named = source.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("base"))
    columns = ["lang", "slice", "blocks", "term", "number", "base", "p"]
    # A row goes to each block that its own block meets; with up to BLOCK sources that is one row.
    own = F.floor(F.col("number") / BLOCK).cast("int").alias("own")
    dealt = rows.select(*columns).unionByName(named.select(*columns)).select("*", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("lang", "slice", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "term", "number", "base", "p")

    def run(group: pa.Table) -> pa.Table:
        number, base, p = (group.column(c).to_numpy() for c in ("number", "base", "p"))
        own = group.column("own").to_numpy()
        term = group.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()

        def dense(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            mine = own == block
            ids, at = np.unique(number[mine], return_inverse=True)
            bases = np.zeros(len(ids), np.int64)
            bases[at] = base[mine]
            return ids, bases, np.stack([at, term[mine], p[mine]])[:, term[mine] >= 0]

        a_ids, a_base, a = dense(low)
        b_ids, b_base, b = dense(high)
        total = np.zeros((len(a_ids), len(b_ids)), np.int64)
        terms = int(term.max()) + 1
        # The terms of a slice are taken in strips, so the dense part stays small.
        for start in range(0, terms, 4096):
            width = min(4096, terms - start)

            def strip(rows: np.ndarray, bases: np.ndarray) -> np.ndarray:
                inside = rows[:, (rows[1] >= start) & (rows[1] < start + width)]
                full = np.repeat(bases[:, None], width, axis=1)
                full[inside[0], inside[1] - start] = inside[2]
                return full

            total += corrections(a_base, strip(a, a_base), b_base, strip(b, b_base))
        i, j = np.nonzero((a_ids[:, None] < b_ids[None, :]) & (total != 0))
        lang = group.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": a_ids[i], "b": b_ids[j], "excess": total[i, j]})

    parts = dealt.groupBy("lang", "slice", "low", "high").applyInArrow(run, "lang string, a bigint, b bigint, excess bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("excess").alias("excess"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    rows = cut_lineage(counts(docs))
    whole = rows.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).where(F.col("docs") >= min_docs).drop("docs")
    kept = cut_lineage(rows.where("term IS NOT NULL").join(whole, ["lang", "term"]).select("lang", "source", "term", "n", "of_lang"))

    langs = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("of_lang").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = cut_lineage(groups.withColumn("base", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).withColumn("number", number))

    priced = kept.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    priced = priced.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", share(F.col("of_lang"), F.col("lang_total"), F.col("kept")))
    priced = cut_lineage(priced.select("lang", "source", "term", "p", "q"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    side = lambda x: groups.select("lang", F.col("source").alias(f"{x}_source"), F.col("number").alias(x), F.col("base").alias(f"{x}_base"), "kept")
    pairs = side("a").join(side("b").drop("kept"), "lang").where("a < b").join(_excess(priced, groups), ["lang", "a", "b"], "left")
    value = F.col("kept") * F.abs(F.col("a_base") - F.col("b_base")) + F.coalesce("excess", F.lit(0))
    pairs = pairs.withColumn("value", value)
    both = F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all sources of ``documents`` against each other and against their language."""
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.n AS of_lang, coalesce(x.n, 0) AS n
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n,
        CAST(1 + (1000000000::HUGEINT * (c.n + 5)) // (t.total + 5 * l.v) AS BIGINT) AS p,
        CAST(1 + (1000000000::HUGEINT * (c.of_lang + 5)) // (l.total + 5 * l.v) AS BIGINT) AS q
      FROM c JOIN t ON t.lang = c.lang AND t.source = c.source JOIN l ON l.lang = c.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
