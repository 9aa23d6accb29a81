"""Removal of passages that occurred before, with repeated-phrase automata.

A window is ``WINDOW`` consecutive words. A word goes if a window covers it whose
words also start earlier, in a document with a smaller id or further up in its own.

1. Whole copies: of documents with one text the first is worked on; all windows of the others occurred before.
2. Phrases: in every window the phrase of ``PHRASE`` words with the smallest hash is
   its mark, so equal windows have equal marks and about one position in eight is
   one. Counting marks over all documents confirms those that recur.
3. Automata: documents meet the recurring marks they hold. Each shard of documents
   compiles its phrases into an Aho-Corasick automaton and streams its texts through
   it, which locates every occurrence, word for word. Only windows with a located mark go on.
4. The first of equal windows stays, first within a batch of documents and then
   over all; what is flagged comes back to its document as ranges.

* null or empty text: no words; the digest is that of the empty string
* null id: the row comes after all that have one
* rows that share an id or have none: documents of their own, in the order of a hash of their text; of rows
  that are equal in both one stays and the others, like all later copies of a text of ``WINDOW`` words or more, lose every word
* equal windows are told by a 96-bit hash
* other columns are untouched and may have any name
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.llm.common import map_rows, sha256_hex, table, words_of
from sensorlake.session import cut_lineage

WINDOW, PHRASE = 20, 6
MARKS = WINDOW - PHRASE + 1
#: Text of one automaton's documents, in characters.
SHARD_CHARS = 6_000_000

#: What tells one row from another and says which is earlier: no id, the id (a text hash without one), a text hash.
KEY = ["late", "doc", "twin"]
_KEY_DDL = "late boolean, doc bigint, twin bigint"

_BASE, _STEP, _STEP_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse, np.uint64)]))
    return up, down


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash per word: the value of its bytes as a polynomial, from running sums over the whole text."""
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b"".join(words), np.uint8)
    size = 1 << max(12, int(len(data)).bit_length())
    up, down = _powers(size)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    starts = np.concatenate([[0], ends[:-1]])
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _runs(h: np.ndarray, n: int, step: np.uint64) -> np.ndarray:
    """Hash of every ``n`` consecutive values, built from runs of powers of two."""
    out, have, power, part, width = None, 0, step, h, 1
    with np.errstate(over="ignore"):
        while n:
            if n & 1:
                if out is None:
                    out, have = part, width
                else:
                    m = len(h) - have - width + 1
                    out = out[:m] + part[have : have + m] * np.uint64(pow(int(step), have, 1 << 64))
                    have += width
            n >>= 1
            if n:
                part = part[:-width] + part[width:] * power
                power = power * power
                width *= 2
    return _mix(out)


def _slide(v: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Least or largest of every ``n`` consecutive values."""
    pick = np.minimum if least else np.maximum
    width = 1
    out = v
    while width * 2 <= n:
        out = pick(out[:-width], out[width:])
        width *= 2
    return out if width == n else pick(out[: len(out) - (n - width)], out[n - width :])


class Marked:
    """A text's words, the hashes of its phrases and each window's mark."""

    def __init__(self, text: str | None):
        self.words = words_of(text)
        self.n = len(self.words)
        self.windows = max(0, self.n - WINDOW + 1)
        if self.windows:
            self.hash = word_hashes(self.words)
            self.phrase = _runs(self.hash, PHRASE, _STEP)
            self.mark = _slide(self.phrase, MARKS, True)

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number of places) of the phrases that are the mark of a window."""
        wide = np.concatenate([np.zeros(MARKS - 1, np.uint64), self.mark, np.zeros(MARKS - 1, np.uint64)])
        at = self.phrase == _slide(wide, MARKS, False)
        return np.unique(self.phrase[at], return_counts=True)

    def spelled(self) -> tuple[str, np.ndarray]:
        """The words with single spaces around them, and where each space is."""
        text = (b" " + b" ".join(self.words) + b" ").decode("utf-8", "surrogatepass")
        return text, np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)


def _keys(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(k).to_numpy(zero_copy_only=False) for k in KEY]


def marks_of(docs: DataFrame) -> DataFrame:
    """(late, doc, twin, h, n): marks of every document and in how many places it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, hs, ns = [], [], []
            for i, t in enumerate(b.column("text")):
                m = Marked(t.as_py())
                if m.windows:
                    h, n = m.marks()
                    at.append(np.full(len(h), i, np.int64))
                    hs.append(h)
                    ns.append(n)
            if at:
                row = np.concatenate(at)
                yield pa.RecordBatch.from_pydict({**{k: v[row] for k, v in zip(KEY, _keys(b))}, "h": np.concatenate(hs).view(np.int64), "n": np.concatenate(ns).astype(np.int32)})

    return docs.select(*KEY, "text").mapInArrow(run, f"{_KEY_DDL}, h bigint, n int")


def _located(docs: list[tuple[Marked, np.ndarray]]) -> list[np.ndarray]:
    """Per document the starts of windows whose mark the shard's automaton locates in it."""
    automaton = ahocorasick.Automaton()
    spelled = []
    for m, recurring in docs:
        text, spaces = m.spelled()
        spelled.append((text, spaces))
        for i in np.flatnonzero(np.isin(m.phrase, recurring)).tolist():
            phrase = text[spaces[i] : spaces[i + PHRASE] + 1]
            automaton.add_word(phrase, len(phrase))
    automaton.make_automaton()
    out = []
    for (m, _), (text, spaces) in zip(docs, spelled):
        starts = np.fromiter((end - n + 1 for end, n in automaton.iter(text)), np.int64)
        place = np.searchsorted(spaces, starts)
        found = np.full(len(m.phrase), np.uint64(2**64 - 1))
        found[place] = m.phrase[place]
        out.append(np.flatnonzero(_slide(found, MARKS, True) == m.mark))
    return out


def _ranges(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows of a document, sorted, as (doc, first start, last start)."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]]) if len(first) else first
    return doc[first], start[first], start[last]


def windows_of(docs: DataFrame) -> DataFrame:
    """(key, text, recurring) to (wa, wb, key, lo, hi, again): windows that go on, the first of each in the batch, and ranges already known to be repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _keys(b)
            order = np.lexsort(keys[::-1])
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            keys = [k[order] for k in keys]
            wa, wb, ids, at = [], [], [], []
            shard: list[tuple[Marked, np.ndarray]] = []
            names: list[int] = []
            held = 0

            def flush() -> None:
                for doc, (m, _), starts in zip(names, shard, _located(shard)):
                    wa.append(_runs(m.hash, WINDOW, _STEP)[starts])
                    wb.append(_runs(m.hash, WINDOW, _STEP_B)[starts] >> np.uint64(32))
                    ids.append(np.full(len(starts), doc, np.int64))
                    at.append(starts.astype(np.int64))

            for doc, t, r in zip(place.tolist(), b.column("text"), b.column("recurring")):
                m = Marked(t.as_py())
                if not m.windows:
                    continue
                names.append(doc)
                shard.append((m, np.asarray(r.as_py(), np.int64).view(np.uint64)))
                held += len(t.as_py())
                if held >= SHARD_CHARS:
                    flush()
                    shard, names, held = [], [], 0
            if shard:
                flush()
            if not ids:
                continue
            a, c, d, s = np.concatenate(wa), np.concatenate(wb), np.concatenate(ids), np.concatenate(at)
            order = np.lexsort((s, d, c, a))
            a, c, d, s = a[order], c[order], d[order], s[order]
            first = np.ones(len(a), bool)
            first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            rest = ~first
            by_place = np.lexsort((s[rest], d[rest]))
            rd, rl, rh = _ranges(d[rest][by_place], s[rest][by_place])
            n = len(rd)
            yield pa.RecordBatch.from_pydict(
                {
                    "wa": np.concatenate([a[first], _mix(rd.astype(np.uint64) + (rl.astype(np.uint64) << np.uint64(32)))]).view(np.int64),
                    "wb": np.concatenate([c[first].astype(np.int64), np.full(n, -1)]),
                    **{k: v[np.concatenate([d[first], rd])] for k, v in zip(KEY, keys)},
                    "lo": np.concatenate([s[first], rl]).astype(np.int32),
                    "hi": np.concatenate([s[first], rh]).astype(np.int32),
                    "again": np.concatenate([np.zeros(int(first.sum()), bool), np.ones(n, bool)]),
                }
            )

    return docs.select(*KEY, "text", "recurring").mapInArrow(run, f"wa bigint, wb bigint, {_KEY_DDL}, lo int, hi int, again boolean")


def _other(df: DataFrame, *more: str) -> DataFrame:
    """The key under other names, so that a join can tell the sides apart."""
    return df.select(*[F.col(k).alias(f"o_{k}") for k in KEY], *more)


def _same() -> Column:
    return (F.col("late") == F.col("o_late")) & (F.col("doc") == F.col("o_doc")) & (F.col("twin") == F.col("o_twin"))


def repeats(texts: DataFrame, undealt: DataFrame) -> DataFrame:
    """(o_late, o_doc, o_twin, ranges): for documents with repeats the starts of windows that occurred before. ``texts``: key and text, dealt by key; ``undealt``: the same rows before that."""
    marks = marks_of(texts)
    recurring = cut_lineage(marks_of(undealt).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("h").alias("r_h")))
    held = marks.join(recurring, F.col("h") == F.col("r_h"), "left_semi").groupBy(*KEY).agg(F.collect_list("h").alias("recurring"))
    met = texts.join(_other(held, "recurring").hint("shuffle_hash"), _same())
    w = Window.partitionBy("wa", "wb").orderBy(*KEY, "lo")
    flagged = windows_of(met).withColumn("nth", F.row_number().over(w)).where("again OR nth > 1")
    return _other(flagged.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")


def _digests(df: DataFrame, gone: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) from (key, text, ranges); ``gone``: every window is a repeat."""
    # All uses of the dealt rows read the same columns, so that they share one exchange; the id comes back here.
    df = df.select(F.when(~F.col("late"), F.col("doc")).alias("doc_id"), *[c for c in ("text", "ranges") if c in df.columns])

    def run(c: dict) -> dict:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []}
        ranges = [None] * len(c["text"]) if "ranges" not in c else c["ranges"].to_pylist()
        for t, r in zip(c["text"], ranges):
            words = words_of(t.as_py())
            kept = words
            if gone and len(words) >= WINDOW:
                kept = []
            elif r:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [x["lo"] for x in r], 1)
                np.add.at(edge, [x["hi"] + WINDOW for x in r], -1)
                stays = edge.cumsum()[:-1] == 0
                kept = [w for w, s in zip(words, stays.tolist()) if s]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(sha256_hex(b" ".join(kept)))
        return {"doc_id": c["doc_id"], **out}

    return map_rows(df, run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def _copies(rows: DataFrame) -> DataFrame:
    """(key, first, n) of texts that occur more than once: whether the row is the earliest with its text, and how many rows are equal to it."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    owners = rows.groupBy(digest.alias("digest")).agg(F.min(F.when(~F.col("late"), F.col("doc"))).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = rows.select(*KEY, digest.alias("c_digest")).join(owners, F.col("c_digest") == F.col("digest"))
    # Rows without an id that have one text are equal, so any of them may be the first.
    first = F.when(F.col("owner").isNull(), F.lit(True)).otherwise(~F.col("late") & (F.col("doc") == F.col("owner")))
    return cut_lineage(met.select(*KEY, first.alias("first")).groupBy(*KEY, "first").agg(F.count(F.lit(1)).alias("n")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.xxhash64("text")).alias("doc"), F.xxhash64(F.lit(1), "text").alias("twin"), "text")
    copies = _copies(rows)
    aside = _other(copies.where("NOT first OR n > 1"))
    # Marks are counted where the texts lie. Then texts are dealt by key once: one exchange serves marks, automata and final digests.
    dealt = rows.repartition(*KEY)
    undealt = rows.join(aside, _same(), "left_anti")
    texts = dealt.join(aside.hint("shuffle_hash"), _same(), "left_anti")
    again = dealt.join(_other(copies.where("NOT first")).hint("shuffle_hash"), _same(), "left_semi")
    equal = _other(copies.where("first AND n > 1"))
    if not equal.isEmpty():
        # Rows equal in id and text get numbers in a written table, so that exactly one of them stays.
        twins = cut_lineage(rows.join(equal, _same(), "left_semi").withColumn("number", F.monotonically_increasing_id()))
        least = _other(twins.groupBy(*KEY).agg(F.min("number").alias("least")), "least")
        twins = twins.join(least, _same())
        one = twins.where("number = least").select(*rows.columns)
        undealt, texts = undealt.union(one), texts.union(one).repartition(*KEY)
        again = again.union(twins.where("number > least").select(*rows.columns))
    found = texts.join(repeats(texts, undealt).hint("shuffle_hash"), _same(), "left").select(*KEY, "text", "ranges")
    return _digests(found).union(_digests(again, gone=True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all ``documents``."""
    return deduplicate(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20
), h AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM s
), f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM h
), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE nth > 1
), r AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(coalesce(gone, [])) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, k: NOT list_contains(coalesce(gone, []), k)), ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
