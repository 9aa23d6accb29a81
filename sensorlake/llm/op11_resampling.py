"""Importance resampling of documents towards a target distribution.

Features (runs of words, hashed into ``BUCKETS`` buckets) are counted over all documents
and over all target texts. A bucket's gain is the scaled logarithm of the ratio of
both frequencies; the gains are one array of ``BUCKETS`` longs, and a document's
weight is the floored mean of the gains at its features' places in that array. A Gumbel key by
the hash of the id is added, so the highest scores are a draw without replacement.

The cutoff, the score of the last drawn document, is found without sorting
all documents, by weighted medians of medians over the written scores:

1. Each Arrow batch of keys gives its median and each partition the median of its batches' medians,
   weighted by how many keys are left in them; the driver takes the median of the partitions, weighted alike.
2. At least an eighth of the keys left lies on either side of it (half of half of half). Keys are
   counted on both sides in the pass that also finds both sides' next medians; the side without the cutoff goes.
3. When few keys are left by then, they are written anew, so later passes read less; the last ``FEW`` are ordered and give the exact key.

Only winners are sorted: dealt by ranges of keys, ordered within their range, and
numbered by the counts of the ranges before.

Defined results:

* null or empty text: no feature, weight 0, fewer words than asked for, so never drawn
* null id: hashes as an empty id and comes last among equal scores
* equal scores: the smaller id is drawn; rows that share id and score are drawn by fewer features first, whole duplicates in any order, one rank each
* an empty table or no document with enough words: nothing is drawn; an empty target: all its counts are 0
* other columns are untouched and may have any name
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from sensorlake.llm.common import map_rows, table, text_bytes
from sensorlake.session import cut_lineage

LONGEST_RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
SCALE = 1000
#: Keys that the driver orders at the end, and partitions' medians that it takes at once.
FEW, MEDIANS = 4096, 4096

#: A-Z lowered; every other ASCII character but a letter or digit becomes a blank; bytes above ASCII stay.
LOWERED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 or b >= 0x80 else 0x20 for b in range(256))

#: A place in the order of keys: minus the score, whether the id is null, the id, the number of features, the number of the row.
KEY = ["neg", "no_id", "doc_id", "n_features", "row"]
Key = tuple[int, int, int, int, int]


class _Buckets(dict):
    """Bucket of each feature, remembered for a bounded number of them."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.buckets
        return out


def features(text: str | None, longest: int = LONGEST_RUN) -> tuple[int, Iterator[bytes], int]:
    """(words, runs of 1 to ``longest`` consecutive words, their number)."""
    words = text_bytes(text).translate(LOWERED).split()
    if longest == 1:
        return len(words), iter(words), len(words)
    runs = (b" ".join(run) for n in range(1, longest + 1) for run in zip(*(islice(words, i, None) for i in range(n))))
    return len(words), runs, sum(max(0, len(words) - n + 1) for n in range(1, longest + 1))


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: one array per task, added up by Spark; ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0):
                _, runs, n = features(t.as_py(), longest)
                if n:
                    seen += np.bincount(np.fromiter(map(place.__getitem__, runs), np.int64, n), minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "n": seen[at]})

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text)).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(SCALE * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) per bucket, in doubles."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (float(source.sum()) + len(s)) / ((s + 1) * (float(target.sum()) + len(t)))
    return np.array([math.floor(SCALE * math.log(x)) for x in ratio.tolist()], np.int64)


def gumbel(key: str, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per row of ``docs``."""
    size = len(gain)

    def run(c: dict) -> dict:
        place = _Buckets(size)
        out: dict[str, list] = {"n_words": [], "n_features": [], "weight": [], "score": []}
        for key, t in zip(c["doc_id"].to_pylist(), c["text"]):
            words, runs, n = features(t.as_py(), longest)
            weight = int(gain[np.fromiter(map(place.__getitem__, runs), np.int64, n)].sum()) // n if n else 0
            for name, v in zip(out, (words, n, weight, weight + gumbel("" if key is None else str(key), seed))):
                out[name].append(v)
        return {"doc_id": c["doc_id"], **out}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def _sorted(keys: np.ndarray) -> np.ndarray:
    return keys[np.lexsort(keys.T[::-1])]


def _below(keys: np.ndarray, pivot: Key) -> np.ndarray:
    """Which rows come before the pivot."""
    out = np.zeros(len(keys), bool)
    same = np.ones(len(keys), bool)
    for c, v in enumerate(pivot):
        out |= same & (keys[:, c] < v)
        same &= keys[:, c] == v
    return out


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The first median at which half of the weight is reached."""
    medians = sorted(medians)
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in medians:
        seen += n
        if seen >= half:
            return key
    raise ValueError("no medians")


SIDE = "side int, n bigint, " + ", ".join(f"{c} bigint" for c in KEY)
#: Sides of a pivot: keys up to it and keys after it.
UP_TO, AFTER = 0, 1


def _medians(keys: DataFrame, low: Key | None, high: Key | None, pivot: Key | None) -> dict[int, list[tuple[Key, int]]]:
    """Per side of the pivot the partitions' medians and sizes, of the keys after ``low`` and up to ``high``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[Key, int]]] = {UP_TO: [], AFTER: []}
        for b in batches:
            k = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1) if b.num_rows else np.zeros((0, len(KEY)), np.int64)
            if low is not None:
                k = k[~_below(k, low[:-1] + (low[-1] + 1,))]
            if high is not None:
                k = k[_below(k, high[:-1] + (high[-1] + 1,))]
            first = _below(k, pivot[:-1] + (pivot[-1] + 1,)) if pivot is not None else np.zeros(len(k), bool)
            for side, part in ((UP_TO, k[first]), (AFTER, k[~first])):
                if len(part):
                    part = _sorted(part)
                    found[side].append((tuple(part[(len(part) - 1) // 2].tolist()), len(part)))
        sides = [(side, sum(n for _, n in m), *weighted_median(m)) for side, m in found.items() if m]
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in sides], pa.int32() if i == 0 else pa.int64()) for i in range(2 + len(KEY))], names=["side", "n", *KEY])

    out = keys.select(*KEY).mapInArrow(run, SIDE)
    if (parts := keys.rdd.getNumPartitions()) > MEDIANS:
        out = out.repartition(max(1, parts // MEDIANS)).mapInArrow(_merged, SIDE)
    sides: dict[int, list[tuple[Key, int]]] = {UP_TO: [], AFTER: []}
    for r in out.collect():
        sides[r.side].append((tuple(r[c] for c in KEY), r.n))
    return sides


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One more level of medians, where there are very many partitions."""
    for b in batches:
        rows = b.to_pylist()
        sides = []
        for side in (UP_TO, AFTER):
            if m := [(tuple(r[c] for c in KEY), r["n"]) for r in rows if r["side"] == side]:
                sides.append((side, sum(n for _, n in m), *weighted_median(m)))
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in sides], pa.int32() if i == 0 else pa.int64()) for i in range(2 + len(KEY))], names=["side", "n", *KEY])


def cutoff(keys: DataFrame, k: int, few: int | None = None, told: Callable[[int, int], None] | None = None) -> Key | None:
    """The key of place ``k`` (from 1) in the order of ``KEY``; None if k is 0. ``told`` hears the keys left before and after each pass."""
    if k <= 0:
        return None
    few = FEW if few is None else few
    low = high = None
    sides = _medians(keys, None, None, None)
    medians, left = sides[AFTER], sum(n for _, n in sides[AFTER])
    held = left
    while left > few:
        pivot = weighted_median(medians)
        sides = _medians(keys, low, high, pivot)
        before = left
        up_to = sum(n for _, n in sides[UP_TO])
        if k <= up_to:
            high, medians, left = pivot, sides[UP_TO], up_to
        else:
            low, medians, left, k = pivot, sides[AFTER], left - up_to, k - up_to
        if told:
            told(before, left)
        if left > few and 16 * left < held:
            keys, held = cut_lineage(_between(keys, low, high)), left
    rest = sorted(tuple(r) for r in _between(keys, low, high).select(*KEY).collect())
    return rest[k - 1]


def _place(values: Key) -> F.Column:
    return F.struct(*[F.lit(v).cast("int" if c == "no_id" else "long").alias(c) for c, v in zip(KEY, values)])


def _between(keys: DataFrame, low: Key | None, high: Key | None) -> DataFrame:
    at = F.struct(*KEY)
    if low is not None:
        keys = keys.where(at > _place(low))
    return keys if high is None else keys.where(at <= _place(high))


def ranked(winners: DataFrame) -> DataFrame:
    """``rank`` from 1 in the order of ``KEY``: rows are dealt by ranges and numbered within them, a range starts where the ones before end."""
    schema = StructType([*winners.schema.fields, StructField("part", LongType()), StructField("nth", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            b = b.append_column("part", pa.array(np.full(b.num_rows, part, np.int64)))
            yield b.append_column("nth", pa.array(np.arange(at + 1, at + 1 + b.num_rows, dtype=np.int64)))
            at += b.num_rows

    ordered = winners.repartitionByRange(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, schema)
    ordered = cut_lineage(ordered)
    # One row per range.
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", start.alias("start"))
    return ordered.join(starts, "part").withColumn("rank", F.col("start") + F.col("nth")).drop("part", "nth", "start")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST_RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of ``docs``; both tables have ``text``."""
    gain = gains(bucket_counts(docs, longest=longest, buckets=buckets), bucket_counts(target, longest=longest, buckets=buckets))
    rows = scored(docs, gain, longest, seed).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("neg", -F.col("score")).withColumn("no_id", F.col("doc_id").isNull().cast("int")).withColumn("id", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    rows = cut_lineage(rows)
    eligible = rows.where(F.col("n_words") >= least_words)
    k = percent * eligible.count() // 100
    last = cutoff(eligible, k)
    if last is None:
        return rows.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & (F.struct(*KEY) <= _place(last))
    out = ranked(rows.where(drawn)).unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: ``documents`` drawn towards the texts of ``benchmark``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH RECURSIVE step AS (SELECT range AS i, range AS c, 0 AS n FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM step WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS c FROM step WHERE n = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM d) GROUP BY w),
tw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM b) GROUP BY w),
place AS (SELECT w, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda a, x: xor(a >> 8, crc.c[xor(a & 255, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM sw UNION SELECT w FROM tw), crc),
s AS (SELECT bucket, sum(n) AS n FROM sw JOIN place USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM tw JOIN place USING (w) GROUP BY bucket),
total AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t),
gain AS (SELECT range AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (total.s + 10000) / ((coalesce(s.n, 0)::DOUBLE + 1) * (total.t + 10000)))) AS BIGINT) AS gain
  FROM range(10000) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range, total),
of AS (SELECT w, gain FROM place JOIN gain USING (bucket)),
num AS (SELECT row_number() OVER () AS row, * FROM d),
mean AS (SELECT row, sum(gain)::BIGINT AS total, count(*) AS n FROM (SELECT row, unnest(words) AS w FROM num) JOIN of USING (w) GROUP BY row),
weighed AS (SELECT num.row, doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight,
  CAST('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8) AS BIGINT) AS h FROM num LEFT JOIN mean ON mean.row = num.row),
score AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
k AS (SELECT 10 * count(*) // 100 AS k FROM score WHERE n_features >= 20),
won AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM score WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= k THEN rank END AS BIGINT) AS rank FROM score LEFT JOIN won ON won.row = score.row, k
"""
