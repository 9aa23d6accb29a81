"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to whole numbers. A block of rows holds one bitmap per
dimension and bit of the value (a slice). For a query the slices of all
dimensions are added as bitmaps, weighted by the bits of the query's components,
which gives the slices of the scores of the whole block at once. From the most
significant score slice downward rows are taken as certain or kept as boundary;
when few are left, their scores are computed exactly and ties resolved.
Queries meet blocks of rows; the best of each block are merged by Spark.

* a null vector, one with null or non-finite components, or a null id takes no part
* vectors are compared with those of their own dimension
* rows that share a query's id are its own; of several, the smallest vector is the query
* repeated rows are candidates each
* components of any finite size count exactly; a score beyond a long is ranked by its true value and shown as the nearest long
* no candidates: no rows for the query; empty vectors score 0
* other columns are untouched and may have any name
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.llm.common import table

K = 5
SCALE = 256
#: Rows of a block at most, blocks that a small table is still cut into and their least size, queries that meet a block in one task.
BLOCK_ROWS, SPREAD, LEAST_ROWS, CHUNK_QUERIES = 32768, 8, 2048, 512
#: Components from this size on are taken as whole numbers without a bound; below, their quantised values have 40 bits at most.
WIDE = 2.0**32


def finite(v: Column) -> Column:
    """A vector without null or non-finite components."""
    d = lambda x: x.cast("double")
    return v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(d(x)) & (F.abs(d(x)) < F.lit(float("inf"))), F.lit(False)))


def quantised(column: pa.Array) -> np.ndarray:
    """(rows, dimensions) of floor(SCALE * x); all rows have one length. Whole numbers of any size where longs do not hold them safely."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    shape = (len(column), len(flat) // len(column) if len(column) else 0)
    if not flat.size or np.abs(flat).max() < WIDE:
        return np.floor(SCALE * flat).astype(np.int64).reshape(shape)
    whole = np.empty(len(flat), object)
    whole[:] = [math.floor(SCALE * x) if abs(x) < WIDE else int(x) * SCALE for x in flat.tolist()]
    return whole.reshape(shape)


def _bits(values: np.ndarray) -> int:
    """Bits of the largest size among the values."""
    return int(np.abs(values).max()).bit_length() if values.size else 0


def sortable(score: int) -> bytes:
    """Bytes in the order of the numbers, whatever their size."""
    n = -(-abs(score).bit_length() // 8)
    size = n.to_bytes(4, "big") + abs(score).to_bytes(n, "big")
    return b"\x01" + size if score >= 0 else b"\x00" + bytes(255 - x for x in size)


class SlicedBlock:
    """Slices of a block's rows, which are sorted by id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        n, d = values.shape
        self.words = max(1, -(-n // 64))
        low = self.values.min(axis=0) if n else np.zeros(d, np.int64)
        above = self.values - low if n else self.values
        self.bits = max(1, _bits(above))
        self.size = _bits(self.values)
        # The bytes of each number, lowest first; longs have theirs in place.
        octets = -(-self.bits // 8)
        if above.dtype == object:
            raw = np.frombuffer(b"".join(v.to_bytes(octets, "little") for v in above.ravel().tolist()), np.uint8).reshape(n, d, octets)
        else:
            raw = np.ascontiguousarray(above, "<i8").view(np.uint8).reshape(n, d, 8) if n and d else np.zeros((n, d, octets), np.uint8)
        slices = np.empty((2, d, self.bits, self.words), np.uint64)
        of_slice = np.zeros((d, self.words * 64), np.uint8)
        for b in range(self.bits):
            of_slice[:, :n] = (raw[:, :, b // 8] >> (b % 8) & 1).T
            slices[0, :, b] = np.packbits(of_slice, axis=1, bitorder="little").view(np.uint64)
        slices[1] = ~slices[0]  # the largest value minus this one, for components below zero
        self.slices = slices
        exist = np.zeros(self.words * 64, np.uint8)
        exist[:n] = 1
        self.exist = np.packbits(exist, bitorder="little").view(np.uint64)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of pairs of bit-sliced numbers (pairs, slices, words): a ripple of carries over bitmaps."""
    if a.shape[1] < b.shape[1]:
        a, b = b, a
    out = np.empty((a.shape[0], a.shape[1] + 1, a.shape[2]), np.uint64)
    carry = None
    for i in range(a.shape[1]):
        x = a[:, i]
        if i < b.shape[1]:
            y = b[:, i]
            half = x ^ y
            if carry is None:
                out[:, i], carry = half, x & y
            else:
                out[:, i] = half ^ carry
                carry = (x & y) | (half & carry)
        else:
            out[:, i] = x ^ carry
            carry = x & carry
    out[:, -1] = carry
    return out


def add_all(numbers: np.ndarray) -> np.ndarray:
    """Sum over the first axis, by halves."""
    while numbers.shape[0] > 1:
        h = numbers.shape[0] // 2
        total = add(numbers[:h], numbers[h : 2 * h])
        if numbers.shape[0] % 2:
            rest = np.zeros((1, *total.shape[1:]), np.uint64)
            rest[0, : numbers.shape[1]] = numbers[-1]
            total = np.concatenate([total, rest])
        numbers = total
    return numbers


def score_slices(block: SlicedBlock, q: np.ndarray) -> np.ndarray:
    """Slices of sum |q_d| * (v_d - low_d, or high_d - v_d where q_d < 0): the score up to a constant of the block."""
    size = np.abs(q)
    total = np.zeros((1, 1, block.words), np.uint64)
    for j in range(_bits(size))[::-1]:
        doubled = np.zeros((1, total.shape[1] + 1, block.words), np.uint64)
        doubled[:, 1:] = total
        d = np.flatnonzero((size >> j & 1).astype(bool))
        total = add(doubled, add_all(block.slices[(q[d] < 0).astype(np.int64), d])) if d.size else doubled
    return total[0]


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best_rows(block: SlicedBlock, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(id, score) of the k best rows of the block, ties to smaller ids."""
    sure, open_ = np.zeros_like(block.exist), block.exist.copy()
    own = slice(np.searchsorted(block.ids, query_id, "left"), np.searchsorted(block.ids, query_id, "right"))
    for i in range(own.start, own.stop):
        open_[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
    left = int(np.bitwise_count(open_).sum())
    taken = 0
    if left > 4 * k:
        slices = score_slices(block, q)
        for s in slices[::-1]:
            ones = open_ & s
            n = int(np.bitwise_count(ones).sum())
            if taken + n >= k:
                open_, left = ones, n
            else:
                sure, open_, taken, left = sure | ones, open_ & ~s, taken + n, left - n
            if left <= 4 * k:
                break
    # Rows are in the order of their ids: of more boundary rows than that, all slices agree, so the first ones win the tie.
    rows = np.concatenate([_rows_of(sure), _rows_of(open_)[: 4 * k + k]])
    narrow = block.size + _bits(q) + len(q).bit_length() < 63
    values = block.values[rows]
    scores = values @ q if narrow else [sum(a * b for a, b in zip(v, q.tolist())) for v in values.tolist()]
    best = sorted(zip((-int(s) for s in scores), block.ids[rows].tolist()))[:k]
    return [(i, -s) for s, i in best]


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): both sides have vec_id and embedding."""
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    queries = queries.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    n, nq = rows.count(), queries.count()
    blocks = max(1, math.ceil(n / BLOCK_ROWS), min(SPREAD, math.ceil(n / LEAST_ROWS)))
    chunks = max(1, math.ceil(nq / CHUNK_QUERIES))
    place = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # Rows with very large components need many slices, so they have blocks of their own.
    wide = F.exists("embedding", lambda x: F.abs(x.cast("double")) >= WIDE)
    left = rows.withColumn("wide", wide).withColumn("block", place(blocks, 1)).withColumn("chunk", every(chunks))
    right = queries.withColumn("wide", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("chunk", place(chunks, 2)).withColumn("block", every(blocks))
    keys = ["dim", "wide", "block", "chunk"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": [], "place": []}
        if a.num_rows and b.num_rows:
            ids = a.column("vec_id").to_numpy().astype(np.int64)
            block = SlicedBlock(ids, quantised(a.column("embedding").combine_chunks()))
            for qid, q in zip(b.column("vec_id").to_pylist(), quantised(b.column("embedding").combine_chunks())):
                for vec, s in best_rows(block, qid, q, k):
                    out["query_id"].append(qid)
                    out["vec_id"].append(vec)
                    out["score"].append(min(max(s, -(2**63)), 2**63 - 1))
                    out["place"].append(sortable(s))
        return pa.table({n: pa.array(v, pa.binary() if n == "place" else pa.int64()) for n, v in out.items()})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint, place binary")
    w = Window.partitionBy("query_id").orderBy(F.desc("place"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the rows of ``embeddings`` whose id is divisible by 50 against all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 50 = 0"))


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
