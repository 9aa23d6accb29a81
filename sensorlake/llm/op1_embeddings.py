"""Near-duplicate vectors by a subspace pigeonhole join.

For unit vectors cosine >= t means squared distance <= 2 (1 - t). After a rotation
the dimensions are cut into low-dimensional blocks; every block has a share of that
budget in proportion to its dimensions, and a near pair is within the share of at
least one block. So each block is range-joined by itself under its share:

* Along a block's leading coordinate the rows are cut into slabs at quantiles, and
  crowded slabs into parts by hash. Only parts whose slabs are within the block's radius meet.
* In such a task rows are sorted by that coordinate, compared within a window, then
  in the block; candidates are verified by their exact cosine. A pair counts in
  the first block that finds it, so the union over blocks has each pair once.

Tasks give back link counts per row and a spanning forest, not pairs.

* a vector that is null, empty, zero or has null or non-finite components links with nothing and is kept
* equal vectors are one node with a count; they link with each other
* rows that share an id are rows each; a null id has no component of its own
* vectors of different dimensions do not link
* other columns are untouched and may have any name
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm.common import table
from sensorlake.llm.components import components, forest
from sensorlake.llm.op9_topk import finite
from sensorlake.session import cut_lineage

COSINE = 0.9
BLOCK_DIMS = 8
#: Rows of one part of a slab; bins of the leading coordinate.
PART, BINS = 24576, 2048
SLACK = 1e-9
#: What single precision may be off by in a block's product; vectors have length one.
SINGLE_SLACK = 1e-5


def rotation(d: int) -> np.ndarray:
    """A fixed orthonormal matrix: the Q of a pseudo-random matrix."""
    return np.linalg.qr(np.random.Generator(np.random.PCG64(d)).standard_normal((d, d)))[0]


def block_bounds(d: int) -> list[tuple[int, int]]:
    n = max(1, d // BLOCK_DIMS)
    edges = [round(i * d / n) for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def budgets(d: int, cosine: float) -> list[float]:
    """Squared distance per block, in proportion to its dimensions."""
    return [2 * (1 - cosine) * (b - a) / d + SLACK for a, b in block_bounds(d)]


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def unit(x: np.ndarray) -> np.ndarray:
    """Scaled to length one; by the largest component first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bin(lead: np.ndarray) -> np.ndarray:
    return np.clip(((lead + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


@dataclass
class Layout:
    """Parts of one dimension's blocks. ``first[block][bin]`` is the first part of the slab, ``parts[...]`` how many it has, ``near[part]`` the parts it meets."""

    first: np.ndarray
    parts: np.ndarray
    near: list[np.ndarray]


def layout(counts: np.ndarray, d: int, cosine: float, part: int) -> Layout:
    """``counts`` (block, bin): slabs of about ``part`` rows; a bin with more is a slab of several parts."""
    first, parts = np.zeros(counts.shape, np.int64), np.ones(counts.shape, np.int64)
    near: list[np.ndarray] = []
    for b, share in enumerate(budgets(d, cosine)):
        slabs, start, held = [], 0, 0
        for i in range(BINS):
            if held and held + counts[b, i] > part:
                slabs.append((start, i, held))
                start, held = i, 0
            held += int(counts[b, i])
        slabs.append((start, BINS, held))
        base, at = len(near), len(near)
        spans = []
        for lo, hi, n in slabs:
            k = max(1, math.ceil(n / part))
            first[b, lo:hi], parts[b, lo:hi] = at, k
            spans += [(lo, hi)] * k
            at += k
        # A bin's edge may be off by rounding, hence one bin more than the radius.
        reach = math.ceil(math.sqrt(share) * BINS / 2) + 1
        lows, highs = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
        near += [base + np.flatnonzero((lows - hi < reach) & (lo - highs < reach)) for lo, hi in spans]
    return Layout(first, parts, near)


def _histograms(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension: counts (block, bin) of the leading coordinates; at most BINS rows per block reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                r = unit(_matrix(batch.column("embedding").filter(pa.array(dims == d)), d)) @ rotation(d)
                h = seen.setdefault(d, np.zeros((len(block_bounds(d)), BINS), np.int64))
                for b, (lo, _) in enumerate(block_bounds(d)):
                    h[b] += np.bincount(_bin(r[:, lo]), minlength=BINS)
        for d, h in seen.items():
            b, i = np.nonzero(h)
            yield pa.RecordBatch.from_pydict({"dim": np.full(len(b), d, np.int32), "block": b.astype(np.int32), "bin": i.astype(np.int32), "n": h[b, i]})

    out: dict[int, np.ndarray] = {}
    for r in nodes.select("dim", "embedding").mapInArrow(run, "dim int, block int, bin int, n bigint").groupBy("dim", "block", "bin").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r.dim, np.zeros((len(block_bounds(r.dim)), BINS), np.int64))[r.block, r.bin] = r.n
    return out


def _dealt(nodes: DataFrame, layouts: dict[int, Layout]) -> DataFrame:
    """Every row once for each pair of parts that it takes part in: (dim, block, low, high, part, node, copies, embedding)."""
    kind = dict(nodes.dtypes)["embedding"]
    schema = f"dim int, block int, low bigint, high bigint, part bigint, node bigint, copies bigint, embedding {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                of = batch.filter(pa.array(dims == d))
                x = _matrix(of.column("embedding"), d)
                r, node = unit(x) @ rotation(d), of.column("node").to_numpy().astype(np.int64)
                lay = layouts[d]
                mixed = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for b, (lo, _) in enumerate(block_bounds(d)):
                    bins = _bin(r[:, lo])
                    part = lay.first[b, bins] + (mixed % lay.parts[b, bins].astype(np.uint64)).astype(np.int64)
                    times = np.array([len(lay.near[p]) for p in part])
                    row = np.repeat(np.arange(len(part)), times)
                    other = np.concatenate([lay.near[p] for p in part])
                    mine = part[row]
                    for at in range(0, len(row), 8192):
                        s = slice(at, at + 8192)
                        take = of.take(pa.array(row[s]))
                        yield pa.RecordBatch.from_arrays(
                            [
                                take.column("dim").cast(pa.int32()), pa.array(np.full(len(row[s]), b, np.int32)), pa.array(np.minimum(mine, other)[s]), pa.array(np.maximum(mine, other)[s]),
                                pa.array(mine[s]), take.column("node"), take.column("copies"), take.column("embedding"),
                            ],
                            names=["dim", "block", "low", "high", "part", "node", "copies", "embedding"],
                        )

    return nodes.select("dim", "node", "copies", "embedding").mapInArrow(run, schema)


def near_pairs(x: np.ndarray, y: np.ndarray, b: int, cosine: float, same: bool, rows: int = 256, columns: int = 4096, most: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs with cosine at least ``cosine`` that block ``b`` is the first to find. ``same``: x is y, each pair once.

    Tiles are compared in single precision with some slack, by one product of vectors
    that carry half their squared length: a.b - |a|^2 / 2 - |b|^2 / 2. What passes is judged in double precision.
    """
    ux, uy = unit(x), unit(y)
    q, bounds, share = rotation(x.shape[1]), block_bounds(x.shape[1]), budgets(x.shape[1], cosine)
    rx, ry = ux @ q, uy @ q
    lo, hi = bounds[b]
    radius = math.sqrt(share[b])
    order_x, order_y = np.argsort(rx[:, lo], kind="stable"), np.argsort(ry[:, lo], kind="stable")
    lead = ry[order_y, lo]
    half = lambda m: (m * m).sum(axis=1, keepdims=True) / 2
    bx, by = rx[order_x, lo:hi], ry[order_y, lo:hi]
    ax = np.hstack([bx, -half(bx), np.ones((len(bx), 1))]).astype(np.float32)
    ay = np.ascontiguousarray(np.hstack([by, np.ones((len(by), 1)), -half(by)]).astype(np.float32).T)
    least = np.float32(-share[b] / 2 - SINGLE_SLACK)
    for at in range(0, len(x), rows):
        i_rows = order_x[at : at + rows]
        s, e = np.searchsorted(lead, bx[at, 0] - radius, "left"), np.searchsorted(lead, bx[at + len(i_rows) - 1, 0] + radius, "right")
        for start in range(s, e, columns):
            hits = np.flatnonzero(ax[at : at + rows] @ ay[:, start : min(e, start + columns)] >= least)
            if not len(hits):
                continue
            i, j = np.divmod(hits, min(e, start + columns) - start)
            i, j = i_rows[i], order_y[start + j]
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            for cut in range(0, len(i), most):
                p, r = i[cut : cut + most], j[cut : cut + most]
                for c in (b, *range(b)):
                    if not len(p):
                        break
                    diff = rx[p, bounds[c][0] : bounds[c][1]] - ry[r, bounds[c][0] : bounds[c][1]]
                    inside = np.einsum("ij,ij->i", diff, diff) <= share[c]
                    keep = inside if c == b else ~inside
                    p, r = p[keep], r[keep]
                if len(p):
                    near = np.einsum("ij,ij->i", ux[p], uy[r]) >= cosine
                    if near.any():
                        yield p[near], r[near]


def join(nodes: DataFrame, cosine: float = COSINE, part: int = PART) -> DataFrame:
    """(a, b, n): rows with b null say that node a has n links; others link a and b and span all components. ``nodes``: node, copies, embedding (distinct vectors)."""
    nodes = nodes.withColumn("dim", F.size("embedding"))
    layouts = {d: layout(h, d, cosine, part) for d, h in _histograms(nodes).items()}

    def run(key: tuple, group: pa.Table) -> pa.Table:
        d, b, low, high = (k.as_py() for k in key)
        parts = group.column("part").to_numpy()
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        x = _matrix(group.column("embedding"), d)
        left, right = np.flatnonzero(parts == low), np.flatnonzero(parts == high)
        links = np.zeros(len(node), np.int64)
        ea, eb = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in near_pairs(x[left], x[right], b, cosine, low == high):
            i, j = left[i], right[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = forest(len(node), np.concatenate([ea, i]), np.concatenate([eb, j]))
            ea = np.flatnonzero(root != np.arange(len(node)))
            eb = root[ea]
        some = np.flatnonzero(links)
        a = np.concatenate([node[some], node[ea]]).astype(np.int64)
        other = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[eb].astype(np.int64))])
        return pa.table({"a": pa.array(a), "b": other, "n": pa.array(np.concatenate([links[some], np.zeros(len(ea), np.int64)]))})

    return _dealt(nodes, layouts).groupBy("dim", "block", "low", "high").applyInArrow(run, "a bigint, b bigint, n bigint")


def deduplicate(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding)."""
    usable = finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    text = F.concat_ws(",", F.transform("embedding", lambda x: x.cast("string")))
    tagged = cut_lineage(vectors.select("vec_id", "embedding", F.when(usable, F.sha2(text.cast("binary"), 256)).alias("digest")))
    good = tagged.where("digest IS NOT NULL")
    reps = good.groupBy("digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # Ids may repeat with different vectors, so nodes are numbered by the digest, the smallest id is kept beside it.
    reps = reps.withColumn("node", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"))
    first = good.join(reps.withColumnRenamed("digest", "r_digest"), (F.col("digest") == F.col("r_digest")) & (F.col("vec_id") == F.col("least"))).select("node", "copies", "embedding")
    nodes = cut_lineage(first.dropDuplicates(["node"]))
    found = cut_lineage(join(nodes, cosine))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("c_node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL"))
    placed = reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy(F.col("root").alias("l_root")).agg(F.min("least").alias("component_id"))
    placed = placed.join(lowest, F.col("root") == F.col("l_root")).join(counts, F.col("node") == F.col("c_node"), "left")
    placed = placed.select(F.col("digest").alias("p_digest"), "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    key = F.coalesce("digest", F.concat(F.lit("none "), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))))
    out = tagged.select("vec_id", key.alias("key")).join(placed, F.col("key") == F.col("p_digest"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all of ``embeddings`` at cosine 0.9."""
    return deduplicate(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS MATERIALIZED (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS len FROM e
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) / (a.len * b.len) >= 0.9
), r(root, node) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.root, l.b FROM r JOIN l ON r.node = l.a
), c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node
), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT x.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, x.vec_id = c.component_id AS kept
FROM embeddings x JOIN c ON c.node = x.vec_id LEFT JOIN k ON k.a = x.vec_id
"""
