"""SimHash near-duplicates by pivot distance tables.

A fingerprint's Hamming distances to many reference fingerprints (pivots) are
its coordinates. By the triangle inequality two fingerprints within ``bits`` of
each other differ by at most ``bits`` in every coordinate. That bound is used twice:

* The first coordinates split the distinct fingerprints into cells at their
  medians; the two halves overlap by ``bits``, so each near pair shares a cell.
  Cells that are still large are split at further pivots.
* Inside a cell the table of further coordinates discards pairs by their largest
  difference; survivors are verified by their exact distance.

A cell gives back a spanning forest of its links, not its pairs; components
of the forests are those of all links.

* null or empty text: fingerprint zero, linked like any other
* rows with one fingerprint, however many, are one node; their ids are reduced to the smallest before the shuffle
* null id: a row of its own whose id is never a component's; component_id is null if no row of the component has an id
* other columns are untouched and may have any name
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorlake.llm.common import map_rows, packed, table, unpacked, words_of
from sensorlake.llm.components import components, forest
from sensorlake.session import cut_lineage

BITS = 2
SHINGLE = 3
SEED = 42
#: Pivots that may split cells, and pivots of the table inside a cell.
SPLITS, TABLE = 48, 12
#: Size that the first splits aim at, and size above which a cell is split again.
CELL, MAX_CELL = 1024, 4096


def _pivots(n: int) -> list[int]:
    """Reference fingerprints: hashes of their own number."""
    return [xxhash.xxh64_intdigest(f"pivot {i}".encode(), 7) for i in range(n)]


def fingerprint(text: str | None) -> int:
    words = [w.lower() for w in words_of(text)]
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, mark): the fingerprint as a signed long, and a hash of the text that tells rows of one id apart."""
    kind = dict(docs.dtypes)[key]

    def run(c: dict) -> dict:
        fp = np.fromiter((fingerprint(t.as_py()) for t in c["text"]), np.uint64, len(c["text"]))
        return {"key": c["key"], "fp": fp.view(np.int64), "mark": c["mark"]}

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _mark(text).alias("mark"))
    return map_rows(rows, run, f"key {kind}, fp bigint, mark bigint").withColumnRenamed("key", key)


def _mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _medians(nodes: DataFrame, pivots: list[int], bits: int) -> list[int]:
    """Per pivot the cut that halves the nodes best; the histograms have at most 65 rows per pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(pivots), 65), np.int64)
        for b in batches:
            fp = _unsigned(b.column("fp"))
            for i, p in enumerate(pivots):
                seen[i] += np.bincount(np.bitwise_count(fp ^ np.uint64(p)), minlength=65)
        i, d = np.nonzero(seen)
        yield pa.RecordBatch.from_pydict({"pivot": i.astype(np.int32), "d": d.astype(np.int32), "n": seen[i, d]})

    total = np.zeros((len(pivots), 65), np.int64)
    for r in nodes.select("fp").mapInArrow(run, "pivot int, d int, n bigint").groupBy("pivot", "d").agg(F.sum("n").alias("n")).collect():
        total[r.pivot, r.d] = r.n
    low = total.cumsum(axis=1)
    high = total.sum(axis=1, keepdims=True) - np.hstack([np.zeros((len(pivots), bits), np.int64), low[:, :-bits]])
    return [int(m) for m in np.maximum(low, high).argmin(axis=1)]


def _split(fp: np.ndarray, cell: np.ndarray, levels: range, pivots: list[int], cuts: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Low half: coordinate up to the cut. High half: coordinate above the cut minus ``bits``. A pair within ``bits`` shares one of them."""
    for i in levels:
        d = np.bitwise_count(fp ^ np.uint64(pivots[i])).astype(np.int64)
        low, high = d <= cuts[i], d > cuts[i] - bits
        fp = np.concatenate([fp[low], fp[high]])
        cell = np.concatenate([cell[low] * 2, cell[high] * 2 + 1])
    return fp, cell


def _assign(rows: DataFrame, levels: range, pivots: list[int], cuts: list[int], bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, cell = _split(_unsigned(b.column("fp")), b.column("cell").to_numpy(zero_copy_only=False).astype(np.int64), levels, pivots, cuts, bits)
            yield pa.RecordBatch.from_pydict({"cell": cell, "fp": fp.view(np.int64)})

    return rows.select("cell", "fp").mapInArrow(run, "cell bigint, fp bigint")


def near_in_cell(fp: np.ndarray, bits: int, pivots: list[int], block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs within ``bits``: positions and the position of their root."""
    n = len(fp)
    coords = np.bitwise_count(fp[:, None] ^ np.array(pivots, np.uint64)[None, :])
    order = np.argsort(coords[:, 0], kind="stable")
    fp, coords = fp[order], coords[order]
    ends = np.searchsorted(coords[:, 0], coords[:, 0].astype(np.int64) + bits, side="right")
    x, y = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, n, block):
        to = min(n, at + block)
        end = int(ends[to - 1])
        for start in range(at, end, 8 * block):
            stop = min(end, start + 8 * block)
            # |a - b| <= bits in unsigned bytes
            i, j = np.nonzero((coords[at:to, 1][:, None] - coords[start:stop, 1][None, :] + np.uint8(bits)) <= 2 * bits)
            i, j = i + at, j + start
            keep = (i < j) & (j < ends[i])
            i, j = i[keep], j[keep]
            for c in range(2, coords.shape[1]):
                keep = (coords[i, c] - coords[j, c] + np.uint8(bits)) <= 2 * bits
                i, j = i[keep], j[keep]
            keep = np.bitwise_count(fp[i] ^ fp[j]) <= bits
            if keep.any():
                root = forest(n, np.concatenate([x, i[keep]]), np.concatenate([y, j[keep]]))
                x = np.flatnonzero(root != np.arange(n))
                y = root[x]
    return order[x], order[y]


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that span the same components as all pairs within ``bits``."""
    pivots = _pivots(SPLITS + TABLE)
    count = nodes.count()
    first = min(SPLITS, max(0, math.ceil(math.log(max(1, count / CELL)) / math.log(1 / 0.6))))
    cuts = _medians(nodes, pivots[:SPLITS], bits) if first else []
    rows = _assign(nodes.withColumn("cell", F.lit(1).cast("long")), range(first), pivots, cuts, bits) if first else nodes.select(F.lit(1).cast("long").alias("cell"), "fp")
    done: list[DataFrame] = []
    level = first
    while level and level < SPLITS:
        # Only cells that are still large go on; their number is what the driver learns.
        rows = cut_lineage(rows)
        large = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_CELL).select("cell")
        if large.isEmpty():
            break
        done.append(rows.join(large, "cell", "left_anti").withColumn("level", F.lit(level)))
        to = min(SPLITS, level + 6)
        rows = _assign(rows.join(large, "cell", "left_semi"), range(level, to), pivots, cuts, bits)
        level = to
    cells = rows.withColumn("level", F.lit(level))
    for d in done:
        cells = cells.unionByName(d)
    table_pivots = pivots[SPLITS:]

    def verify(group: pa.Table) -> pa.Table:
        fp = _unsigned(group.column("fp").combine_chunks())
        x, y = near_in_cell(fp, bits, table_pivots)
        signed = fp.view(np.int64)
        return pa.table({"a": signed[x], "b": signed[y]})

    return cells.groupBy("level", "cell").applyInArrow(verify, "a bigint, b bigint")


def _rooted(docs: DataFrame, key: str, text: str, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written (key, fp, mark) per row; (fp, least) per fingerprint; (node, root) per fingerprint with a link."""
    prints = cut_lineage(fingerprints(docs, key, text))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min(key).alias("least")))
    return prints, nodes, components(links(nodes.select("fp"), bits))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(key, fp, component_id) per row of ``docs``."""
    prints, nodes, roots = _rooted(docs, key, text, bits)
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Nodes without a link keep their own smallest id; only linked ones are grouped.
    linked = placed.join(roots.select(F.col("root").alias("_r")).distinct(), F.col("root") == F.col("_r"), "left")
    alone = linked.where("_r IS NULL").select("fp", F.col("least").alias("component_id"))
    grouped = linked.where("_r IS NOT NULL")
    whole = grouped.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    named = alone.unionByName(grouped.join(whole, F.col("root") == F.col("_root")).select("fp", "component_id"))
    return prints.join(named, "fp", "left").select(key, "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with exactly one row per component.

    That with the smallest doc_id stays; of rows that share it, the one with the smallest fingerprint, then the
    smallest hash of its text; of rows alike in all of these, any one. A component without any id keeps a row as well.
    """
    prints, _, roots = _rooted(docs, "doc_id", "text", BITS)
    # Rows of one fingerprint are reduced first, then the fingerprints of a component.
    first = lambda c: F.min(c).alias("first")
    of_print = prints.groupBy("fp").agg(first(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "mark")))
    rooted = of_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    stay = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(first("first")).select(F.col("first.doc_id").alias("stay_id"), F.col("first.mark").alias("stay_mark"))
    rows = packed(docs, "doc_id", _mark("text").alias("mark"))
    kept = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("mark") == F.col("stay_mark")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("mark"))
    return unpacked(kept.withColumn("nth", nth).where("nth = 1").select("row"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: components of all ``documents`` under fingerprints that differ in at most two bits."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
