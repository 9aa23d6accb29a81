"""Connected components of a table of links, by alternating large-star and small-star steps.

Every round is two grouped minima and two joins on written tables; nothing but
two counts per round reaches the driver. A node with very many neighbours is a
skewed join key, which Spark splits, and minima are reduced before the shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another one; root is the smallest node reachable.

    Null ends and links of a node to itself are ignored. An empty table gives an empty one.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        # Done when each node hangs on one root and no root hangs on another node.
        roots = edges.select(F.col("v").alias("u")).distinct()
        flags = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(roots.withColumn("root", F.lit(1)), "u", "left").where("n > 1 OR root = 1")
        if flags.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = cut_lineage(_small_star(_large_star(edges)))


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links x - y, within one task."""
    root = np.arange(n)
    while x.size:
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[x] != root[y]
        # What hangs below a root follows it, so links are carried on between roots.
        x, y = root[x[open_]], root[y[open_]]
    return root
