"""Convex hull areas."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.operators.ordered import _null_safe
from sensorlake.session import cut_lineage

DIRECTIONS = 16


def hull_areas(points: DataFrame, keys: Sequence[str], x: str, y: str, rounds: int = 2) -> DataFrame:
    """Area of the convex hull per key.

    Points inside the polygon spanned by the extremes in 16 directions (a
    hash aggregate) cannot be hull points and go first.  What is left is reduced
    batch by batch to the batch's own hull vertices, twice with a reshuffle in
    between, since the hull of hulls is the hull.  Only those vertices meet.
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    dirs = [(math.cos(2 * math.pi * i / DIRECTIONS), math.sin(2 * math.pi * i / DIRECTIONS)) for i in range(DIRECTIONS)]
    # Both coordinates of a direction change on the same rows, so they stay those of one point.
    ext = points.groupBy(*keys).agg(*[F.max_by(v, px * a + py * b).alias(f"_e{n}{i}") for i, (a, b) in enumerate(dirs) for n, v in (("x", px), ("y", py))])
    ext = cut_lineage(ext)
    j = points.select(*keys, px.alias("_x"), py.alias("_y"))
    j = _null_safe(j, ext, keys, "inner")
    tip = [(F.col(f"_ex{i}"), F.col(f"_ey{i}")) for i in range(DIRECTIONS)]
    outside = reduce(or_, [(bx - ax) * (F.col("_y") - ay) - (by - ay) * (F.col("_x") - ax) < 0 for (ax, ay), (bx, by) in zip(tip, tip[1:] + tip[:1])])
    rest = j.where(outside).select(*keys, "_x", "_y")
    tips = ext.select(*keys, F.inline(F.array(*[F.struct(x.alias("_x"), y.alias("_y")) for x, y in tip])))
    rest = rest.unionByName(tips)
    names = list(keys)

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, g in pdf.drop_duplicates().groupby(names, dropna=False):
                g = g.sort_values(["_x", "_y"])
                keep = set(_hull(list(zip(g["_x"], g["_y"]))))
                yield g[[p in keep for p in zip(g["_x"], g["_y"])]]

    for i in range(rounds):
        if i:
            rest = rest.repartition(*keys, F.pmod(F.xxhash64("_x", "_y"), F.lit(64)))
        rest = rest.mapInPandas(thin, rest.schema)

    @F.pandas_udf("double")
    def area(pts: pd.Series) -> pd.Series:
        return pd.Series([_area([(p["_x"], p["_y"]) for p in v]) for v in pts])

    return rest.distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_x", "_y"))).alias("_p")).select(*keys, area("_p").alias("area"))


def _hull(pts: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull vertices of distinct points sorted by x, y (all points when there are fewer than three)."""
    def chain(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1]) if len(pts) > 2 else pts


def _area(pts: list[tuple[float, float]]) -> float:
    """Hull area of points sorted by x, y, by the shoelace sum."""
    h = np.array(_hull(pts)).reshape(-1, 2)
    if len(h) < 3:
        return 0.0
    return float(abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2)
