"""Warps at size: joins of cells never go through the driver, and a cell meets its four neighbours at once."""

import math

import numpy as np
from pyspark.sql import functions as F

from sensorlake.functions import geometry as gm
from sensorlake.operators import neighbourhood as nb


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_that_come_from_few_rows_are_not_broadcast(spark):
    # one row explodes to a million cells; its own size says that it is small
    source = spark.range(64).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("r"), F.lit(0).alias("c"), F.lit(1.0).alias("v"))
    one = spark.createDataFrame([(1,)], "k int")
    grid = one.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(999)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(999))))
    eye = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    few = spark.createDataFrame([(1, r, 0, 1) for r in range(8)], "k int, r int, c int, m int")
    for d in (nb.warp(source, grid, ["k"], eye, "v"), nb.erode(few, ["k"], "m", 3), nb.opened(few, ["k"], "m", 3), nb.closed(few, ["k"], "m", 3)):
        assert "BroadcastHashJoin" not in _plan(d)


def test_warp_across_blocks_with_holes_nulls_and_repeated_pixels(spark):
    rng = np.random.default_rng(4)
    px = {(r, c): float(rng.random()) for r in range(-19, 37) for c in range(-3, 35) if rng.random() > 0.1}
    empty = {k for k in px if rng.random() < 0.05 or (8 <= k[0] < 16 and 8 <= k[1] < 16)}
    rows = [(None, r, c, None if (r, c) in empty else v) for (r, c), v in px.items()] + [(None, 5, 5, 2.0)]
    total = {k: v for k, v in px.items() if k not in empty}
    total[5, 5] = total.get((5, 5), 0.0) + 2.0
    there = set(px) | {(5, 5)}
    h = (1.03, 0.11, -4.3, -0.07, 0.94, -17.2, 0.0004, -0.0003, 1.0)
    grid = [(None, r, c) for r in range(0, 50, 3) for c in range(0, 45, 2)]
    d = nb.warp(spark.createDataFrame(rows, "k int, r int, c int, v double"), spark.createDataFrame(grid, "k int, r int, c int"), ["k"], F.array(*[F.lit(x) for x in h]), "v")
    got = {(r.r, r.c): (r.v, r.valid) for r in d.collect()}
    want = {}
    for _, r, c in grid:
        w = h[6] * c + h[7] * r + h[8]
        u, v = (h[0] * c + h[1] * r + h[2]) / w, (h[3] * c + h[4] * r + h[5]) / w
        fu, fv = math.floor(u), math.floor(v)
        near = (fv + (v - fv >= 0.5), fu + (u - fu >= 0.5))
        at = {(fv + i, fu + j): (v - fv if i else 1 - v + fv) * (u - fu if j else 1 - u + fu) for i in (0, 1) for j in (0, 1)}
        if any(k in there for k in at):
            full = [w * total[k] for k, w in at.items() if k in total]
            want[r, c] = (sum(full) if full else None, near in there)
    assert got.keys() == want.keys() and any(v is None for v, _ in want.values()) and any(not ok for _, ok in want.values())
    for k, (v, ok) in want.items():
        assert got[k][1] == ok and (got[k][0] is None if v is None else abs(got[k][0] - v) < 1e-9)


def test_inverse_of_numbers_is_the_inverse_of_the_column(spark):
    h = (1.02, 0.01, 2.0, -0.01, 0.98, 1.0, 0.0001, 0.0002, 1.0)
    a, b = spark.range(1).select(gm.h_inverse(F.array(*[F.lit(x) for x in h])), gm.h_inverse_of(h)).first()
    assert a == b
