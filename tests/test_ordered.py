"""Chunked ordered work against brute force: skewed keys, ties, stuck clocks, NULL keys, several partitionings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorlake.operators import asof, ordered, quantiles

NS = 1_000_000_000


def skewed(n, seed, span=400, stuck=0.3):
    """A third of the rows in one key, and a third of the stamps on one instant."""
    rng = np.random.default_rng(seed)
    k = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 6, n))
    ts = np.where(rng.random(n) < stuck, 77, rng.integers(0, span, n))
    return pd.DataFrame({"k": k, "ts_ns": ts.astype("int64"), "seq": rng.permutation(n).astype("int64"), "v": rng.normal(size=n).round(3)})


@pytest.mark.parametrize("rows_per_chunk,parts", [(10_000, 1), (40, 1), (13, 7), (1, 3)])
def test_running_index_and_sums(spark, rows_per_chunk, parts):
    pdf = skewed(900, 1)
    df = spark.createDataFrame(pdf).repartition(parts)
    got = ordered.running_sums(df, ["k"], ["ts_ns", "seq"], {"i": F.lit(1).cast("bigint"), "s": F.col("v")}, {"i": "n"}, rows_per_chunk).toPandas()
    pdf = pdf.sort_values(["k", "ts_ns", "seq"])
    pdf["i"] = pdf.groupby("k").cumcount() + 1
    pdf["s"] = pdf.groupby("k").v.cumsum()
    pdf["n"] = pdf.groupby("k").v.transform("size")
    a, b = got.sort_values("seq").reset_index(drop=True), pdf.sort_values("seq").reset_index(drop=True)
    assert (a.i == b.i).all() and (a.n == b.n).all()
    assert np.allclose(a.s, b.s)


@pytest.mark.parametrize("rows_per_chunk", [10_000, 40, 7])
@pytest.mark.parametrize("forward", [False, True])
def test_previous_and_next_row(spark, rows_per_chunk, forward):
    pdf = skewed(700, 2)
    got = ordered.previous_row(spark.createDataFrame(pdf), ["k"], ["ts_ns", "seq"], {"v": "pv", "seq": "ps"}, rows_per_chunk, forward).toPandas()
    pdf = pdf.sort_values(["k", "ts_ns", "seq"])
    pdf["ps"] = pdf.groupby("k").seq.shift(-1 if forward else 1)
    a, b = got.sort_values("seq"), pdf.sort_values("seq")
    assert np.array_equal(a.ps.fillna(-1).to_numpy(), b.ps.fillna(-1).to_numpy())


def test_hot_key_is_split(spark):
    pdf = skewed(3000, 3)
    sizes = ordered.with_chunk(spark.createDataFrame(pdf), ["ts_ns", "seq"], 50).groupBy("k", "_chunk").count().toPandas()
    assert sizes["count"].max() < 400
    assert len(sizes[sizes.k == 0]) > 20


def test_chunk_order_follows_row_order(spark):
    pdf = skewed(2000, 4)
    c = ordered.with_chunk(spark.createDataFrame(pdf), ["ts_ns", "seq"], 30).toPandas().sort_values(["ts_ns", "seq"])
    assert (np.diff(c["_chunk"]) >= 0).all()


@pytest.mark.parametrize("rows_per_chunk", [10_000, 25])
def test_exact_quantiles(spark, rows_per_chunk):
    pdf = skewed(1200, 5)
    pdf.loc[::50, "v"] = np.nan
    q = quantiles.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}, rows_per_chunk, moments=True).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        v = g.v.dropna()
        assert np.allclose(q.loc[k, ["a", "b", "c"]].astype(float), np.percentile(v, [5, 50, 95]))
        assert q.loc[k, "n"] == len(v) and np.isclose(q.loc[k, "mean"], v.mean())


def brute_nearest(left, right, tol):
    out = {}
    for r in left.itertuples():
        c = right[right.k == r.k]
        if len(c) == 0:
            out[r.seq] = (None, None)
            continue
        best = min(zip((c.ts_ns - r.ts_ns).abs(), c.ts_ns, c.seq))
        out[r.seq] = (best[0], best[2] if tol is None or best[0] <= tol else None)
    return out


@pytest.mark.parametrize("seed,rows_per_chunk,tol", [(s, c, t) for s in range(3) for c, t in ((10_000, 3), (30, None), (9, 5))])
def test_nearest_join(spark, seed, rows_per_chunk, tol):
    pdf = skewed(260, 10 + seed, span=120, stuck=0.2)
    left, right = pdf.iloc[:130].drop(columns="v"), pdf.iloc[130:]
    right = right[right.k != 3]
    got = asof.nearest_join(spark.createDataFrame(left).repartition(5), spark.createDataFrame(right), ["k"], tol, ["v"], rows_per_chunk=rows_per_chunk).toPandas()
    want = brute_nearest(left, right, tol)
    assert len(got) == len(left)
    for r in got.itertuples():
        dt, seq = want[r.seq]
        assert (None if pd.isna(r.dt_ns) else int(r.dt_ns)) == dt
        assert (None if pd.isna(r.r_seq) else int(r.r_seq)) == seq


def test_nearest_join_edges(spark):
    left = spark.createDataFrame([(1, 100, 1), (1, 110, 2), (None, 100, 3), (2, 50, 4), (1, None, 5)], "k int, ts_ns long, seq long")
    right = spark.createDataFrame([(1, 95, 10), (1, 105, 11), (1, 105, 9), (None, 100, 12)], "k int, ts_ns long, seq long")
    got = {r.seq: (r.dt_ns, r.r_seq) for r in asof.nearest_join(left, right, ["k"], 5).collect()}
    assert got[1] == (5, 10)  # equal distance: the earlier row, tolerance inclusive
    assert got[2] == (5, 9)  # equal stamps: the smaller seq
    assert got[3] == (None, None) and got[4] == (None, None) and got[5] == (None, None)
    empty = asof.nearest_join(left, right.limit(0), ["k"], 5).collect()
    assert len(empty) == 5 and all(r.r_seq is None for r in empty)


def test_nearest_directions(spark):
    pdf = skewed(200, 21, span=80, stuck=0.1)
    left, right = pdf.iloc[:100].drop(columns="v"), pdf.iloc[100:]
    for way in ("backward", "forward"):
        got = asof.nearest_per_stream(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], {"n": None}, rows_per_chunk=15, direction=way).select("seq", "n.ts").toPandas()
        for r, l in zip(got.sort_values("seq").itertuples(), left.sort_values("seq").itertuples()):
            c = right[(right.k == l.k) & ((right.ts_ns <= l.ts_ns) if way == "backward" else (right.ts_ns >= l.ts_ns))].ts_ns
            want = None if len(c) == 0 else (c.max() if way == "backward" else c.min())
            assert (None if pd.isna(r.ts) else int(r.ts)) == want


def test_exact_subset(spark):
    from sensorlake.operators import sampling

    df = spark.range(1000).withColumn("name", F.concat(F.lit("n"), "id"))
    a = sampling.exact_subset(df, ["name"], 137, 5, rows_per_chunk=50).toPandas()
    b = sampling.exact_subset(df.repartition(7), ["name"], 137, 5).toPandas()
    assert len(a) == 137 and set(a.id) == set(b.id)
    assert sampling.exact_subset(df, ["name"], 5000).count() == 1000


def test_null_key_is_a_key_of_its_own(spark):
    df = spark.createDataFrame([(None, 3, 1), (None, 1, 2), (1, 2, 3), (None, 2, 4)], "k int, ts_ns long, seq long")
    got = {r.seq: (r.i, r.n) for r in ordered.running_index(df, ["k"], ["ts_ns", "seq"], "i", "n", rows_per_chunk=1).collect()}
    assert got == {2: (0, 3), 4: (1, 3), 1: (2, 3), 3: (0, 1)}
