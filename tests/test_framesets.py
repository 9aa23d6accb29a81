"""Multisensor frame sets on small frames, against NumPy and numbers worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlake.operators import fit, neighbourhood as nb
from sensorlake.plans import framesets, jobs

EYE = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
SYNC = "k string, frame bigint, ts_ns bigint, vis bigint, cloud bigint, synced boolean"


def _cells(spark, mask, frame=1):
    rows = [("a", frame, r, c, 1.0 if mask[r, c] else None) for r in range(mask.shape[0]) for c in range(mask.shape[1])]
    return spark.createDataFrame(rows, "k string, frame bigint, r int, c int, vis double")


def test_sync_takes_the_earlier_of_two_and_the_exact_tolerance(spark):
    master = spark.createDataFrame([("a", 1, 100, 1), ("a", 2, 1000, 2), ("b", 3, 100, 3)], "k string, frame bigint, ts_ns bigint, seq bigint")
    msgs = [("a", "vis", 7, 90), ("a", "vis", 8, 110), ("a", "vis", 9, 1050), ("a", "nir", 5, 150), ("a", "nir", 6, 1051), ("a", "cloud", 3, 100), ("b", "vis", 1, 100)]
    messages = spark.createDataFrame([(*m, m[2]) for m in msgs], "k string, st string, frame bigint, ts_ns bigint, seq bigint")
    got = framesets.synchronise(master, messages, ["k"], ["vis", "nir"], 50).orderBy("frame").collect()
    assert [(r.frame, r.vis, r.nir, r.cloud, r.synced) for r in got] == [(1, 7, 5, 3, True), (2, 9, None, None, False), (3, 1, None, None, False)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_safe_crop_has_no_hole_and_is_the_largest(spark, seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((14, 11)) > 0.04
    sync = spark.createDataFrame([("a", 1, 0, 1, None, True), ("a", 2, 0, None, None, False), ("a", 3, 0, 1, None, True)], SYNC)
    got = {r.frame: r for r in framesets.safe_crops(sync, _cells(spark, mask), ["k"], ["vis"], 1, 0, 2, 2).collect()}
    padded = np.pad(mask, 1, constant_values=True)
    safe = np.array([[padded[r : r + 3, c : c + 3].all() for c in range(11)] for r in range(14)])
    best = max(((y1 - y0) * (x1 - x0) for y0 in range(14) for y1 in range(y0 + 1, 15) for x0 in range(11) for x1 in range(x0 + 1, 12) if safe[y0:y1, x0:x1].all()), default=0)
    b = got[1]
    assert (b.x1 - b.x0) * (b.y1 - b.y0) == best and safe[b.y0 : b.y1, b.x0 : b.x1].all()
    assert b.status == ("ok" if min(b.x1 - b.x0, b.y1 - b.y0) >= 2 else "common_intersection_too_small")
    assert got[2].status == "no_sync" and got[3].status == "no_common_intersection" and got[3].x0 is None


def test_trim_leaves_thirty_two_rows(spark):
    sync = spark.createDataFrame([("a", 1, 0, 1, None, True)], SYNC)
    box = lambda rows, trim: framesets.safe_crops(sync, _cells(spark, np.ones((rows, 3), bool)), ["k"], ["vis"], 1, trim, 1, 1).first()
    assert [(b.y0, b.y1) for b in (box(40, 4), box(40, 20), box(10, 4))] == [(0, 36), (0, 32), (0, 10)]


def _crop(spark):
    return spark.createDataFrame([("a", 1, 9, 2, 2, 8, 8)], "k string, frame bigint, cloud bigint, x0 int, y0 int, x1 int, y1 int")


def _lidar(spark, points, splat):
    p = spark.createDataFrame([("a", 9, i, *v) for i, v in enumerate(points)], "k string, frame bigint, seq int, x double, y double, z double, intensity double")
    d = framesets.lidar_layers(_crop(spark), p, ["k"], ["seq"], (1.0, 1.0, 0.0, 0.0), (0.0,) * 5, EYE, (0.0, 0.0, 0.0), 50.0, splat)
    return {(r.r, r.c): (r.depth_mm, r.height, r.intensity) for r in d.collect()}


def test_lidar_pixels_keep_the_nearest_point_inside_the_crop(spark):
    # pixel (r, c) = (y / z, x / z)
    points = [(8.0, 10.0, 2.0, 1.0), (4.0, 5.0, 1.0, 2.0), (4.0, 5.0, 1.0, 3.0), (-4.0, -5.0, -1.0, 4.0), (1.0, 5.0, 1.0, 5.0), (7.7, 5.0, 1.0, 6.0), (80.0, 80.0, 16.0, 7.0), (float("nan"), 5.0, 1.0, 8.0), (4.0, 5.0, 0.0, 9.0)]
    assert _lidar(spark, points, 1) == {(5, 4): (1000.0, 0.0, 2.0)}
    grown = _lidar(spark, [*points, (10.0, 10.0, 2.0, 0.5)], 3)
    assert grown[(5, 3)] == (1000.0, 0.0, 2.0) and grown[(5, 6)] == (2000.0, 0.0, 0.5)
    assert grown[(5, 5)] == (2000.0, 0.0, 2.0) and len(grown) == 3 * 4  # each layer has its own maximum


def test_splat_of_sparse_layers(spark):
    d = spark.createDataFrame([(1, 5, 5, 2.0, None), (1, 5, 6, 1.0, -3.0)], "f int, r int, c int, a double, b double")
    got = {(r.r, r.c): (r.a, r.b) for r in nb.splat(d, ["f"], ["a", "b"], 3).collect()}
    assert len(got) == 12 and got[(4, 4)] == (2.0, None) and got[(6, 6)] == (2.0, -3.0) and got[(5, 7)] == (1.0, -3.0)
    with pytest.raises(ValueError):
        nb.splat(d, ["f"], ["a"], 2)


def test_ground_height_with_clashing_names(spark):
    rng = np.random.default_rng(5)
    rows = [(1, 7, 8, 9, float(x), float(y), float(0.1 * x - 0.2 * y + i % 5 // 4)) for i, (x, y) in enumerate(rng.random((60, 2)) * 10)]
    d = fit.ground_height(spark.createDataFrame(rows, "k int, a int, b int, c int, x double, y double, z double"), ["k"])
    assert d.columns == ["k", "a", "b", "c", "x", "y", "z", "height"] and d.where("a = 7 and b = 8 and c = 9").count() == 60
    assert d.agg(F.max("height")).first()[0] > 0.5


def _filter(mask, k, fn, fill):
    p = np.pad(mask, k // 2, constant_values=fill)
    return np.array([[fn(p[r : r + k, c : c + k]) for c in range(mask.shape[1])] for r in range(mask.shape[0])])


def test_vegetation_is_opened_and_closed(spark):
    rng = np.random.default_rng(3)
    green = np.zeros((24, 24), bool)
    green[2:10, 3:15] = green[14:22, 5:20] = True
    green ^= rng.random(green.shape) < 0.01
    rows = [("a", 1, r, c, 90, 200 if green[r, c] else 90, 40) for r in range(24) for c in range(24)]
    d = framesets.vegetation(spark.createDataFrame(rows, "k string, frame bigint, r int, c int, red int, green int, blue int"), ["k", "frame"])
    got = np.zeros((24, 24), int)
    for r in d.collect():
        got[r.r, r.c] = r.veg
    opened = _filter(_filter(green, 5, np.min, True), 5, np.max, False)
    want = _filter(_filter(opened, 7, np.max, False), 7, np.min, True)
    assert d.count() == 576 and (got == want).all() and 0 < want.sum() < 576


def test_frame_sets_of_odd_rows(spark):
    master = spark.createDataFrame([("a", 1, 10, 1), (None, 1, 10, 1), ("a", 2, 500, 2)], "k string, frame bigint, ts_ns bigint, seq bigint")
    messages = spark.createDataFrame([("a", "vis", 4, 12, 4), (None, "vis", 4, 10, 4)], "k string, st string, frame bigint, ts_ns bigint, seq bigint")
    rgb = spark.createDataFrame([("a", f, r, c, 90, 200 if c < 3 else 90, 40) for f in (1, 2) for r in range(6) for c in range(6)], "k string, frame bigint, r int, c int, red int, green int, blue int")
    vis = spark.createDataFrame([("a", 4, r, c, float(r * 10 + c)) for r in range(6) for c in range(6)], "k string, frame bigint, r int, c int, v double")
    points = spark.createDataFrame([], "k string, frame bigint, seq int, x double, y double, z double, intensity double")
    args = (["k"], {"vis": EYE}, 5, ["seq"], (1.0, 1.0, 0.0, 0.0), (0.0,) * 5, EYE, (0.0, 0.0, 0.0), 0)
    d = framesets.multisensor_frame_sets(master, messages, rgb, {"vis": vis}, points, *args)
    sets = {r.frame: r for r in d["sets"].collect()}
    assert sorted(sets) == [1, 2] and sets[1].status == "ok" and sets[2].status == "no_sync" and sets[2].vegetation_cover_pct is None
    assert (sets[1].x0, sets[1].y0, sets[1].x1, sets[1].y1) == (0, 0, 6, 6)
    cells = d["cells"].collect()
    assert len(cells) == 36 and all(r.vis == r.r * 10 + r.c and r.depth_mm is None and r.veg is not None for r in cells)
    empty = framesets.multisensor_frame_sets(master.limit(0), messages, rgb, {"vis": vis}, points, *args)
    assert empty["sets"].count() == 0 and empty["cells"].count() == 0


def test_every_plot_has_a_status(spark):
    square = lambda x: [(x, 0.0), (x + 1.0, 0.0), (x + 1.0, 1.0), (x, 1.0)]
    plots = spark.createDataFrame([(i, f"p{i}", square(2.0 * i)) for i in range(4)], "pos int, plot_id string, ring array<struct<x: double, y: double>>")
    # One window of +-10 around the middle of 0..100: plot 0 has three frames in it, plot 1 one, plot 2 only frames far from it, plot 3 none.
    seen = [(45, 0), (50, 0), (55, 0), (52, 1), (0, 2), (100, 2), (58, None)]
    frames_ = spark.createDataFrame([("b", t, i) for i, (t, _) in enumerate(seen)], "k string, ts_ns bigint, seq bigint")
    fixes = spark.createDataFrame([("b", t, i, 50.0 if p is None else 2.0 * p + 0.5, 0.5) for i, (t, p) in enumerate(seen)], "k string, ts_ns bigint, seq bigint, x double, y double")
    args = (frames_, fixes, plots, ["k"], 1, 10, 0, 2, 1.0)
    got = {r.plot_id: (r.k, r.assigned, r.frames, r.status) for r in jobs.plot_window_status(*args).collect()}
    counted = {p: (v[1], v[3]) for p, v in got.items()}
    assert counted["p3"] == (0, "no_frames") and got["p3"][0] is None
    assert {p: v[0] for p, v in counted.items()} == {"p0": 3, "p1": 1, "p2": 2, "p3": 0}
    best = {r.plot_id: r.frames for r in jobs.plot_windows(*args).collect()}
    assert best == {p: v[2] for p, v in got.items() if v[3] == "selected"}
    assert {v[3] for v in got.values()} >= {"no_frames", "outside_windows"}
