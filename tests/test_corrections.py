"""Cases that an earlier version got wrong, each against numbers worked out by hand or by NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlake.functions import geometry as gm
from sensorlake.operators import fit, frames, hull, ordered, pairing, pixels, ranking, rasterize, spatial, trajectory
from sensorlake.plans import jobs
from sensorlake.sinks import tables as sinks
from sensorlake.sources import decode

CLOUD = "bag_id string, cloud_ts long, height int, width int, point_step int, fields array<struct<name:string,offset:int,datatype:int>>, data binary"


def test_short_and_missing_clouds_are_error_rows(spark):
    fields = [{"name": "x", "offset": 0, "datatype": 7}, {"name": "y", "offset": 4, "datatype": 7}]
    good = np.arange(4, dtype="<f4").tobytes()
    rows = [("a", 1, 1, 2, 8, fields, good), ("b", 2, 1, 2, 8, fields, good[:-1]), ("c", 3, 1, 2, 8, fields, None), ("d", 4, 1, 0, 8, fields, b"")]
    d = decode.explode_clouds(spark.createDataFrame(rows, CLOUD)).orderBy("bag_id", "i").collect()
    assert [(r.bag_id, r.x, r.error) for r in d] == [("a", 0.0, None), ("a", 2.0, None), ("b", None, "short buffer"), ("c", None, "no data")]


def test_hull_and_suppression_keep_the_null_key(spark):
    pts = [(None, 0.0, 0.0), (None, 4.0, 0.0), (None, 0.0, 3.0), ("a", 0.0, 0.0), ("a", 1.0, 0.0), ("a", 1.0, 1.0), ("a", 0.0, 1.0), ("a", 0.5, 0.5)]
    got = {r.k: r.area for r in hull.hull_areas(spark.createDataFrame(pts, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got == {None: 6.0, "a": 1.0}
    cands = spark.createDataFrame([(None, 1, 9.0, 0.0, 0.0), (None, 2, 8.0, 1.0, 0.0), (None, 3, 7.0, 50.0, 0.0), ("a", 4, 5.0, 0.0, 0.0)], "k string, i int, s double, x double, y double")
    kept = ranking.greedy_suppression(cands, ["k"], "s", "x", "y", 10.0, 3, ["i"])
    assert sorted((r.k or "", r.i, r["rank"]) for r in kept.collect()) == [("", 1, 1), ("", 3, 2), ("a", 4, 1)]


def test_each_frame_of_a_sweep_has_its_own_range(spark):
    px = [(f, r, c, float((r * 8 + c) * scale)) for f, scale in ((0, 1.0), (1, 100.0)) for r in range(8) for c in range(8)]
    cells = spark.createDataFrame(px, "frame int, r int, c int, intensity double")
    veg = cells.select("frame", "r", "c", F.lit(1).alias("veg"))
    got = jobs.sweep_intensity(cells, veg, ["frame", "r", "c"]).toPandas().pivot(index=["r", "c"], columns="frame", values="value")
    assert np.allclose(got[0], got[1]) and got[0].max() > 0.9


def test_guided_component_score(spark):
    d = spark.createDataFrame([(10, 10, 30, 20, 150), (0, 0, 40, 4, 80)], "x0 int, y0 int, x1 int, y1 int, area int")
    got = [r.score for r in frames.component_score(d, gm.box(12.0, 10.0, 32.0, 22.0), 1000.0).orderBy("x0", ascending=False).collect()]

    def want(x0, y0, x1, y1, area, g=(12.0, 10.0, 32.0, 22.0)):
        w, h, gw, gh = x1 - x0, y1 - y0, g[2] - g[0], g[3] - g[1]
        inter = max(0, min(x1, g[2]) - max(x0, g[0])) * max(0, min(y1, g[3]) - max(y0, g[1]))
        iou = inter / (w * h + gw * gh - inter)
        off = math.hypot((x0 + x1 - g[0] - g[2]) / 2, (y0 + y1 - g[1] - g[3]) / 2) / math.hypot(gw, gh)
        size = abs(math.log(max(0.1, w / gw))) + abs(math.log(max(0.1, h / gh)))
        return 4 * iou + 1.2 * min(1, area / (w * h)) + 0.8 * min(1, area / 1000) - 0.8 * off - 0.5 * size - (0 if 0.55 <= w / h <= 4 else 1)

    assert np.allclose(got, [want(10, 10, 30, 20, 150), want(0, 0, 40, 4, 80)])
    c = frames.contrast_component_score(d.withColumn("y1", F.col("y1") + 20), gm.box(0.0, 0.0, 10.0, 10.0)).collect()
    assert len(c) == 1 and math.isclose(c[0].score, 80 + 15 * 24 - 0.8 * math.hypot(15, 7))


def test_parity_of_odd_grids_is_not_centred(spark):
    means = [[10.0, 2.0, 9.0], [1.0, 12.0, 3.0], [11.0, 2.5, 8.0]]
    d = spark.createDataFrame([(i, j, means[i][j]) for i in range(3) for j in range(3)], "i int, j int, mean double")
    got = pixels.parity_score(d, [], "i", "j", "mean").collect()[0]
    m = np.array(means)
    p = np.fromfunction(lambda y, x: ((x + y) % 2) * 2 - 1, m.shape)
    c = m - m.mean()
    corr = abs((c * p).sum() / (math.sqrt((c * c).sum() * (p * p).sum()) + 1e-6))
    assert math.isclose(got["corr"], corr, rel_tol=1e-9)
    assert math.isclose(got.score, 100 * corr + 0.25 * abs(m[p > 0].mean() - m[p < 0].mean()), rel_tol=1e-9)
    assert pixels.QUALITY_WEIGHTS["thermal"] == (0.35, 35.0) and pixels.QUALITY_WEIGHTS["intrinsics"] == (0.25, 18.0)


def test_density_is_the_count(spark):
    d = spark.range(70_000).select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("id").cast("double").alias("z"), "id")
    got = rasterize.surface_max(d, ["row", "col"], "z", ["id"], []).collect()[0]
    assert got.n == 70_000 and got.z == 69_999.0


@pytest.mark.parametrize("part_len", [3, 10_000])
def test_a_track_is_one_feature(spark, part_len):
    import json

    rows = [("a", t, 10.0 + t, 45.0) for t in range(20)] + [("b", 0, 1.0, 2.0), ("c", 0, 1.0, 2.0), ("c", 1, None, 2.0), ("c", 2, 3.5, 4.0)]
    d = spark.createDataFrame(rows, "k string, t int, lon double, lat double")
    got = {r.k: json.loads(r.value) for r in sinks.feature_lines(d, ["k"], ["t"], "lon", "lat", part_len, rows_per_chunk=7).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"]["geometry"]["coordinates"] == [[10.0 + t, 45.0] for t in range(20)] and got["a"]["properties"] == {"k": "a"}
    assert got["c"]["geometry"]["coordinates"] == [[1.0, 2.0], [3.5, 4.0]]


def test_large_patterns_keep_their_options_apart(spark):
    grid = "label string, cols int, rows int, corners array<int>"
    a, b = spark.createDataFrame([("l", 70, 2, [])], grid), spark.createDataFrame([("l", 3, 70, [])], grid)
    d = pairing.subgrid_options(a, b, "label", (1, 1))
    assert d.count() == d.select("opt").distinct().count() == 68 * 69


def test_few_plots_need_no_join_and_agree_with_the_cells(spark, monkeypatch):
    rings = [[(0, 0), (4, 1), (3, 5)], [(6, 0), (9, 0), (9, 3), (7.5, 1), (6, 3)], [(2, 2), (8, 2), (8, 4), (2, 4)], [(12, 2), (14, 2), (14, 4), (12, 4)], []]
    plots = spark.createDataFrame([(i, f"p{i}", [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(rings)], "pos int, plot_id string, ring array<struct<x:double,y:double>>")
    rng = np.random.default_rng(4)
    at = [*rng.uniform(-3, 17, (200, 2)).tolist(), *[(i / 2, j / 2) for i in range(30) for j in range(11)], (1e6, -1e6), (math.inf, 1.0), (-math.inf, math.inf), (math.nan, 1.0), (None, 1.0), (10.5, 3.0)]
    pts = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)] + [(0, *at[0])], "i int, x double, y double")
    few = spatial.assign_plot(pts, plots, ["i"], 2.0, levels=1)
    got = few.collect()
    assert "Join" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spatial, "_few_plots", lambda shapes: None)
    cells = spatial.assign_plot(pts, plots, ["i"], 2.0, levels=1)
    assert few.schema.simpleString() == cells.schema.simpleString() and len(got) == len(at)
    key = lambda r: (r.i, r.plot_id, r.assignment, r.distance)
    assert sorted(map(key, got)) == sorted(map(key, cells.collect()))
    assert {r.i: (r.plot_id, r.assignment, r.distance) for r in got}[len(at) - 1] == ("p1", "nearest_polygon", 1.5)


def test_nearest_plot_far_away_without_a_nested_loop(spark):
    square = lambda x, y: [(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0)]
    plots = spark.createDataFrame([(0, "p", square(0.0, 0.0)), (1, "q", square(50.0, 0.0))], "pos int, plot_id string, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(0, 0.5, 0.5), (1, 3.0, 0.5), (2, 5000.0, 0.5), (3, -9000.0, 0.0), (4, None, 1.0), (5, 26.1, 0.5)], "i int, x double, y double")
    d = spatial.assign_plot(pts, plots, ["i"], 2.0, levels=2)
    got = {r.i: (r.plot_id, r.assignment, r.distance) for r in d.collect()}
    assert got == {0: ("p", "inside_polygon", 0.0), 1: ("p", "nearest_polygon", 2.0), 2: ("q", "nearest_polygon", 4949.0), 3: ("p", "nearest_polygon", 9000.0), 4: (None, "no_gps", None), 5: ("q", "nearest_polygon", 23.9)}
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_quality_class_names(spark):
    d = spark.createDataFrame([("a", "fallback_translation"), ("b", "rgb_feature")], "k string, m string")
    got = {r.k: r.quality for r in trajectory.trajectory_quality(d, ["k"], "m", ["rgb_feature"]).collect()}
    assert got == {"a": "visual_review_only", "b": "production_candidate"}


@pytest.mark.parametrize("kind", ["even", "stuck", "two clocks", "nan"])
def test_chunks_follow_the_order_and_stay_small(spark, kind):
    """Chunks never fall along the order, none holds much more than its share, and the plan has no sketch over all input in one step."""
    n, size = 4000, 100
    v = {"even": lambda i: float(i), "stuck": lambda i: 7.0 if i % 2 else float(i), "two clocks": lambda i: i * 1e-3 if i % 2 else 1e12 + i, "nan": lambda i: float("nan") if i % 3 == 0 else float(i)}[kind]
    d = spark.createDataFrame([(v(i), i) for i in range(n)], "v double, seq long").repartition(6)
    rows = ordered.with_chunk(d, ["v", "seq"], size).orderBy("v", "seq").collect()
    chunks = [r[ordered.CHUNK] for r in rows]
    assert chunks == sorted(chunks)
    assert max(np.bincount(chunks)) <= 4 * size
    assert {r[ordered.CHUNK] for r in ordered.with_chunk(d, ["v", "seq"]).collect()} == {0}


def test_registration_says_whether_it_converged(spark):
    r = np.random.default_rng(0).uniform(0, 5, (200, 3))
    scans = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(r)] + [(1, i, *map(float, p + [0.02, 0.0, 0.0])) for i, p in enumerate(r)], "scan int, pid long, x double, y double, z double")
    pair = spark.range(1).select(F.lit("p").alias("pair"), F.lit(1).alias("src"), F.lit(0).alias("dst"), F.lit(0.05).alias("step"))
    guess = jobs.initial_guesses(pair, "step").where("guess = 0")
    done = jobs.register_scans(scans, guess, 0.5).collect()[0]
    assert done.converged and done.rounds < 25 and done.rmse < 1e-6
    assert not jobs.register_scans(scans, guess, 0.5, iterations=1).collect()[0].converged
    assert fit is not None


@pytest.mark.parametrize("radius", [1, 4, 7])
def test_fill_takes_the_nearest_cell(spark, radius):
    import random

    from sensorlake.operators.neighbourhood import nearest_fill

    r = random.Random(1)
    cells = {(r.randrange(30), r.randrange(30)): r.random() for _ in range(60)}
    df = spark.createDataFrame([(a, b, v) for (a, b), v in cells.items()], "row int, col int, v double")
    got = {(x.row, x.col): (x.v, x.filled) for x in nearest_fill(df, [], ["v"], radius).collect()}
    want = {k: (v, False) for k, v in cells.items()}
    for a in range(-radius, 30 + radius):
        for b in range(-radius, 30 + radius):
            if (a, b) not in cells:
                d, *at = min(((a - x) ** 2 + (b - y) ** 2, x, y) for x, y in cells)
                if d <= radius * radius:
                    want[(a, b)] = (cells[tuple(at)], True)
    assert got == want


def test_pose_chain_over_several_levels(spark):
    """Blocks of three rows make four levels of one track; another key is short, a third NULL."""
    r = np.random.default_rng(2)
    steps = [("a", i, [float(v) for v in (np.eye(3) + 0.1 * r.standard_normal((3, 3))).ravel()]) for i in range(100)]
    steps += [("b", 0, None), ("b", 1, [2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0]), (None, 5, None)]
    d = spark.createDataFrame([(k, t, t, m) for k, t, m in steps], "k string, ts_ns long, seq long, m array<double>")
    got = {(x.k, x.ts_ns): x.pose for x in trajectory.pose_chain(d, ["k"], "m", 3, block=3).collect()}
    at = {}
    for k, t, m in steps:
        at[k] = at.get(k, np.eye(3)) @ (np.eye(3) if m is None else np.array(m).reshape(3, 3))
        assert np.allclose(got[k, t], at[k].ravel(), rtol=1e-9)
    assert len(got) == len(steps)


def test_shared_folder_of_a_cluster_takes_a_plain_path_and_falls_back_to_the_warehouse():
    from types import SimpleNamespace

    from sensorlake.session import shared_folder

    def cluster(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, *d: conf.get(k, *d)), sparkContext=SimpleNamespace(master="spark://a:7077", getCheckpointDir=lambda: None))

    assert shared_folder(cluster(**{"spark.checkpoint.dir": "/shared/cuts/"}), "cut").startswith("/shared/cuts/cut-")
    assert shared_folder(cluster(**{"spark.checkpoint.dir": "hdfs://n/cuts"}), "cut").startswith("hdfs://n/cuts/cut-")
    assert shared_folder(cluster(**{"spark.sql.warehouse.dir": "file:/house"}), "cut").startswith("file:/house/_cut/cut-")


def test_band_preview_and_its_sql_leave_out_the_incomplete_blocks_of_a_short_frame(spark, tmp_path):
    from sensorlake.plans import catalog
    from tests.compare import compare, duck

    import duckdb

    given = "/root/testdata/sf0.001"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{given}/{t}.parquet")
    duckdb.connect().execute(f"COPY (SELECT * FROM read_parquet('{given}/embeddings.parquet') WHERE vec_id < 70) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    d = catalog.QUERIES["pixel_band_preview"](spark, str(tmp_path))
    assert compare(d, duck(str(tmp_path)), catalog.ORACLES["pixel_band_preview"]) == []
    assert d.where("frame = 1").agg(F.max("br")).first()[0] == 0


def test_zscore_stretch_takes_every_whole_step(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 256, (24, 401))
    rows = [(k, int(x)) for k in range(24) for x in v[k]]
    got = {(r.k, r.v): r.u8 for r in rasterize.zscore_stretch(spark.createDataFrame(rows, "k int, v int"), ["k"], "v").collect()}
    for k in range(24):
        lo, hi = (int(x) for x in np.sort(v[k])[[2, 398]])
        assert all(got[k, x] == min(max((x - lo) * 255 // (hi - lo), 0), 255) for x in set(v[k].tolist())), k


def test_projection_is_computed_once_per_row(spark, sf):
    from sensorlake.plans import catalog

    plan = catalog.QUERIES["camera_projection"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("-0.21") == 2  # the radial term, once for u and once for v


def test_rigid_fit_builds_its_rotation_once_and_not_for_every_row(spark, sf):
    from sensorlake.plans import catalog

    plan = catalog.QUERIES["rigid3d_fit"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan.split("scalar-subquery")[0]


def test_small_clouds_of_several_layouts_are_decoded_together(spark):
    import time

    at = lambda *names: [{"name": n, "offset": 4 * i, "datatype": 7} for i, n in enumerate(names)]
    two, three = np.arange(8, dtype="<f4").tobytes(), np.arange(6, dtype="<f4").tobytes()
    rows = [("a", 0, 2, 2, 8, at("x", "y"), two), ("b", 0, 1, 2, 12, at("y", "x", "intensity"), three), ("c", 0, 1, 0, 8, at("x", "y"), b"")]
    d = decode.explode_clouds(spark.createDataFrame(rows, CLOUD).coalesce(1)).orderBy("bag_id", "i").collect()
    assert [(r.bag_id, r.i, r.ring, r.col, r.x, r.y, r.intensity) for r in d] == [
        *[("a", i, i % 2, i // 2, 2.0 * i, 2.0 * i + 1, None) for i in range(4)], *[("b", i, 0, i, 3.0 * i + 1, 3.0 * i, 3.0 * i + 2) for i in range(2)]
    ]
    many = spark.createDataFrame(rows[:1], CLOUD).withColumn("cloud_ts", F.explode(F.expr("sequence(1L, 300000L)"))).coalesce(1)
    t0 = time.perf_counter()
    assert decode.explode_clouds(many).agg(F.count("x")).first()[0] == 1_200_000
    assert time.perf_counter() - t0 < 12  # cloud by cloud it took 15 s


def test_documents_of_many_recordings_need_no_file_each(spark, tmp_path, monkeypatch):
    from __spark_entry__ import queries

    monkeypatch.setattr("sensorlake.session.shared_folder", lambda s, kind: str(tmp_path / kind))
    monkeypatch.setattr("sensorlake.plans.q_sources.shared_folder", lambda s, kind: str(tmp_path / kind))
    got = queries()["detection_document_rejects"](spark, "/root/testdata/sf0.01").toArrow()
    files = [f for f in tmp_path.rglob("*") if f.is_file() and f.name.startswith("part-")]
    assert len(set(got["path"].to_pylist())) > 100 and 0 < len(files) < 30


def test_coloured_cloud_looks_up_the_frame_once_per_stamp(spark, monkeypatch):
    from sensorlake.operators import asof
    from sensorlake.plans import jobs

    real, asked = asof.nearest_join, []

    def nearest_join(left, *args, **kwargs):
        asked.append(left.count())
        return real(left, *args, **kwargs)

    stamps = [0, 5, 9, 10, 11, 25, None]  # 5 lies between both frames at 0 and 10, 25 is too late
    rows = [(bag, t, 100 * i + j, 0.0, 0.0, 1.0, float(i), 0.0, float(j)) for bag in ("a", "b", None) for i, t in enumerate(stamps) for j in range(30)]
    points = spark.createDataFrame(rows, "bag string, ts_ns bigint, seq bigint, x double, y double, z double, e double, n double, h double")
    frames = spark.createDataFrame([("a", 0, 1, 1), ("a", 10, 3, 3), ("a", 10, 2, 2)], "bag string, ts_ns bigint, seq bigint, frame int")
    pixels = spark.createDataFrame([(f, 2, 2, 10 * f) for f in (1, 2, 3)], "frame int, r int, c int, v int")
    monkeypatch.setattr(asof, "nearest_join", nearest_join)
    got = jobs.coloured_cloud(points, frames, pixels, ["bag"], 14, (1.0, 1.0, 2.0, 2.0), (0, 0, 0, 0, 0), 4, 4, 1.0, ["seq"]).collect()
    assert sorted((r.col, r.h, r.v, r.n) for r in got) == [(2, 29.0, 10, 30), (3, 29.0, 10, 30), (4, 29.0, 20, 30), (5, 29.0, 20, 30), (6, 29.0, 20, 30)]
    assert asked == [3 * len(stamps)]


def test_hull_extremes_are_hashed_and_not_sorted(spark, monkeypatch):
    """The extremes of all points per key meet in a hash aggregate; ties on the corners keep whole points."""
    seen = []
    monkeypatch.setattr(hull, "cut_lineage", lambda d: seen.append(d) or d)
    pts = [("a", float(x), float(y)) for x in range(20) for y in range(10)] * 3 + [("c", 0.0, 0.0), ("c", 4.0, 0.0), ("c", 0.0, 3.0)]
    got = hull.hull_areas(spark.createDataFrame(pts, "k string, x double, y double"), ["k"], "x", "y")
    assert {r.k: r.area for r in got.collect()} == {"a": 19.0 * 9.0, "c": 6.0}
    assert "SortAggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_homography_votes_are_counted_without_their_matrices(spark, monkeypatch):
    """Votes per hypothesis are plain counts; the matrix of the winner is looked up afterwards, for a NULL key too."""
    seen = []
    monkeypatch.setattr(fit, "cut_lineage", lambda d: seen.append(d) or d)
    at = [(i, float(i % 5), float(i // 5)) for i in range(20)]
    rows = [(k, i, x, y, 2 * x + 3 + (50.0 if i in (4, 11) else 0.0), 2 * y - s) for k, s in (("a", 1.0), (None, 7.0)) for i, x, y in at]
    got = fit.homography_ransac(spark.createDataFrame(rows, "k string, pid int, sx double, sy double, dx double, dy double"), ["k"], "pid", 0.5)
    got = {r.k: r for r in got.collect()}
    for k, s in (("a", 1.0), (None, 7.0)):
        assert (got[k].n, got[k].inliers, got[k].used) == (20, 18, 18) and np.allclose(got[k].h, [2, 0, 3, 0, 2, -s, 0, 0, 1], atol=1e-6)
    assert "first(" not in seen[0]._jdf.queryExecution().executedPlan().toString()
