"""Closed-form and brute-force checks of fits, spatial joins and raster neighbourhoods."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sensorlake.functions import geometry as gm
from sensorlake.operators import fit, neighbourhood as nb, pixels as px, ranking, spatial, trajectory
from sensorlake.operators.hull import _area, hull_areas
from sensorlake.plans import jobs


def rotation(rng):
    q = rng.normal(size=4)
    q /= np.linalg.norm(q)
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def test_rigid_fit_recovers_random_rotations(spark):
    rng = np.random.default_rng(0)
    rows, truth = [], {}
    for g in range(50):
        r, t, p = rotation(rng), rng.normal(size=3), rng.normal(size=(12, 3))
        truth[g] = (r, t)
        rows += [(g, *map(float, a), *map(float, r @ a + t)) for a in p]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double, u double, v double, w double")
    for row in fit.rigid3d_fit(df, ["g"], ["x", "y", "z"], ["u", "v", "w"]).collect():
        assert np.allclose(np.array(row.r).reshape(3, 3), truth[row.g][0], atol=1e-9)
        assert np.allclose(row.t, truth[row.g][1], atol=1e-9)


def test_similarity_fit_and_degenerate_source(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 2))
    c, s = math.cos(0.7), math.sin(0.7)
    b = 2.5 * a @ np.array([[c, s], [-s, c]]) + [3, -4]
    rows = [(0, *map(float, p), *map(float, q)) for p, q in zip(a, b)] + [(1, 1.0, 1.0, 5.0, 6.0)] * 3
    got = {r.g: r for r in fit.similarity_fit(spark.createDataFrame(rows, "g int, sx double, sy double, dx double, dy double"), ["g"]).collect()}
    assert np.allclose([got[0].scale, got[0].theta, got[0].tx, got[0].ty], [2.5, 0.7, 3, -4])
    assert np.allclose([got[1].scale, got[1].theta, got[1].tx, got[1].ty], [1, 0, 4, 5])


def test_ransac_plane_with_outliers(spark):
    rng = np.random.default_rng(2)
    n = 900
    xy = rng.uniform(-3, 3, (n, 2))
    z = 0.2 * xy[:, 0] - 0.1 * xy[:, 1] + 1 + rng.normal(0, 0.004, n)
    z[:270] += rng.uniform(0.3, 3, 270)
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "i": range(n), "x": xy[:, 0], "y": xy[:, 1], "z": z}))
    few = df.limit(5).withColumn("g", F.lit(1))
    got = {r.g: r for r in fit.ransac_plane(df.unionByName(few), ["g"], "i", hypotheses=64).collect()}
    want = np.array([-0.2, 0.1, 1]) / np.linalg.norm([-0.2, 0.1, 1])
    assert got[0].detected and got[0].n >= 0.99 * 630
    assert abs(abs(np.dot(got[0].normal, want)) - 1) < 1e-3
    assert not got[1].detected and got[1].reason == "too_few_points"


def test_homography_with_bad_corners(spark):
    rng = np.random.default_rng(3)
    h = np.array([[1.1, 0.05, 12], [-0.03, 0.95, 7], [2e-4, -1e-4, 1]])
    src = np.array([[c * 30.0, r * 30.0] for r in range(6) for c in range(9)])
    p = np.c_[src, np.ones(54)] @ h.T
    dst = p[:, :2] / p[:, 2:]
    clean = pd.DataFrame({"g": 0, "i": range(54), "sx": src[:, 0], "sy": src[:, 1], "dx": dst[:, 0], "dy": dst[:, 1]})
    bad = clean.assign(g=1)
    hit = rng.choice(54, 11, replace=False)
    bad.loc[hit, "dx"] += 50
    df = spark.createDataFrame(pd.concat([clean, bad]))
    for r in fit.homography_dlt(df.where("g = 0"), ["g"]).collect():
        assert np.allclose(np.array(r.h).reshape(3, 3), h, atol=1e-6)
    got = {r.g: r for r in fit.homography_ransac(df, ["g"], "i", 3.0, hypotheses=48).collect()}
    assert got[1].inliers == 43 and np.allclose(np.array(got[1].h).reshape(3, 3), h, atol=1e-6)


def test_utm_known_point_and_round_trip(spark):
    rng = np.random.default_rng(4)
    rows = [(9.0, 0.0)] + [(float(a), float(b)) for a, b in zip(rng.uniform(6, 12, 100), rng.uniform(-75, 75, 100))]
    d = spark.createDataFrame(rows, "lon double, lat double").withColumn("u", gm.utm_forward(F.col("lon"), F.col("lat"), F.lit(32)))
    d = d.withColumn("b", gm.utm_inverse(F.col("u.e"), F.col("u.n"), F.lit(32), F.col("lat") >= 0)).toPandas()
    assert abs(d.u[0]["e"] - 500_000) < 1e-6 and abs(d.u[0]["n"]) < 1e-6
    assert max(abs(r.b["lon"] - r.lon) + abs(r.b["lat"] - r.lat) for r in d.itertuples()) * 111_000 < 1e-5


def test_quaternion_round_trip_all_branches(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, rng.normal(size=4))) for _ in range(40)] + [(1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "x double, y double, z double, w double")
    q = gm.quat(F.col("x"), F.col("y"), F.col("z"), F.col("w"))
    got = d.select(gm.quat_normalise(q).alias("a"), gm.quat_from_matrix(gm.quat_to_matrix(q)).alias("b"), gm.quat_mul(q, gm.quat_inverse(q)).alias("i")).collect()
    for r in got[:-1]:
        a, b = np.array(r.a), np.array(r.b)
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert np.allclose(r.i, [0, 0, 0, 1], atol=1e-12)
    assert tuple(got[-1].a) == (0, 0, 0, 1)


def test_design_extrinsic():
    t = np.array(gm.design_extrinsic("lidar_frame")).reshape(4, 4)
    assert np.allclose(t[:3, 3], [-0.006253, 0.011775, 0.03055]) and np.allclose(np.diag(t), [-1, -1, 1, 1])


def test_pose_chain_across_blocks(spark):
    rng = np.random.default_rng(6)
    steps = [None] + [np.c_[np.r_[rotation(rng), [[0, 0, 0]]], [*rng.normal(size=3), 1]] for _ in range(39)]
    rows = [(0, i, i, None if s is None else [float(v) for v in s.ravel()]) for i, s in enumerate(steps)]
    d = trajectory.pose_chain(spark.createDataFrame(rows, "k int, ts_ns long, seq long, step array<double>"), ["k"], "step", 4, block=3)
    cur = np.eye(4)
    for r in d.orderBy("seq").collect():
        cur = cur if steps[r.seq] is None else cur @ steps[r.seq]
        assert np.allclose(np.array(r.pose).reshape(4, 4), cur, atol=1e-9)


def test_upright_grid(spark):
    base = [(10.0 * c + r, 12.0 * r) for r in range(3) for c in range(4)]
    g = np.array(base).reshape(3, 4, 2)
    variants = [g, g[::-1], g[:, ::-1], g[::-1, ::-1]]
    rows = [([{"x": float(a), "y": float(b)} for a, b in v.reshape(-1, 2)],) for v in variants]
    d = spark.createDataFrame(rows, "g array<struct<x:double,y:double>>").select(gm.upright_grid(F.col("g"), F.lit(4), F.lit(3)).alias("u"))
    for r in d.collect():
        assert np.allclose([(p.x, p.y) for p in r.u], base)


def test_nearest_point_in_a_crowd(spark):
    rng = np.random.default_rng(7)
    a = np.r_[rng.normal(0, 0.01, (150, 3)), rng.uniform(-2, 2, (60, 3))]
    b = np.r_[rng.normal(0, 0.01, (150, 3)), rng.uniform(-2, 2, (60, 3)), np.zeros((20, 3))]
    mk = lambda m: spark.createDataFrame(pd.DataFrame({"k": 0, "id": np.arange(len(m)), "x": m[:, 0], "y": m[:, 1], "z": m[:, 2]}))
    got = {r.id: r for r in spatial.nearest_point(mk(a), mk(b), ["k"], ["id"], "id", ["x", "y", "z"], 0.5).collect()}
    for i, p in enumerate(a):
        d = ((b - p) ** 2).sum(1)
        j = int(np.argmin(d))
        if d[j] < 0.25:
            assert got[i].t_id == j and np.isclose(got[i].d2, d[j])
        else:
            assert i not in got


def test_plot_assignment_general_polygons(spark):
    rng = np.random.default_rng(8)
    rings = [[(0, 0), (4, 1), (3, 5)], [(6, 0), (9, 0), (9, 3), (7.5, 1), (6, 3)], [(2, 2), (8, 2), (8, 4), (2, 4)]]
    plots = spark.createDataFrame([(i, str(i + 1), [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(rings)], "pos int, plot_id string, ring array<struct<x:double,y:double>>")
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-30, 40, (300, 2)))] + [(900, 3.0, 2.5), (901, 0.0, 0.0), (902, None, 1.0), (903, float("nan"), 1.0)]
    got = {r.id: r for r in spatial.assign_plot(spark.createDataFrame(pts, "id int, x double, y double"), plots, ["id"], 2.0, levels=3).collect()}

    def inside(p, ring):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) / (by - ay) * (bx - ax):
                odd = not odd
        return odd

    def dist(p, ring):
        best = 1e9
        for a, b in zip(ring, ring[1:] + ring[:1]):
            a, b = np.array(a, float), np.array(b, float)
            t = np.clip(np.dot(np.array(p) - a, b - a) / np.dot(b - a, b - a), 0, 1)
            best = min(best, np.linalg.norm(np.array(p) - a - t * (b - a)))
        return best

    for i, x, y in pts[:301]:
        hit = [j for j, r in enumerate(rings) if inside((x, y), r)]
        want = hit[0] if hit else int(np.argmin([dist((x, y), r) for r in rings]))
        assert got[i].plot_id == str(want + 1), (x, y)
        assert got[i].assignment == ("inside_polygon" if hit else "nearest_polygon")
    assert got[901].assignment == "nearest_polygon" and got[901].distance == 0.0
    assert got[902].assignment == "no_gps" and got[903].plot_id is None
    assert len(got) == len(pts)


def test_corridor_long_diagonal(spark):
    rng = np.random.default_rng(9)
    track = [(0, 0.0, 0.0), (1, 40.0, 30.0), (2, 40.0, 30.0), (3, 40.0, 55.0)]
    seg = spatial.track_segments(spark.createDataFrame(track, "i int, x double, y double"), [], ["i"])
    p = rng.uniform(-5, 60, (2000, 2))
    got = {r.id: r.d2 for r in spatial.corridor(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id int, x double, y double"), seg, ["id"], 1.5).collect()}
    for i, q in enumerate(p):
        d2 = 1e18
        for (_, ax, ay), (_, bx, by) in zip(track, track[1:]):
            v = np.array([bx - ax, by - ay])
            t = np.clip(np.dot(q - [ax, ay], v) / np.dot(v, v), 0, 1) if v.any() else 0
            d2 = min(d2, ((q - [ax, ay] - t * v) ** 2).sum())
        assert (i in got) == (d2 <= 2.25)
        if i in got:
            assert np.isclose(got[i], d2, atol=1e-9)


def test_corridor_counts(spark):
    rng = np.random.default_rng(19)
    track = [(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 10.0, 12.0)]
    seg = spatial.track_segments(spark.createDataFrame(track, "i int, x double, y double"), [], ["i"])
    rows = [(i, float(a), float(b), "box") for i, (a, b) in enumerate(rng.uniform(-6, 18, (500, 2)))] + [(900, None, 1.0, "box"), (901, float("nan"), 1.0, "box")]
    p = spark.createDataFrame(rows, "id int, x double, y double, box string")
    kept, counts = spatial.corridor_counted(p, seg, ["id"], 1.0, 0.5)
    in_box = sum(a is not None and -1.5 <= a <= 11.5 and -1.5 <= b <= 13.5 for _, a, b, _ in rows)
    assert counts.collect() == [(502, in_box, kept.count())]
    assert {r.id for r in kept.collect()} == {r.id for r in spatial.corridor(p, seg, ["id"], 1.0, 0.5).collect()}
    every, counts = spatial.corridor_counted(p, seg, ["id"], 0.0)
    assert every.count() == 502 and counts.collect() == [(502, 502, 502)]
    none = spatial.track_segments(spark.createDataFrame(track[:1], "i int, x double, y double"), [], ["i"])
    assert spatial.corridor_counted(p, none, ["id"], 1.0)[1].collect() == [(502, 0, 0)]


def test_hull_area(spark):
    rng = np.random.default_rng(10)
    frames = {0: rng.normal(size=(400, 2)), 1: rng.uniform(size=(300, 2)), 2: np.repeat(rng.uniform(size=(30, 2)), 5, 0), 3: np.array([[0, 0], [1, 1], [2, 2]])}
    rows = [(k, float(x), float(y)) for k, m in frames.items() for x, y in m]
    got = {r.k: r.area for r in hull_areas(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y").collect()}
    for k, m in frames.items():
        assert np.isclose(got[k], _area(sorted(map(tuple, m))), atol=1e-9)


def mask_frames(seed, n=4, size=23, p=0.55):
    return np.random.default_rng(seed).random((n, size, size)) < p


def as_cells(spark, m):
    f, r, c = np.nonzero(m)
    return spark.createDataFrame(pd.DataFrame({"f": f.astype("int64"), "r": r.astype("int32"), "c": c.astype("int32")}))


def test_components_across_tiles(spark):
    m = mask_frames(11, p=0.42)
    got = nb.label_components(as_cells(spark, m), ["f"], tile=5).toPandas()
    for f in range(len(m)):
        lab, todo = {}, set(zip(*np.nonzero(m[f])))
        while todo:
            start = min(todo)
            comp, stack = set(), [start]
            while stack:
                q = stack.pop()
                if q in comp:
                    continue
                comp.add(q)
                stack += [(q[0] + i, q[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (q[0] + i, q[1] + j) in todo]
            todo -= comp
            lab.update({q: start[0] * (1 << 31) + start[1] for q in comp})
        mine = {(r.r, r.c): r.label for r in got[got.f == f].itertuples()}
        assert mine == lab


def test_largest_rectangle(spark):
    m = mask_frames(12, n=5, size=14, p=0.7)
    got = {r.f: r for r in nb.largest_rectangle(as_cells(spark, m), ["f"]).collect()}
    for f in range(len(m)):
        s = np.pad(m[f].astype(int).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        best = max(
            (y1 - y0) * (x1 - x0)
            for y0 in range(14) for y1 in range(y0 + 1, 15) for x0 in range(14) for x1 in range(x0 + 1, 15)
            if s[y1, x1] - s[y0, x1] - s[y1, x0] + s[y0, x0] == (y1 - y0) * (x1 - x0)
        )
        r = got[f]
        assert r.area == best == (r.x1 - r.x0) * (r.y1 - r.y0)
        assert m[f][r.y0 : r.y1, r.x0 : r.x1].all()


def test_nearest_fill_and_canopy(spark):
    rng = np.random.default_rng(13)
    m = rng.random((15, 15)) < 0.15
    z = rng.normal(size=(15, 15))
    r, c = np.nonzero(m)
    cells = spark.createDataFrame(pd.DataFrame({"row": r, "col": c, "z": z[m]}))
    got = {(x.row, x.col): x for x in nb.nearest_fill(cells, [], ["z"], 3).collect()}
    for i in range(-3, 18):
        for j in range(-3, 18):
            cand = min(((a - i) ** 2 + (b - j) ** 2, a, b) for a, b in zip(r, c))
            if cand[0] == 0 or cand[0] <= 9:
                assert np.isclose(got[(i, j)].z, z[cand[1], cand[2]]) and got[(i, j)].filled == (cand[0] > 0)
            else:
                assert (i, j) not in got
    can = {(x.row, x.col): x.canopy for x in nb.canopy(cells, [], "z", 5, 1.0).collect()}
    val = {(a, b): z[a, b] for a, b in zip(r, c)}
    low = {q: min(v for p, v in val.items() if abs(p[0] - q[0]) <= 2 and abs(p[1] - q[1]) <= 2) for q in val}
    k = nb.gaussian_kernel(1.0, 2)
    row = {}
    for q in {(a, b + o) for a, b in low for o in range(-2, 3)}:
        w = [(k[o + 2], low[(q[0], q[1] + o)]) for o in range(-2, 3) if (q[0], q[1] + o) in low]
        row[q] = sum(a * b for a, b in w) / sum(a for a, _ in w)
    for q in val:
        w = [(k[o + 2], row[(q[0] + o, q[1])]) for o in range(-2, 3) if (q[0] + o, q[1]) in row]
        env = sum(a * b for a, b in w) / sum(a for a, _ in w)
        assert np.isclose(can[q], max(val[q] - env, 0), atol=1e-9)


def test_greedy_suppression(spark):
    rng = np.random.default_rng(14)
    d = pd.DataFrame({"k": rng.integers(0, 2, 200), "id": np.arange(200), "x": rng.uniform(0, 20, 200), "y": rng.uniform(0, 20, 200), "s": rng.integers(0, 30, 200).astype(float)})
    got = ranking.greedy_suppression(spark.createDataFrame(d), ["k"], "s", "x", "y", 4.0, 5, ["id"]).toPandas()
    for k, g in d.groupby("k"):
        kept = []
        for r in g.sort_values(["s", "id"], ascending=[False, True]).itertuples():
            if len(kept) < 5 and all(math.hypot(r.x - q.x, r.y - q.y) > 4 for q in kept):
                kept.append(r)
        assert list(got[got.k == k].sort_values("rank").id) == [r.id for r in kept]


def test_band_components(spark):
    rng = np.random.default_rng(15)
    img = rng.integers(0, 255, (16, 12))
    rows = [(0, i, j, int(img[i, j])) for i in range(16) for j in range(12)]
    got = px.band_pca(spark.createDataFrame(rows, "f int, r int, c int, v int"), ["f"], "v", 4).orderBy("br", "bc").toPandas()
    flat = np.stack([img[a::4, b::4].ravel() for a in range(4) for b in range(4)], 1).astype(float)
    z = (flat - flat.mean(0)) / (flat.std(0) + 1e-6)
    vt = np.linalg.svd(z, full_matrices=False)[2][:3]
    for i in range(3):
        assert np.allclose(np.abs(got[f"pc{i}"]), np.abs(z @ vt[i]), atol=1e-6)


def test_scan_registration_recovers_motion(spark):
    rng = np.random.default_rng(16)
    p = rng.uniform(-2, 2, (400, 3))
    a = 0.03
    r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    q = (p - [0.08, -0.05, 0.02]) @ r  # so that r q + t = p
    mk = lambda s, m: pd.DataFrame({"scan": s, "pid": np.arange(len(m)), "x": m[:, 0], "y": m[:, 1], "z": m[:, 2]})
    scans = spark.createDataFrame(pd.concat([mk(0, p), mk(1, q)]))
    pair = spark.createDataFrame([("a", 1, 0, 0.05)], "pair string, src int, dst int, step double")
    got = jobs.register_scans(scans, jobs.initial_guesses(pair, "step").where("guess < 2"), 0.6, iterations=12).collect()[0]
    assert np.allclose(np.array(got.r).reshape(3, 3), r, atol=0.01) and np.allclose(got.t, [0.08, -0.05, 0.02], atol=0.02)
    assert got.n >= 80


def test_far_points_meet_few_plots(spark):
    """Points near, far and very far from a field of plots, against all distances; the number of plots met stays small."""
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from sensorlake.operators import spatial

    r = random.Random(3)
    boxes = [(i, 10.0 * (i % 20) + r.random(), 7.0 * (i // 20) + r.random(), 3 + 4 * r.random(), 2 + 3 * r.random()) for i in range(400)] + [(400, -900.0, 50.0, 5.0, 5.0), (401, 30.0, 30.0, 400.0, 1.0)]
    ring = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    plots = spark.createDataFrame([(i, f"p{i}", ring(*b)) for i, *b in boxes], "pos int, plot_id string, ring array<struct<x:double,y:double>>")
    at = [(i, r.uniform(-300, 500), r.uniform(-200, 400)) for i in range(300)] + [(1000, 1e6, 1e6), (1001, -5e5, 40.0), (1002, -400.0, 55.0), (1003, None, 1.0)]
    got = {g.id: g for g in spatial.assign_plot(spark.createDataFrame(at, "id int, x double, y double"), plots, ["id"], 5.0, levels=1).collect()}
    assert len(got) == len(at)
    b = np.array([x[1:] for x in boxes])
    for i, x, y in at:
        if x is None:
            assert got[i].assignment == "no_gps"
            continue
        dx = np.maximum(np.maximum(b[:, 0] - x, x - b[:, 0] - b[:, 2]), 0)
        dy = np.maximum(np.maximum(b[:, 1] - y, y - b[:, 1] - b[:, 3]), 0)
        d = np.hypot(dx, dy)
        if d.min() > 0:
            assert got[i].assignment == "nearest_polygon" and abs(got[i].distance - d.min()) < 0.006, (i, x, y)
            assert abs(d[int(got[i].plot_id[1:])] - d.min()) < 1e-6


def test_corrections_are_held_near_their_prior(spark):
    """Against the same steps in plain matrices: cut in length and angle, then applied to the prior."""
    import numpy as np

    from sensorlake.plans import jobs

    def turn(v):
        a = np.linalg.norm(v)
        k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / (a or 1)
        return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k

    rng = np.random.default_rng(2)
    rows, want = [], []
    for i in range(40):
        v, v0 = rng.normal(0, 0.02 + 0.1 * (i % 3), 3), rng.normal(0, 0.05, 3) * (i % 2)
        r, r0, t, t0 = turn(v), turn(v0), rng.normal(0, 0.3, 3), rng.normal(0, 0.3, 3) * (i % 4 > 0)
        cr, ct = r @ r0.T, t - r @ r0.T @ t0
        n, a = np.linalg.norm(ct), np.arccos(np.clip((np.trace(cr) - 1) / 2, -1, 1))
        ct = ct * min(1, 0.2 / n)
        axis = np.array([cr[2, 1] - cr[1, 2], cr[0, 2] - cr[2, 0], cr[1, 0] - cr[0, 1]]) / (2 * np.sin(a))
        held = turn(axis * min(a, np.radians(4.0)))
        want.append((held @ r0, held @ t0 + ct, np.linalg.norm(ct)))
        rows.append((i, *[x.ravel().tolist() for x in (r, t, r0, t0)]))
    df = spark.createDataFrame(rows, "i int, r array<double>, t array<double>, r0 array<double>, t0 array<double>")
    for g in jobs.bounded_corrections(df, 0.2, 4.0).collect():
        wr, wt, ws = want[g.i]
        assert np.allclose(np.array(g.r).reshape(3, 3), wr, atol=1e-7) and np.allclose(g.t, wt, atol=1e-7) and abs(g.shift - ws) < 1e-9
