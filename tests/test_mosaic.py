"""The plot mosaic against a plain NumPy version: turned and enlarged frames leave no hole."""

import numpy as np

from sensorlake.plans import jobs

W, H = 12, 10
MATCHES = "plot string, frame int, ts_ns bigint, seq bigint, h_rgb array<double>, n_rgb int, h_soil array<double>, n_soil int, h_ecc array<double>, h_phase array<double>"


def _plain(frames, poses):
    acc, weight = {}, {}
    spread = max(H * 0.18, 1.0)
    for img, pose in zip(frames, poses):
        inv = np.linalg.inv(pose)
        for r in range(-60, 80):
            for c in range(-60, 80):
                x, y, z = inv @ [c, r, 1.0]
                u, v = x / z, y / z
                fu, fv = int(np.floor(u)), int(np.floor(v))
                a, b = u - fu, v - fv
                near = (fv + (b >= 0.5), fu + (a >= 0.5))
                if not (0 <= near[0] < H and 0 <= near[1] < W):
                    continue
                val = w = 0.0
                for i, wb in ((0, 1 - b), (1, b)):
                    for j, wa in ((0, 1 - a), (1, a)):
                        if 0 <= fv + i < H and 0 <= fu + j < W:
                            val += wa * wb * img[fv + i, fu + j]
                            w += wa * wb * np.exp(-0.5 * ((fv + i - H * 0.5) / spread) ** 2)
                acc[r, c], weight[r, c] = acc.get((r, c), 0.0) + w * val, weight.get((r, c), 0.0) + w
    return {k: acc[k] / max(weight[k], 1e-3) for k in acc if weight[k] > 0.05}


def test_mosaic_of_turned_frames(spark):
    rng = np.random.default_rng(1)
    frames = rng.random((3, H, W)) * 100 + 50
    steps = [np.eye(3), np.array([[1.9, -0.43, 3.17], [0.41, 1.83, -7.29], [0.0011, 0.0007, 1.0]]), np.array([[0.97, 0.21, 0.53], [-0.19, 1.03, 2.31], [0.0, 0.0, 1.0]])]
    poses = [steps[0], steps[1], steps[1] @ steps[2]]
    px = spark.createDataFrame([("a", f, r, c, float(frames[f, r, c])) for f in range(3) for r in range(H) for c in range(W)], "plot string, frame int, r int, c int, v double")
    m = spark.createDataFrame([("a", f, f, f, [float(x) for x in steps[f].ravel()], 30, None, 0, None, None) for f in range(3)], MATCHES)
    d = jobs.plot_mosaic(px, m, W, H, "homography")
    want = _plain(frames, poses)
    y0, x0 = min(k[0] for k in want), min(k[1] for k in want)
    got = {(r.row + y0, r.col + x0): r.v for r in d["cells"].collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    box, can = d["crop"].first(), d["canvas"].first()
    assert (box.x1 - box.x0, box.y1 - box.y0) == (max(k[1] for k in want) - x0 + 1, max(k[0] for k in want) - y0 + 1)
    assert 0 <= box.x0 < box.x1 <= can.width and 0 <= box.y0 < box.y1 <= can.height
    # a row of the canvas has no hole between its first and last cell of the enlarged frame
    alone = _plain(frames[1:2], poses[1:2])
    for r in {k[0] for k in alone}:
        only = [c for rr, c in alone if rr == r]
        assert all((r, c) in got for c in range(min(only), max(only) + 1))


def test_mosaic_without_frames(spark):
    px = spark.createDataFrame([], "plot string, frame int, r int, c int, v double")
    d = jobs.plot_mosaic(px, spark.createDataFrame([], MATCHES), W, H)
    assert d["cells"].count() == 0 and d["crop"].count() == 0
