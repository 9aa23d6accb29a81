"""Candidate masks against plain array code."""

from __future__ import annotations

import numpy as np

from sensorlake.operators import pixels as px

CELLS = "frame string, r int, c int, v int, _b string, mean string"


def plain_masks(a: np.ndarray) -> dict[str, np.ndarray]:
    def along(m, k, mode, axis):
        h = len(k) // 2
        p = np.pad(m, [(h, h) if x == axis else (0, 0) for x in range(2)], mode=mode)
        return sum(w * np.take(p, range(i, i + m.shape[axis]), axis) for i, w in enumerate(k))

    both = lambda m, kr, kc, mode: along(along(m, kc, mode, 1), kr, mode, 0)
    b = np.floor(both(a.astype(float), [1, 4, 6, 4, 1], [1, 4, 6, 4, 1], "reflect") / 256 + 0.5)
    flat, best, t = b.ravel(), -1.0, 0
    for cut in range(256):
        low, high = flat[flat <= cut], flat[flat > cut]
        score = len(low) * len(high) * (low.mean() - high.mean()) ** 2 if len(low) and len(high) else 0.0
        if len(low) and (flat == cut).any() and score > best + 1e-9:
            best, t = score, cut
    out = {"otsu_hot": b > t, "otsu_cold": b <= t}
    for p in (60, 70, 80):
        out[f"hot_{p}"] = b >= int(np.percentile(b, p))
        out[f"cold_{100 - p}"] = b <= int(np.percentile(b, 100 - p))
    if min(a.shape) > 41:
        k = np.exp(-0.5 * (np.arange(-20, 21) / 6.5) ** 2)
        above = b > np.floor(both(b, k / k.sum(), k / k.sum(), "edge") + 0.5) - 2
        out["adaptive_hot"], out["adaptive_cold"] = above, ~above
    g = np.abs(both(b, [1, 2, 1], [-1, 0, 1], "reflect")) + np.abs(both(b, [-1, 0, 1], [1, 2, 1], "reflect"))
    lo, hi = np.percentile(g, [5, 99])
    u = np.clip((g - lo) * 255 / (hi - lo if hi > lo else 1.0), 0, 255).astype(np.uint8)
    out["edge"] = u >= int(np.percentile(u, 80))
    return out


def test_masks_of_several_frames(spark):
    r = np.random.default_rng(4)
    panel = r.integers(60, 90, (42, 47))
    panel[10:25, 8:30] += 120
    frames = {"panel": panel, "noise": r.integers(0, 256, (45, 44)), "small": r.integers(0, 256, (41, 60)), "flat": np.full((6, 7), 9), None: r.integers(0, 256, (5, 8))}
    rows = [(k, i, j, int(v), "x", "y") for k, a in frames.items() for (i, j), v in np.ndenumerate(a)]
    got: dict = {}
    for x in px.mask_variants(spark.createDataFrame([*rows, ("small", 0, 99, None, "x", "y")], CELLS), ["frame"], "v").collect():
        for n, flag in x.asDict().items():
            if n not in ("frame", "r", "c") and flag is not None:
                got.setdefault((x.frame, n), np.full(frames[x.frame].shape, -1))[x.r, x.c] = flag
    want = {(k, n): m.astype(int) for k, a in frames.items() for n, m in plain_masks(a).items()}
    assert got.keys() == want.keys()
    assert [k for k in want if not (got[k] == want[k]).all()] == []
    assert px.mask_variants(spark.createDataFrame([], CELLS), ["frame"], "v").count() == 0
