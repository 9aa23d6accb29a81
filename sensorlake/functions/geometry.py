"""Projections, rotations, homographies, boxes and corner grids as Column expressions.

Matrices are row-major ARRAY<DOUBLE>; boxes are STRUCT<x0, y0, x1, y1>; corner
sets are ARRAY<STRUCT<x, y>>.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- UTM (Krueger series, 4th order)
# WGS84 and the transverse Mercator scale.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
_N = WGS84_F / (2 - WGS84_F)
KRUEGER_A = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180.0) / 6.0).cast("int") + 1


def utm_epsg(lon: Column, lat: Column) -> Column:
    return utm_zone(lon) + F.when(lat >= 0, 32600).otherwise(32700)


def utm_forward(lon: Column, lat: Column, zone: Column) -> Column:
    """STRUCT<e, n> in metres for a fixed zone (one zone per recording)."""
    phi = F.radians(lat)
    lam = F.radians(lon - (zone * 6.0 - 183.0))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t))
    e, n = eta, xi
    for j, a in enumerate(ALPHA, 1):
        e = e + a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        n = n + a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    north = UTM_K0 * KRUEGER_A * n + F.when(lat >= 0, 0.0).otherwise(10_000_000.0)
    return F.struct((500_000.0 + UTM_K0 * KRUEGER_A * e).alias("e"), north.alias("n"))


def utm_inverse(e: Column, n: Column, zone: Column, northern: Column) -> Column:
    """STRUCT<lon, lat> in degrees."""
    xi = (n - F.when(northern, 0.0).otherwise(10_000_000.0)) / (UTM_K0 * KRUEGER_A)
    eta = (e - 500_000.0) / (UTM_K0 * KRUEGER_A)
    x, y = xi, eta
    for j, b in enumerate(BETA, 1):
        x = x - b * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
        y = y - b * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2.0 * j * chi)
    lon = zone * 6.0 - 183.0 + F.degrees(F.atan2(F.sinh(y), F.cos(x)))
    return F.struct(lon.alias("lon"), F.degrees(phi).alias("lat"))


# ---------------------------------------------------------------- rotations
def quat_from_rpy(roll: Column, pitch: Column, yaw: Column) -> Column:
    """STRUCT<x, y, z, w>: turn about x, then y, then z."""
    def about(axis: int, angle: Column) -> Column:
        v = [F.lit(0.0)] * 3
        v[axis] = F.sin(angle / 2.0)
        return quat(*v, F.cos(angle / 2.0))

    return quat_mul(quat_mul(about(2, yaw), about(1, pitch)), about(0, roll))


def quat(x, y, z, w) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"), _c(z).alias("z"), _c(w).alias("w"))


def quat_mul(a: Column, b: Column) -> Column:
    """Hamilton product."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: _hamilton(p["a"], p["b"]))


def _hamilton(a: Column, b: Column) -> Column:
    av, bv = [a[k] for k in "xyz"], [b[k] for k in "xyz"]
    cross = [av[1] * bv[2] - av[2] * bv[1], av[2] * bv[0] - av[0] * bv[2], av[0] * bv[1] - av[1] * bv[0]]
    dot = av[0] * bv[0] + av[1] * bv[1] + av[2] * bv[2]
    return quat(*[a["w"] * bv[i] + b["w"] * av[i] + cross[i] for i in range(3)], a["w"] * b["w"] - dot)


def quat_norm2(q: Column) -> Column:
    return q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"]


def quat_inverse(q: Column) -> Column:
    """Inverse; the zero quaternion gives the identity."""
    def body(q: Column) -> Column:
        n = quat_norm2(q)
        return F.when(n > 0, quat(-q["x"] / n, -q["y"] / n, -q["z"] / n, q["w"] / n)).otherwise(quat(0.0, 0.0, 0.0, 1.0))

    return let(q, body)


def quat_normalise(q: Column) -> Column:
    def body(q: Column) -> Column:
        n = F.sqrt(quat_norm2(q))
        return F.when(n > 0, quat(q["x"] / n, q["y"] / n, q["z"] / n, q["w"] / n)).otherwise(quat(0.0, 0.0, 0.0, 1.0))

    return let(q, body)


def quat_to_matrix(q: Column) -> Column:
    """Row-major 3x3 of the normalised quaternion."""
    return let(q, _matrix_of)


def _matrix_of(q: Column) -> Column:
    n = quat_norm2(q)
    s = F.when(n > 0, 2.0 / n).otherwise(F.lit(0.0))
    p = lambda a, b: q[a] * q[b] * s
    return F.array(
        1.0 - p("y", "y") - p("z", "z"), p("x", "y") - p("z", "w"), p("x", "z") + p("y", "w"),
        p("x", "y") + p("z", "w"), 1.0 - p("x", "x") - p("z", "z"), p("y", "z") - p("x", "w"),
        p("x", "z") - p("y", "w"), p("y", "z") + p("x", "w"), 1.0 - p("x", "x") - p("y", "y"),
    )


def m(a: Column, i: int, j: int, n: int = 3) -> Column:
    return F.get(a, F.lit(i * n + j))


def quat_from_matrix(r: Column) -> Column:
    """Quaternion of a 3x3 rotation, using the largest of the four squared components."""
    return let(r, _quat_of)


def _quat_of(r: Column) -> Column:
    d = [m(r, i, i) for i in range(3)]
    tr = d[0] + d[1] + d[2]
    sizes = [1.0 + 2.0 * d[i] - tr for i in range(3)]

    def by_axis(i: int) -> Column:
        j, k = (i + 1) % 3, (i + 2) % 3
        s = 2.0 * F.sqrt(F.greatest(sizes[i], F.lit(0.0)))
        v: list = [None] * 3
        v[i], v[j], v[k] = s / 4.0, (m(r, i, j) + m(r, j, i)) / s, (m(r, i, k) + m(r, k, i)) / s
        return quat(*v, (m(r, k, j) - m(r, j, k)) / s)

    s = 2.0 * F.sqrt(F.greatest(1.0 + tr, F.lit(0.0)))
    main = quat((m(r, 2, 1) - m(r, 1, 2)) / s, (m(r, 0, 2) - m(r, 2, 0)) / s, (m(r, 1, 0) - m(r, 0, 1)) / s, s / 4.0)
    return F.when(tr > 0, main).when((d[0] >= d[1]) & (d[0] >= d[2]), by_axis(0)).when(d[1] >= d[2], by_axis(1)).otherwise(by_axis(2))


def accel_tilt(ax: Column, ay: Column, az: Column) -> Column:
    """Attitude from gravity alone (yaw 0)."""
    return quat_from_rpy(F.atan2(ay, az), F.atan2(-ax, F.sqrt(ay * ay + az * az)), F.lit(0.0))


def accel_tilt_input(ax: Column, ay: Column, az: Column, extrinsic: Column) -> Column:
    """Tilt of the accelerometer after the 3x3 extrinsic, times its inverse, normalised."""
    t = [m(extrinsic, i, 0) * ax + m(extrinsic, i, 1) * ay + m(extrinsic, i, 2) * az for i in range(3)]
    return quat_normalise(quat_mul(accel_tilt(*t), quat_inverse(quat_from_matrix(extrinsic))))


def rotation_angle_deg(r: Column) -> Column:
    c = (m(r, 0, 0) + m(r, 1, 1) + m(r, 2, 2) - 1.0) / 2.0
    return F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))))


def yaw_deg(r: Column) -> Column:
    return F.degrees(F.atan2(m(r, 1, 0), m(r, 0, 0)))


def rodrigues(rx: Column, ry: Column, rz: Column) -> Column:
    """3x3 rotation of a rotation vector."""
    def body(v: Column) -> Column:
        a = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
        k = F.when(a > 1e-12, F.sin(a / 2.0) / a).otherwise(F.lit(0.5))
        return quat_to_matrix(quat(v["x"] * k, v["y"] * k, v["z"] * k, F.cos(a / 2.0)))

    return let(F.struct(rx.alias("x"), ry.alias("y"), rz.alias("z")), body)


def clamp_length(v: Sequence[Column], limit: float) -> list[Column]:
    """Vector shortened to ``limit`` (direction kept)."""
    n = F.sqrt(sum((c * c for c in v[1:]), v[0] * v[0]))
    f = F.when((n > limit) & F.lit(limit > 0), F.lit(limit) / n).otherwise(F.lit(1.0))
    return [c * f for c in v]


def rotate(r: Column, p: Sequence[Column]) -> list[Column]:
    return [m(r, i, 0) * p[0] + m(r, i, 1) * p[1] + m(r, i, 2) * p[2] for i in range(3)]


def rigid_apply(r: Column, t: Column, p: Sequence[Column]) -> list[Column]:
    """R p + t with a 3x3 and a 3-vector."""
    return [c + F.get(t, F.lit(i)) for i, c in enumerate(rotate(r, p))]


def rigid_inverse(r: Column, t: Column) -> tuple[Column, Column]:
    rt = F.array(*[m(r, j, i) for i in range(3) for j in range(3)])
    back = rotate(rt, [F.get(t, F.lit(i)) for i in range(3)])
    return rt, F.array(*[-c for c in back])


# Design transforms of the scanner in millimetres (row-major 4x4).
LIDAR_TO_SENSOR_MM = ((-1.0, 0.0, 0.0, 0.0), (0.0, -1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 38.195), (0.0, 0.0, 0.0, 1.0))
IMU_TO_SENSOR_MM = ((1.0, 0.0, 0.0, 6.253), (0.0, 1.0, 0.0, -11.775), (0.0, 0.0, 1.0, 7.645), (0.0, 0.0, 0.0, 1.0))


def design_extrinsic(mode: str) -> list[float]:
    """LiDAR-to-IMU transform in metres for ``identity``, ``sensor_frame`` or ``lidar_frame``."""
    import numpy as np

    imu, lidar = np.array(IMU_TO_SENSOR_MM), np.array(LIDAR_TO_SENSOR_MM)
    choices = {"identity": np.eye(4), "sensor_frame": imu, "lidar_frame": np.linalg.inv(imu) @ lidar}
    if mode not in choices:
        raise ValueError(f"unknown extrinsic mode {mode}")
    t = choices[mode].copy()
    t[:3, 3] *= 0.001
    return [float(v) for v in t.ravel()]


# ---------------------------------------------------------------- 2-D similarity
def similarity_apply(x: Column, y: Column, s: Column, theta: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    """Turn by ``theta``, scale, shift."""
    c, d = F.cos(theta), F.sin(theta)
    return s * (c * x - d * y) + tx, s * (d * x + c * y) + ty


def similarity_invert(x: Column, y: Column, s: Column, theta: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    c, d = F.cos(theta), F.sin(theta)
    u, v = (x - tx) / s, (y - ty) / s
    return c * u + d * v, -d * u + c * v


# ---------------------------------------------------------------- camera
def project(x: Column, y: Column, z: Column, k: Sequence[float], dist: Sequence[float] = (0, 0, 0, 0, 0)) -> tuple[Column, Column]:
    """Pinhole with radial (k1, k2, k3) and tangential (p1, p2) terms; ``k`` = fx, fy, cx, cy."""
    fx, fy, cx, cy = (float(v) for v in k)
    k1, k2, p1, p2, k3 = (float(v) for v in dist)
    a, b = x / z, y / z
    r2 = a * a + b * b
    radial = 1.0 + r2 * (k1 + r2 * (k2 + r2 * k3))
    u = a * radial + 2.0 * p1 * a * b + p2 * (r2 + 2.0 * a * a)
    v = b * radial + p1 * (r2 + 2.0 * b * b) + 2.0 * p2 * a * b
    return fx * u + cx, fy * v + cy


# ---------------------------------------------------------------- homographies (row-major 3x3 arrays)
def h_apply(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    w = m(h, 2, 0) * x + m(h, 2, 1) * y + m(h, 2, 2)
    w = F.when(w != 0, w)
    return (m(h, 0, 0) * x + m(h, 0, 1) * y + m(h, 0, 2)) / w, (m(h, 1, 0) * x + m(h, 1, 1) * y + m(h, 1, 2)) / w


def h_normalise(h: Column) -> Column:
    return F.transform(h, lambda v: v / m(h, 2, 2))


def h_inverse(h: Column) -> Column:
    """Adjugate scaled to h22 = 1 (the determinant cancels)."""
    def minor(i: int, j: int) -> Column:
        (a, b), (c, d) = [q for q in range(3) if q != i], [q for q in range(3) if q != j]
        v = m(h, a, c) * m(h, b, d) - m(h, a, d) * m(h, b, c)
        return v if (i + j) % 2 == 0 else -v

    adj = [minor(j, i) for i in range(3) for j in range(3)]
    return F.array(*[v / adj[8] for v in adj])


def h_inverse_of(h: Sequence[float]) -> Column:
    """:func:`h_inverse` of nine numbers, as nine literals: a plan that uses it often stays small."""
    def minor(i: int, j: int) -> float:
        (a, b), (c, d) = [q for q in range(3) if q != i], [q for q in range(3) if q != j]
        v = float(h[3 * a + c]) * float(h[3 * b + d]) - float(h[3 * a + d]) * float(h[3 * b + c])
        return v if (i + j) % 2 == 0 else -v

    adj = [minor(j, i) for i in range(3) for j in range(3)]
    return F.array(*[F.lit(v / adj[8]) for v in adj])


def h_compose(a: Column, b: Column) -> Column:
    """``a . b`` scaled to h22 = 1 (apply ``b`` first)."""
    from sensorlake.operators.trajectory import matmul

    return h_normalise(matmul(a, b, 3))


def constrain_pair(h: Column, width: int, height: int, mode: str) -> Column:
    """Full transform, or the median shift of the four quarter points (vertical part only for strips)."""
    if mode not in ("translation", "vertical_strip"):
        return h
    quarter = [(fx * width, fy * height) for fx in (0.25, 0.75) for fy in (0.25, 0.75)]
    moved = [h_apply(h, F.lit(x), F.lit(y)) for x, y in quarter]
    middle = lambda vals: (F.get(F.array_sort(F.array(*vals)), F.lit(1)) + F.get(F.array_sort(F.array(*vals)), F.lit(2))) / 2.0
    dx = F.lit(0.0) if mode == "vertical_strip" else middle([u - x for (u, _), (x, _) in zip(moved, quarter)])
    dy = middle([v - y for (_, v), (_, y) in zip(moved, quarter)])
    o, i = F.lit(0.0), F.lit(1.0)
    return F.array(i, o, dx, o, i, dy, o, o, i)


# ---------------------------------------------------------------- boxes
def box(x0, y0, x1, y1) -> Column:
    return F.struct(_c(x0).alias("x0"), _c(y0).alias("y0"), _c(x1).alias("x1"), _c(y1).alias("y1"))


def box_area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def clip_box(b: Column, width, height) -> Column:
    """Corners moved into the image (last pixel inclusive); NULL when nothing is left."""
    w, h, o = _c(width) - 1.0, _c(height) - 1.0, F.lit(0.0)
    inside = lambda v, top: F.greatest(o, F.least(top, v))
    c = box(inside(b["x0"], w), inside(b["y0"], h), inside(b["x1"], w), inside(b["y1"], h))
    return F.when((c["x1"] > c["x0"]) & (c["y1"] > c["y0"]), c)


def project_box(b: Column, h: Column, width, height) -> Column:
    """Bounding box of the projected corners inside the target image."""
    pts = [h_apply(h, b[x], b[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    us, vs = F.array(*[p[0] for p in pts]), F.array(*[p[1] for p in pts])
    lo = lambda a: F.greatest(F.lit(0.0), F.array_min(a))
    c = box(lo(us), lo(vs), F.least(_c(width) - 1.0, F.array_max(us)), F.least(_c(height) - 1.0, F.array_max(vs)))
    return F.when(b.isNotNull() & h.isNotNull() & (c["x1"] > c["x0"]) & (c["y1"] > c["y0"]), c)


def rescale_box(b: Column, fw, fh, tw, th) -> Column:
    sx, sy = _c(tw).cast("double") / _c(fw), _c(th).cast("double") / _c(fh)
    return F.when(b.isNotNull() & (_c(fw) > 0) & (_c(fh) > 0), box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy))


def expand_box(b: Column, width, height, frac: float, min_pad: int, min_w: int = 0, min_h: int = 0) -> Column:
    """Whole-pixel box grown on all sides by ``max(min_pad, frac * size)``; NULL below the minimum size."""
    px = F.greatest(F.lit(min_pad), ((b["x1"] - b["x0"]) * frac).cast("int"))
    py = F.greatest(F.lit(min_pad), ((b["y1"] - b["y0"]) * frac).cast("int"))
    o = F.lit(0)
    c = box(
        F.greatest(o, F.floor(b["x0"]).cast("int") - px), F.greatest(o, F.floor(b["y0"]).cast("int") - py),
        F.least(_c(width), F.ceil(b["x1"]).cast("int") + px), F.least(_c(height), F.ceil(b["y1"]).cast("int") + py),
    )
    ok = (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]) & (c["x1"] - c["x0"] >= min_w) & (c["y1"] - c["y0"] >= min_h)
    return F.when(ok, c)


def box_iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    union = box_area(a) + box_area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def corners_box(corners: Column) -> Column:
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


# Fixed value: padding from the inner corners to the panel, as a share of the box.
PANEL_PAD = 0.18


def panel_box(corners: Column) -> Column:
    b = corners_box(corners)
    px, py = (b["x1"] - b["x0"]) * PANEL_PAD, (b["y1"] - b["y0"]) * PANEL_PAD
    return box(b["x0"] - px, b["y0"] - py, b["x1"] + px, b["y1"] + py)


# ---------------------------------------------------------------- corner grids (row-major, cols x rows)
def grid_at(corners: Column, cols: Column, r: Column, c: Column) -> Column:
    return F.get(corners, (r * cols + c).cast("int"))


def flip_rows(corners: Column, cols: Column, rows: Column) -> Column:
    return F.flatten(F.transform(F.sequence(rows - 1, F.lit(0), F.lit(-1)), lambda r: F.slice(corners, r * cols + 1, cols)))


def flip_cols(corners: Column, cols: Column, rows: Column) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.reverse(F.slice(corners, r * cols + 1, cols))))


def _edges(g: Column, cols: Column, rows: Column) -> tuple[list[Column], list[Column]]:
    o = F.lit(0)
    a, b, c = grid_at(g, cols, o, o), grid_at(g, cols, o, cols - 1), grid_at(g, cols, rows - 1, o)
    return [b["x"] - a["x"], b["y"] - a["y"]], [c["x"] - a["x"], c["y"] - a["y"]]


def _cross(g: Column, cols: Column, rows: Column) -> Column:
    along, down = _edges(g, cols, rows)
    return along[0] * down[1] - along[1] * down[0]


def canonical_grid(corners: Column, cols: Column, rows: Column) -> Column:
    """Rows reversed when the grid is left-handed."""
    return F.when(_cross(corners, cols, rows) < 0, flip_rows(corners, cols, rows)).otherwise(corners)


def grid_angle_deg(g: Column, cols: Column, rows: Column) -> Column:
    along, _ = _edges(g, cols, rows)
    return F.degrees(F.atan2(along[1], along[0]))


# Smallest ratio of the column edge to the row edge for an
# acceptable rotation, per product.
ROTATION_RATIO = {"intrinsics": 0.55, "campaign": 0.75, "deep": 1.0, "refined": 0.0}


def rotation_ok(g: Column, cols: Column, rows: Column, ratio: float) -> Column:
    along, down = _edges(g, cols, rows)
    n = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1])
    return (_cross(g, cols, rows) > 0) & (n(along) >= ratio * n(down))


def upright_grid(corners: Column, cols: Column, rows: Column) -> Column:
    """The flip (none, rows, columns, both) that best runs left to right and top to bottom.

    A right-handed grid gets a bonus of 0.25; the earlier flip wins a tie.
    """
    fr = flip_rows(corners, cols, rows)
    fc = flip_cols(corners, cols, rows)
    both = flip_cols(fr, cols, rows)
    variants = F.array(corners, fr, fc, both)

    def score(g: Column) -> Column:
        def total(start, n, far, near, k):
            return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + far(i)[k] - near(i)[k]) / n

        ax = [total(0, rows, lambda i: grid_at(g, cols, i, cols - 1), lambda i: grid_at(g, cols, i, F.lit(0)), k) for k in "xy"]
        dn = [total(0, cols, lambda i: grid_at(g, cols, rows - 1, i), lambda i: grid_at(g, cols, F.lit(0), i), k) for k in "xy"]
        na, nd = F.sqrt(ax[0] * ax[0] + ax[1] * ax[1]) + 1e-6, F.sqrt(dn[0] * dn[0] + dn[1] * dn[1]) + 1e-6
        return ax[0] / na + dn[1] / nd + F.when(ax[0] * dn[1] - ax[1] * dn[0] > 0, 0.25).otherwise(0.0)

    ranked = F.transform(variants, lambda g, i: F.struct(score(g).alias("s"), (-i).alias("i"), g.alias("g")))
    return F.array_max(ranked)["g"]


def grid_spacing(g: Column, cols: Column, rows: Column) -> Column:
    """Median distance between neighbouring corners along rows and columns."""
    def dist(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        return F.sqrt(dx * dx + dy * dy)

    idx = F.sequence(F.lit(0), F.size(g) - 1)
    right = F.transform(F.filter(idx, lambda i: F.pmod(i, cols) < cols - 1), lambda i: dist(F.get(g, i), F.get(g, i + 1)))
    down = F.transform(F.filter(idx, lambda i: i < (rows - 1) * cols), lambda i: dist(F.get(g, i), F.get(g, i + cols)))
    d = F.array_sort(F.concat(right, down))
    n = F.size(d)
    return (F.get(d, F.floor((n - 1) / 2).cast("int")) + F.get(d, F.floor(n / 2).cast("int"))) / 2.0


def spacing_score(g: Column, cols: Column, rows: Column, width, height) -> Column:
    """Spacing + 80 * (box area / image area, at most 1)."""
    area = F.greatest(box_area(corners_box(g)), F.lit(1.0))
    return grid_spacing(g, cols, rows) + 80.0 * F.least(area / F.greatest(_c(width) * _c(height) * 1.0, F.lit(1.0)), F.lit(1.0))


def residual_bonus(score: Column, max_px: Column) -> Column:
    """+5 for a consistent grid (max < 2 px), minus up to 15 above 4 px."""
    return score + F.when(max_px < 2.0, 5.0).when(max_px > 4.0, -F.least(2.0 * max_px, F.lit(15.0))).otherwise(0.0)


def checker_score(b: Column, sharpness: Column, width, height) -> Column:
    """100 * area share + margin term in -1..1 + sharpness term up to 1."""
    w, h = _c(width) * 1.0, _c(height) * 1.0
    margin = F.least(b["x0"], b["y0"], w - b["x1"], h - b["y1"]) / F.greatest(F.least(w, h), F.lit(1.0))
    return 100.0 * box_area(b) / F.greatest(w * h, F.lit(1.0)) + F.least(F.greatest(8.0 * margin, F.lit(-1.0)), F.lit(1.0)) + F.least(sharpness / 150.0, F.lit(1.0))


def rescue_score(base: Column, cols: Column, rows: Column, full: Column, rot_ok: Column, max_px: Column) -> Column:
    s = base + 0.35 * cols * rows + F.when(full, 50.0).otherwise(0.0) + F.when(rot_ok, 15.0).otherwise(0.0)
    return residual_bonus(s, max_px)


def hull_score(area: Column, cols: Column, rows: Column, per_corner: float) -> Column:
    return area + per_corner * cols * rows


def lattice(cols: int, rows: int, square: float, col0: int = 0, row0: int = 0) -> Column:
    """ARRAY<STRUCT<k, x, y, z>> of board points in row-major order."""
    return F.array(*[
        F.struct(F.lit(r * cols + c).alias("k"), F.lit((col0 + c) * square).alias("x"), F.lit((row0 + r) * square).alias("y"), F.lit(0.0).alias("z"))
        for r in range(rows) for c in range(cols)
    ])


def template_corners(b: Column, nx: int, ny: int) -> Column:
    """Inner corners of an ``nx`` x ``ny`` square template laid evenly over a box."""
    fx, fy = (b["x1"] - b["x0"]) / float(nx), (b["y1"] - b["y0"]) / float(ny)
    return F.array(*[F.struct((b["x0"] + fx * float(i)).alias("x"), (b["y0"] + fy * float(j)).alias("y")) for j in range(1, ny) for i in range(1, nx)])


def back_map(corners: Column, scale: Column, x0: Column, y0: Column) -> Column:
    """Corners found in a scaled crop, in full-image pixels."""
    return F.transform(corners, lambda p: F.struct((p["x"] / scale + x0).alias("x"), (p["y"] / scale + y0).alias("y")))


# ---------------------------------------------------------------- search regions
# Crops as shares of width and height, per product; "half" edges
# use whole-pixel halves, sixths and the given corner shares.
REGION_LAYOUTS = {
    "intrinsics": {"corner": 0.68, "far": 0.32, "centre": True, "min": (1, 1), "suffix": ""},
    "campaign": {"corner": 0.72, "far": 0.28, "centre": False, "min": (35, 25), "suffix": ""},
    "refined": {"corner": 0.70, "far": 0.30, "centre": False, "min": (40, 30), "suffix": "_half"},
}


def search_regions(width: Column, height: Column, layout: str, guides: Sequence[tuple[str, Column]] = ()) -> Column:
    """ARRAY<STRUCT<pos, name, x0, y0, x1, y1>>: guided boxes first, then the fixed crops.

    Equal boxes keep the first name; crops below the minimum size disappear.
    """
    cfg = REGION_LAYOUTS[layout]
    w, h, o = width.cast("int"), height.cast("int"), F.lit(0)
    half = lambda v: F.floor(v / 2).cast("int")
    near = lambda v: (v * cfg["corner"]).cast("int")
    far = lambda v: (v * cfg["far"]).cast("int")
    sx = cfg["suffix"]
    rows = [(n, F.struct(*[g[k].alias(k) for k in ("x0", "y0", "x1", "y1")])) for n, g in guides]
    rows += [
        ("full", box(o, o, w, h)),
        (f"left{sx}", box(o, o, half(w), h)),
        (f"right{sx}", box(half(w), o, w, h)),
        (f"top{sx}", box(o, o, w, half(h))),
        (f"bottom{sx}", box(o, half(h), w, h)),
    ]
    if cfg["centre"]:
        sixth = lambda v, k: F.floor(v * k / 6).cast("int")
        rows.append(("center", box(sixth(w, 1), sixth(h, 1), sixth(w, 5), sixth(h, 5))))
    rows += [
        ("top_left", box(o, o, near(w), near(h))),
        ("top_right", box(far(w), o, w, near(h))),
        ("bottom_left", box(o, far(h), near(w), h)),
        ("bottom_right", box(far(w), far(h), w, h)),
    ]
    all_ = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), b.alias("b")) for i, (n, b) in enumerate(rows)])
    mw, mh = cfg["min"]
    sized = F.filter(all_, lambda r: (r["b"]["x1"] - r["b"]["x0"] >= mw) & (r["b"]["y1"] - r["b"]["y0"] >= mh))
    first = F.filter(sized, lambda r: ~F.exists(sized, lambda q: (q["pos"] < r["pos"]) & (q["b"] == r["b"])))
    return F.transform(first, lambda r: F.struct(r["pos"].alias("pos"), r["name"].alias("name"), *[r["b"][k].alias(k) for k in ("x0", "y0", "x1", "y1")]))


# ---------------------------------------------------------------- planes
def plane_normalise(n: Sequence[Column], d: Column) -> tuple[list[Column], Column]:
    """Unit normal and matching offset; NULL for a vanishing normal."""
    s = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    s = F.when(s >= 1e-9, s)
    return [v / s for v in n], d / s


def face_camera(n: Sequence[Column], centre: Sequence[Column]) -> list[Column]:
    """Normal turned towards the origin (the camera)."""
    away = n[0] * centre[0] + n[1] * centre[1] + n[2] * centre[2] > 0
    return [F.when(away, -v).otherwise(v) for v in n]


# Half thickness and radius of the expected panel, in metres.
PANEL_TIGHT = (0.10, 0.42)
PANEL_BROAD = (0.20, 0.62)


def panel_window(p: Sequence[Column], centre: Sequence[Column], n: Sequence[Column], window: tuple[float, float]) -> Column:
    """Point lies within the slab and cylinder around the predicted panel."""
    d = [a - b for a, b in zip(p, centre)]
    along = d[0] * n[0] + d[1] * n[1] + d[2] * n[2]
    side = [a - along * b for a, b in zip(d, n)]
    return (F.abs(along) < window[0]) & (F.sqrt(side[0] * side[0] + side[1] * side[1] + side[2] * side[2]) < window[1])
