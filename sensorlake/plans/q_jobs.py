"""Queries that run the end-to-end jobs over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sensorlake.functions import geometry as gm
from sensorlake.operators import trajectory
from sensorlake.plans import jobs
from sensorlake.plans.fixtures import DAY_NS, fx_pixels, fx_points, fx_stream, with_sql
from sensorlake.plans.q_geometry import PLOTS_SQL, _plots, _track
from sensorlake.plans.registry import query

LON = "(10.0::DOUBLE+(v-50)*1e-5::DOUBLE)"
LAT = "(45.0::DOUBLE+((seq%97)-48)*1e-5::DOUBLE)"


def _moving(spark, sf):
    """Clicks are poses, purchases are fixes of the same recording; both carry a position."""
    s = fx_stream(spark, sf)
    odo = s.where("st = 'click'").select("k", "ts_ns", "seq", (F.col("v") * 0.8).alias("x"), (F.pmod("seq", F.lit(97)) * 1.1).alias("y"))
    fix = s.where("st = 'purchase'").select("k", "ts_ns", "seq", (10.0 + (F.col("v") - 50) * 1e-5).alias("lon"), (45.0 + (F.pmod("seq", F.lit(97)) - 48) * 1e-5).alias("lat"))
    return odo, fix


def _georef_sql():
    k = repr(gm.UTM_K0 * gm.KRUEGER_A) + "::DOUBLE"
    fe = "+".join(f"{a!r}::DOUBLE*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(gm.ALPHA, 1))
    fn = "+".join(f"{a!r}::DOUBLE*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(gm.ALPHA, 1))
    return f"""nr AS (SELECT l.k, l.seq, l.v*0.8::DOUBLE AS sx, (l.seq%97)*1.1::DOUBLE AS sy, 10.0::DOUBLE+(r.v-50)*1e-5::DOUBLE AS lon, 45.0::DOUBLE+((r.seq%97)-48)*1e-5::DOUBLE AS lat, abs(l.ts_ns-r.ts_ns) AS dt,
  row_number() OVER (PARTITION BY l.seq ORDER BY abs(l.ts_ns-r.ts_ns), r.ts_ns, r.seq) AS rn FROM fx_stream l JOIN fx_stream r ON l.k=r.k AND r.st='purchase' WHERE l.st='click'),
u AS (SELECT k, sx, sy, 500000+{k}*(eta+{fe}) AS dx, {k}*(xi+{fn}) AS dy FROM (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta FROM (
  SELECT *, radians(lon-9) AS lam, sinh(atanh(sin(radians(lat)))-{gm._ECC!r}::DOUBLE*atanh({gm._ECC!r}::DOUBLE*sin(radians(lat)))) AS t FROM nr WHERE rn=1 AND dt<={2 * DAY_NS}))),
m AS (SELECT k, avg(sx) AS a, avg(sy) AS b, avg(dx) AS c, avg(dy) AS d FROM u GROUP BY k),
s AS (SELECT k, sum((sx-a)*(dx-c)+(sy-b)*(dy-d)) AS p, sum((sx-a)*(dy-d)-(sy-b)*(dx-c)) AS q, sum((sx-a)*(sx-a)+(sy-b)*(sy-b)) AS r FROM u JOIN m USING (k) GROUP BY k),
f AS (SELECT k, a, b, c, d, CASE WHEN r<=1e-12::DOUBLE THEN 0 ELSE atan2(q,p) END AS theta, CASE WHEN r<=1e-12::DOUBLE THEN 1 ELSE sqrt(p*p+q*q)/r END AS scale FROM s JOIN m USING (k)),
e AS (SELECT k, theta, scale, sqrt(pow(scale*(cos(theta)*(sx-a)-sin(theta)*(sy-b))+c-dx,2)+pow(scale*(sin(theta)*(sx-a)+cos(theta)*(sy-b))+d-dy,2)) AS err FROM u JOIN f USING (k))"""


@query(
    "georeferenced_track",
    "JOB-01 SRC-05 SCL-02 AGG-22 AGG-19",
    with_sql(
        "SELECT k, count(*) AS n, round(avg(err),3) AS mean, round(median(err),3) AS median, round(quantile_cont(err,0.9),3) AS p90, round(max(err),3) AS max, round(sqrt(avg(err*err)),3) AS rms, round(scale,3) AS scale, round(theta,3) AS theta FROM e GROUP BY k, scale, theta",
        "fx_stream",
        _georef_sql(),
    ),
)
def georeferenced_track(spark, sf):
    odo, fix = _moving(spark, sf)
    g = jobs.georeference(odo, fix, ["k"], 2 * DAY_NS)
    m = g["residuals"].join(g["alignment"].select("k", "scale", "theta"), "k")
    return m.select("k", "n", *[F.round(c, 3).alias(c) for c in ("mean", "median", "p90", "max", "rms", "scale", "theta")])


@query("surface_model_job", "JOB-02 FLT-12 FLT-13 AGG-06 RAS-06 RAS-07")
def surface_model_job(spark, sf):
    p = fx_points(spark, sf).select("seq", "sub", "x", "y", "z", "intensity")
    c = jobs.surface_model(p, ["seq", "sub"], _track(spark, sf), ["month"], 0.25, 1.2, 0.5, 4)["cells"]
    return c.select("row", "col", "z", "intensity", "filled", F.round("height", 6).alias("height"), "n")


def _dem_px(spark, sf):
    return fx_pixels(spark, sf).select("frame", "r", "c", "v")


def _paint_sql() -> str:
    """Highest z per cell, seen by every frame whose ground box holds the cell's centre, painted from the best one."""
    from sensorlake.plans.q_points import cells_sql

    return with_sql(
        """SELECT row, col, frame, round(score,6) AS score, v FROM (SELECT row, col, s.frame, score, p.v, row_number() OVER (PARTITION BY row, col ORDER BY score DESC, s.frame, s.r, s.c) AS rn FROM s JOIN fx_pixels p ON p.frame=s.frame AND p.r=s.r AND p.c=s.c) WHERE rn=1""",
        "fx_points",
        "fx_pixels",
        cells_sql(0.5),
        """top AS (SELECT row, col, max(z) AS z, min(emin)+(col+0.5::DOUBLE)*0.5::DOUBLE AS ex, min(nmax)-(row+0.5::DOUBLE)*0.5::DOUBLE AS ny FROM cells, meta GROUP BY row, col),
seen AS (SELECT row, col, frame, ex-(frame*11.0::DOUBLE+6) AS a, ny-5 AS b, z+20 AS d FROM top JOIN (SELECT DISTINCT frame FROM fx_pixels) f ON ex BETWEEN frame*11.0::DOUBLE AND frame*11.0::DOUBLE+14 AND ny BETWEEN 0 AND 10),
lens AS (SELECT *, 1+((a/d)*(a/d)+(b/d)*(b/d))*(-0.1::DOUBLE+((a/d)*(a/d)+(b/d)*(b/d))*0.01::DOUBLE) AS k FROM seen),
pix AS (SELECT row, col, frame, round_even(180*(a/d)*k+32,0)::INT AS c, round_even(180*(b/d)*k+32,0)::INT AS r FROM lens WHERE d>0.05),
s AS (SELECT *, -(((c-32)/22.4::DOUBLE)*((c-32)/22.4::DOUBLE)+((r-32)/22.4::DOUBLE)*((r-32)/22.4::DOUBLE)) AS score FROM pix WHERE c BETWEEN 0 AND 63 AND r BETWEEN 0 AND 63)""",
    )


@query("painted_surface", "JOB-02 AGG-12 SCL-09 SCL-18 FLT-15", _paint_sql())
def painted_surface(spark, sf):
    from sensorlake.operators import rasterize as rz

    p = fx_points(spark, sf)
    meta = rz.raster_meta(p, 0.5)
    cells = rz.surface_max(rz.with_cells(p, meta), ["row", "col"], "z", ["seq", "sub"], [])
    px = _dem_px(spark, sf)
    f = px.select("frame").distinct()
    x0 = F.col("frame") * 11.0
    eye = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    views = f.select("frame", eye.alias("r"), F.array(-(x0 + 6.0), F.lit(-5.0), F.lit(20.0)).alias("t"), x0.alias("vx0"), (x0 + 14.0).alias("vx1"), F.lit(0.0).alias("vy0"), F.lit(10.0).alias("vy1"))
    d = jobs.paint_cells(cells, meta, views, px, (180.0, 180.0, 32.0, 32.0), (-0.1, 0.01, 0.0, 0.0, 0.0), 64, 64)
    return d.select("row", "col", "frame", F.round("score", 6).alias("score"), "v")


COLOURED_SQL = """span AS (SELECT min(ts_ns) AS a FROM fx_points),
f AS (SELECT frame, a+frame*2592000000000000 AS ts FROM (SELECT DISTINCT frame FROM fx_pixels), span),
near AS (SELECT p.*, f.frame AS near_frame, row_number() OVER (PARTITION BY p.seq, p.sub ORDER BY abs(p.ts_ns-f.ts), f.ts, f.frame) AS rn, abs(p.ts_ns-f.ts) AS dt FROM fx_points p, f),
seen AS (SELECT seq, sub, near_frame, x AS e, y AS n, z AS h, round_even(40*(((x-50)/20)/(z/2+1))+32,0)::INT AS c, round_even(40*((y-5)/(z/2+1))+32,0)::INT AS r FROM near WHERE rn=1 AND dt<=5184000000000000 AND z/2+1>0.05),
px AS (SELECT s.*, p.v FROM seen s JOIN fx_pixels p ON p.frame=s.near_frame AND p.r=s.r AND p.c=s.c WHERE s.c BETWEEN 0 AND 63 AND s.r BETWEEN 0 AND 63),
meta AS (SELECT min(e)-1 AS emin, max(e)+1 AS emax, min(n)-1 AS nmin, max(n)+1 AS nmax FROM px),
size AS (SELECT *, greatest(1, ceil((emax-emin)/0.5::DOUBLE)::INT) AS width, greatest(1, ceil((nmax-nmin)/0.5::DOUBLE)::INT) AS height FROM meta),
cells AS (SELECT px.*, least(greatest(trunc((nmax-n)/0.5::DOUBLE)::INT,0),height-1) AS row, least(greatest(trunc((e-emin)/0.5::DOUBLE)::INT,0),width-1) AS col FROM px, size)"""


@query(
    "coloured_cloud_raster",
    "JOB-03 JN-01 AGG-08",
    with_sql("SELECT row, col, h, v, n FROM (SELECT row, col, h, v, count(*) OVER (PARTITION BY row, col) AS n, row_number() OVER (PARTITION BY row, col ORDER BY h DESC, seq DESC, sub DESC) AS rn FROM cells) WHERE rn=1", "fx_points", "fx_pixels", COLOURED_SQL),
)
def coloured_cloud_raster(spark, sf):
    p = fx_points(spark, sf).select("seq", "sub", "ts_ns", ((F.col("x") - 50) / 20).alias("x"), (F.col("y") - 5).alias("y"), (F.col("z") / 2 + 1).alias("z"), F.col("x").alias("e"), F.col("y").alias("n"), F.col("z").alias("h"), F.lit(0).alias("bag"))
    px = _dem_px(spark, sf)
    at = p.agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b"))
    f = px.select("frame").distinct().withColumn("_b", at.select(F.struct("a", "b")).scalar())
    f = f.select(F.lit(0).alias("bag"), "frame", F.col("frame").alias("seq"), (F.col("_b.a") + F.col("frame") * F.lit(30 * DAY_NS)).alias("ts_ns"))
    d = jobs.coloured_cloud(p, f, px, ["bag"], 60 * DAY_NS, (40.0, 40.0, 32.0, 32.0), (0, 0, 0, 0, 0), 64, 64, 0.5, ["seq", "sub"])
    return d.select("row", "col", "h", "v", "n")


# Motion between two scans of the fixture: forward by the speed, a little to the side, and a small turn.
SIDE, TURN, MONTH_GAP = 0.04, 0.003, 60.0


def _month_scans(spark, sf):
    """One recording per year, one scan per month. A scan sees the points of its own month and of both
    neighbours (months apart in height, so only shared points can match) from its pose on the known track."""
    p = fx_points(spark, sf)
    at = F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000)))
    p = p.select(F.year(at).alias("rec"), F.month(at).alias("of"), F.xxhash64("seq", "sub").alias("pid"), "x", "y", (F.col("z") + MONTH_GAP * F.month(at)).alias("z"))
    f = p.groupBy("rec").agg(F.min("of").alias("a"), F.max("of").alias("b")).select("rec", F.explode(F.sequence("a", "b")).alias("month"), F.col("a"))
    speed = 0.2 + 0.02 * (F.col("rec") - 1992)
    f = f.select("rec", F.col("month"), (F.col("rec") * 100 + F.col("month")).alias("scan"), (F.col("month").cast("bigint") * 1_000_000_000).alias("ts_ns"), F.col("month").cast("bigint").alias("seq"), speed.alias("speed"), (F.col("month") - F.col("a")).alias("i"))
    j = F.sequence(F.lit(0), F.col("i") - 1)
    turned = lambda u: F.when(F.col("i") > 0, F.aggregate(j, F.lit(0.0), lambda s, k: s + u(k * TURN))).otherwise(F.lit(0.0))
    c, n = turned(F.cos), turned(F.sin)
    f = f.withColumn("tx", F.col("speed") * c - SIDE * n).withColumn("ty", F.col("speed") * n + SIDE * c).withColumn("yaw", F.col("i") * TURN)
    seen = p.withColumn("month", F.explode(F.array(F.col("of") - 1, F.col("of"), F.col("of") + 1))).join(f, ["rec", "month"])
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    cy, sy = F.cos("yaw"), F.sin("yaw")
    scans = seen.select("scan", "pid", (cy * dx + sy * dy).alias("x"), (cy * dy - sy * dx).alias("y"), "z")
    return scans, f.select("rec", "scan", "ts_ns", "seq", "speed")


@query(
    "scan_registration",
    "JOB-04 JN-15 AGG-23 AGG-37 WIN-08 WIN-11",
    with_sql(
        f"""SELECT rec, scan, variant, CASE WHEN variant='constrained' THEN 'x_plus' END AS axis, round(coalesce(sum(s*cos(j*{TURN})-{SIDE}*sin(j*{TURN})),0),3)+0 AS x, round(coalesce(sum(s*sin(j*{TURN})+{SIDE}*cos(j*{TURN})),0),3)+0 AS y,
  0.0::DOUBLE AS z, round(degrees(max(i)*{TURN}),2) AS yaw
FROM (SELECT rec::INT AS rec, (rec*100+m)::INT AS scan, m-a AS i, 0.2::DOUBLE+0.02::DOUBLE*(rec-1992) AS s FROM (
  SELECT *, unnest(range(a, b+1)) AS m FROM (SELECT year(make_timestamp(ts_ns//1000)) AS rec, min(month(make_timestamp(ts_ns//1000))) AS a, max(month(make_timestamp(ts_ns//1000))) AS b FROM fx_points GROUP BY 1)))
LEFT JOIN range(12) t(j) ON j < i, (SELECT unnest(['free','constrained']) AS variant) GROUP BY rec, scan, variant""",
        "fx_points",
    ),
)
def scan_registration(spark, sf):
    scans, f = _month_scans(spark, sf)
    d = jobs.register_track(scans, f, ["rec"], 1.0, 0.05, 2.0)["poses"]
    turn = gm.yaw_deg(F.array(*[F.get("pose", F.lit(4 * i + j)) for i in range(3) for j in range(3)]))
    return d.select("rec", "scan", "variant", "axis", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in "xyz"], F.round(turn, 2).alias("yaw"))


HV = (1.02, 0.01, 2.0, -0.01, 0.98, 1.0, 0.0001, 0.0002, 1.0)
HN = (0.97, -0.02, -1.0, 0.02, 1.01, 3.0, 0.0, 0.0001, 1.0)


def _warp_sql(name, h):
    a = np.linalg.inv(np.array(h).reshape(3, 3))
    a = [float(x) for x in (a / a[2, 2]).ravel()]
    at = lambda i: f"({a[i]!r}::DOUBLE*c+{a[i + 1]!r}::DOUBLE*r+{a[i + 2]!r}::DOUBLE)"
    return f"""{name} AS (SELECT frame, r, c, sum(w*v) AS v FROM (SELECT t.frame, t.r, t.c, s.v, (CASE WHEN j=1 THEN a ELSE 1-a END)*(CASE WHEN i=1 THEN b ELSE 1-b END) AS w, j=(a>=0.5)::INT AND i=(b>=0.5)::INT AS near FROM (
  SELECT *, u-floor(u) AS a, w0-floor(w0) AS b FROM (SELECT frame, r, c, {at(0)}/{at(6)} AS u, {at(3)}/{at(6)} AS w0 FROM (SELECT DISTINCT frame FROM fx_pixels), range(64) y(r), range(64) x(c))) t,
  (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j), fx_pixels s WHERE s.frame=t.frame AND s.r=floor(w0)::INT+i AND s.c=floor(u)::INT+j) GROUP BY frame, r, c HAVING bool_or(near))"""


@query(
    "registered_frame_sets",
    "JOB-05 RAS-01 AGG-34 AGG-36",
    with_sql(
        """SELECT frame, r::INT AS r, c::INT AS c, round(vis.v,5) AS vis, round(nir.v,5) AS nir FROM vis FULL JOIN nir USING (frame, r, c)
JOIN (SELECT frame, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM vis JOIN nir USING (frame, r, c) GROUP BY frame) b USING (frame) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1""",
        "fx_pixels",
        _warp_sql("vis", HV),
        _warp_sql("nir", HN),
    ),
)
def registered_frame_sets(spark, sf):
    px = _dem_px(spark, sf)
    sync = px.select("frame").distinct().select("frame", F.col("frame").alias("vis"), F.col("frame").alias("nir"))
    d = jobs.registered_frames(sync, {"vis": px, "nir": px}, {"vis": HV, "nir": HN}, 64, 64)
    return d["cells"].select("frame", "r", "c", F.round("vis", 5).alias("vis"), F.round("nir", 5).alias("nir"))


@query("plot_mosaic_job", "JOB-06 SCL-28 SCL-29 WIN-11 AGG-13 AGG-37")
def plot_mosaic_job(spark, sf):
    px = _dem_px(spark, sf).withColumn("plot", F.pmod("frame", F.lit(2)))
    f = px.select("plot", "frame").distinct()
    h = lambda dy: F.array(F.lit(1.0), F.lit(0.0), F.lit(0.4), F.lit(0.0), F.lit(1.0), dy, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    none = F.lit(None).cast("array<double>")
    m = f.select("plot", "frame", F.col("frame").alias("ts_ns"), F.col("frame").alias("seq"), h(F.col("frame") * -3.0 - 20).alias("h_rgb"), F.lit(30).alias("n_rgb"), none.alias("h_soil"), F.lit(0).alias("n_soil"), none.alias("h_ecc"), none.alias("h_phase"))
    d = jobs.plot_mosaic(px, m, 64, 64)
    return d["cells"].select("plot", "row", "col", F.round("v", 5).alias("v"), F.round("weight", 6).alias("weight"))


TURNED = (1.31, -0.23, 7.3, 0.27, 1.22, -23.7, 0.0003, 0.0002, 1.0)


def _turned_sql():
    m = np.array(TURNED).reshape(3, 3)
    at = np.array([[0, 0, 1], [64, 0, 1], [64, 64, 1], [0, 64, 1]]) @ m.T
    (x0, y0), (x1, y1) = np.floor((at[:, :2] / at[:, 2:]).min(0)).astype(int), np.ceil((at[:, :2] / at[:, 2:]).max(0)).astype(int)
    a = np.linalg.inv(m)
    a = [float(x) for x in (a / a[2, 2]).ravel()]
    line = lambda i: f"({a[i]!r}::DOUBLE*c+{a[i + 1]!r}::DOUBLE*r+{a[i + 2]!r}::DOUBLE)"
    g = lambda r: f"CASE WHEN {r}>=0 AND {r}<64 THEN exp(-0.5::DOUBLE*(({r}-32)/11.52::DOUBLE)*(({r}-32)/11.52::DOUBLE)) ELSE 0 END"
    return f"""t AS (SELECT frame, r, c, CASE WHEN frame%2=0 THEN c ELSE {line(0)}/{line(6)} END AS u, CASE WHEN frame%2=0 THEN r ELSE {line(3)}/{line(6)} END AS v FROM (SELECT DISTINCT frame FROM fx_pixels), range({min(y0, 0)}, {max(y1, 64) + 1}) y(r), range({min(x0, 0)}, {max(x1, 64) + 1}) x(c)),
q AS (SELECT *, floor(u)::INT AS fu, floor(v)::INT AS fv, u-floor(u) AS a, v-floor(v) AS b FROM t),
s AS (SELECT q.frame, q.r, q.c, fu, fv, a, b, sum((CASE WHEN j=1 THEN a ELSE 1-a END)*(CASE WHEN i=1 THEN b ELSE 1-b END)*p.v) AS val
  FROM q, (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j), fx_pixels p WHERE p.frame=q.frame AND p.r=fv+i AND p.c=fu+j
  GROUP BY q.frame, q.r, q.c, fu, fv, a, b HAVING bool_or(j=(a>=0.5)::INT AND i=(b>=0.5)::INT)),
w AS (SELECT *, ((1-b)*({g("fv")})+b*({g("(fv+1)")}))*((1-a)*(fu>=0 AND fu<64)::INT+a*(fu+1>=0 AND fu+1<64)::INT) AS w FROM s),
m AS (SELECT frame//2 AS plot, r, c, sum(w*val)/greatest(sum(w),1e-3::DOUBLE) AS v, sum(w) AS weight FROM w GROUP BY frame//2, r, c HAVING sum(w)>0.05::DOUBLE)"""


@query(
    "plot_mosaic_turned",
    "JOB-06 RAS-01 WIN-11 AGG-13",
    with_sql("SELECT plot, (r-min(r) OVER (PARTITION BY plot))::INT AS row, (c-min(c) OVER (PARTITION BY plot))::INT AS col, round(v,5) AS v, round(weight,6) AS weight FROM m", "fx_pixels", _turned_sql()),
)
def plot_mosaic_turned(spark, sf):
    px = _dem_px(spark, sf).withColumn("plot", F.expr("frame div 2"))
    none = F.lit(None).cast("array<double>")
    m = px.select("plot", "frame").distinct().select(
        "plot", "frame", F.col("frame").alias("ts_ns"), F.col("frame").alias("seq"), F.array(*[F.lit(x) for x in TURNED]).alias("h_rgb"), F.lit(30).alias("n_rgb"), none.alias("h_soil"), F.lit(0).alias("n_soil"), none.alias("h_ecc"), none.alias("h_phase")
    )
    d = jobs.plot_mosaic(px, m, 64, 64, "homography")
    return d["cells"].select("plot", "row", "col", F.round("v", 5).alias("v"), F.round("weight", 6).alias("weight"))


WINDOWS_SQL = """b AS (SELECT k, min(ts_ns)+172800000000000 AS lo, max(ts_ns)-172800000000000 AS hi FROM fx_stream WHERE st='click' GROUP BY k),
w AS (SELECT k, i AS win, lo + (hi-lo)//5*i + ((hi-lo)%5*i)//5 AS c FROM b, (SELECT unnest([0,1,2,3,4,5]) AS i)),
nr AS (SELECT l.k, l.ts_ns, l.seq, r.x, r.y, abs(l.ts_ns-r.ts_ns) AS dt, row_number() OVER (PARTITION BY l.seq ORDER BY abs(l.ts_ns-r.ts_ns), r.ts_ns, r.seq) AS rn
  FROM fx_stream l JOIN (SELECT *, v AS x, (seq%100)/10.0::DOUBLE AS y FROM fx_stream WHERE st='purchase') r ON l.k=r.k WHERE l.st='click'),
fa AS (SELECT nr.k, nr.ts_ns, plot_id FROM nr JOIN pl ON x>x0 AND x<x0+18 AND y>y0 AND y<y0+4 WHERE rn=1 AND dt<=86400000000000)"""


@query(
    "plot_window_discovery",
    "JOB-07 FLT-09 AGG-03 JN-06",
    with_sql(
        """SELECT k, plot_id, arg_max(win, {'n': frames, 'w': -win}) AS win, arg_max(c, {'n': frames, 'w': -win}) AS center_ns, max(frames) AS frames FROM (
  SELECT w.k, plot_id, win, c, count(*) AS frames FROM w JOIN fa ON fa.k=w.k AND abs(fa.ts_ns-w.c)<=172800000000000 GROUP BY w.k, plot_id, win, c HAVING count(*)>=1) GROUP BY k, plot_id""",
        "fx_stream",
        PLOTS_SQL,
        WINDOWS_SQL,
    ),
)
def plot_window_discovery(spark, sf):
    s = fx_stream(spark, sf)
    f = s.where("st = 'click'").select("k", "ts_ns", "seq")
    g = s.where("st = 'purchase'").select("k", "ts_ns", "seq", F.col("v").alias("x"), (F.pmod("seq", F.lit(100)) / F.lit(10.0)).alias("y"))
    d = jobs.plot_windows(f, g, _plots(spark), ["k"], 6, 2 * DAY_NS, DAY_NS, 1, 5.0)
    return d.select("k", "plot_id", F.col("win").cast("int").alias("win"), "center_ns", "frames")


@query(
    "plot_window_status",
    "JOB-07 SNK-09",
    with_sql(
        """SELECT k, plot_id, assigned, win, center_ns, frames, CASE WHEN frames IS NULL THEN 'outside_windows' WHEN frames<2 THEN 'too_few_frames' ELSE 'selected' END AS status
FROM (SELECT k, plot_id, count(*) AS assigned FROM fa GROUP BY k, plot_id) LEFT JOIN (
  SELECT k, plot_id, arg_max(win, {'n': frames, 'w': -win}) AS win, arg_max(c, {'n': frames, 'w': -win}) AS center_ns, max(frames) AS frames FROM (
    SELECT w.k, plot_id, win, c, count(*) AS frames FROM w JOIN fa ON fa.k=w.k AND abs(fa.ts_ns-w.c)<=172800000000000 GROUP BY w.k, plot_id, win, c) GROUP BY k, plot_id) USING (k, plot_id)
UNION ALL SELECT NULL, plot_id, 0, NULL, NULL, NULL, 'no_frames' FROM (SELECT DISTINCT plot_id FROM pl) WHERE plot_id NOT IN (SELECT plot_id FROM fa)""",
        "fx_stream",
        PLOTS_SQL,
        WINDOWS_SQL,
    ),
)
def plot_window_status(spark, sf):
    s = fx_stream(spark, sf)
    f = s.where("st = 'click'").select("k", "ts_ns", "seq")
    g = s.where("st = 'purchase'").select("k", "ts_ns", "seq", F.col("v").alias("x"), (F.pmod("seq", F.lit(100)) / F.lit(10.0)).alias("y"))
    d = jobs.plot_window_status(f, g, _plots(spark), ["k"], 6, 2 * DAY_NS, DAY_NS, 2, 5.0)
    return d.withColumn("win", F.col("win").cast("int"))


def _boards(spark, sf):
    """Grids of one board seen by a master camera and, shifted by one column, by two others."""
    g = fx_stream(spark, sf).groupBy(F.col("k").alias("label")).agg((F.max("v") / 4 + 5).alias("s"), F.min("v").alias("o"))

    def grid(cols, rows, c0, h):
        pts = []
        for r in range(rows):
            for c in range(cols):
                x, y = F.col("s") * (c + c0) + F.col("o") * 30 + 0.7 * r, F.col("s") * r + F.col("o") * 17
                u, v = (x, y) if h is None else gm.h_apply(F.array(*[F.lit(t) for t in h]), x, y)
                pts.append(F.struct(u.alias("x"), v.alias("y")))
        return F.array(*pts)

    a = [g.select(F.lit(s).alias("sensor"), "label", F.lit(4).alias("cols"), F.lit(3).alias("rows"), grid(4, 3, 1, h).alias("corners")) for s, h in (("vis", HV), ("nir", HN))]
    m = g.select("label", F.lit(5).alias("cols"), F.lit(3).alias("rows"), grid(5, 3, 0, None).alias("corners"))
    return a[0].unionByName(a[1]), m


@query(
    "homography_chain",
    "JOB-08 JN-08 JN-14 WIN-07 AGG-26 AGG-41",
    with_sql(
        "SELECT sensor, count(DISTINCT k) AS pairs, 0::BIGINT AS rejected, 'direct' AS selected, 'direct_median_lte_composed' AS reason, 0.0::DOUBLE AS direct_median FROM fx_stream, (SELECT unnest(['vis','nir']) AS sensor) GROUP BY sensor",
        "fx_stream",
    ),
)
def homography_chain(spark, sf):
    a, m = _boards(spark, sf)
    b = a.select("sensor", "label").join(m, "label")
    ident = a.select("sensor").distinct().withColumn("h", trajectory.identity(3))
    d = jobs.homography_to_master(a, b, "sensor", "label", (3, 3), 8.0, 6.0, 30.0, ident, hypotheses=48)["homography"]
    return d.select("sensor", "pairs", "rejected", "selected", "reason", F.round("direct_median", 3).alias("direct_median"))


@query(
    "calibration_package",
    "JOB-09 SET-01 WIN-04 SCL-21 SNK-06",
    with_sql(
        """SELECT block, sensor, status, n AS n_views_or_pairs, e AS rms_or_median_px, NULL::VARCHAR AS notes FROM (SELECT count(DISTINCT k) AS n FROM fx_stream), (SELECT unnest(['vis','nir']) AS sensor),
  (VALUES ('intrinsics', 'candidate_partial_subpixel', 2.4::DOUBLE), ('homography_to_rgb', 'target_plane_homography_candidate', 0.0::DOUBLE), ('stereo_to_rgb', 'physical_extrinsic_candidate', 2.4::DOUBLE)) t(block, status, e)""",
        "fx_stream",
    ),
)
def calibration_package(spark, sf):
    a, m = _boards(spark, sf)
    extra = lambda d, src, conf: d.select("*", F.lit(conf).alias("confidence"), F.lit(100.0).alias("area"), F.lit(1).alias("frame_index"), F.lit(src).alias("source"))
    c1 = extra(a, "scan", "subpixel")
    c2 = extra(m.withColumn("sensor", F.lit("rgb")), "refined", "model_strong")
    res = a.select("sensor").distinct().withColumn("rms_px", F.lit(2.4)).withColumn("median_px", F.lit(1.2))
    return jobs.calibration_package([c1, c2], res, res, {"vis": (3, 3), "nir": (3, 3)}, min_common=(3, 3), seed_px=8.0, final_px=6.0, max_hint_px=30.0, hypotheses=48).withColumn("rms_or_median_px", F.round("rms_or_median_px", 3))


@query(
    "slam_export_manifest",
    "JOB-10 FLT-02 FLT-03 SNK-03",
    with_sql("SELECT k::VARCHAR AS bag_id, CASE st WHEN 'click' THEN 'imu' ELSE 'cloud' END AS sensor, count(*) AS rows, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns FROM fx_stream WHERE st IN ('click','view') AND ts_ns BETWEEN 1704067200000000000+0 AND 1704067200000000000+2*864000000000000 GROUP BY k, st", "fx_stream"),
)
def slam_export_manifest(spark, sf):
    m = fx_stream(spark, sf).select(F.col("k").cast("string").alias("bag_id"), F.col("st").alias("topic"), "ts_ns", "seq")
    half = 10 * DAY_NS
    return jobs.slam_export(m, {"click": "imu", "view": "cloud"}, 1704067200000000000 + half, half)["manifest"]


@query(
    "frame_extraction_index",
    "JOB-11 WIN-01 FLT-05 JN-01 JN-12 SCL-24",
    with_sql(
        f"""SELECT f.seq, f.k, f.st AS sensor, f.idx AS frame_index, CASE WHEN dt<={DAY_NS} THEN x END AS x, round(dt/1e6::DOUBLE,4) AS gps_dt_ms, CASE WHEN dt<={DAY_NS} THEN plot_id END AS plot_id, f.st || '/' || lpad(f.idx::VARCHAR,6,'0') || '_' || f.ts_ns || '.png' AS image_path
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, st ORDER BY ts_ns, seq)-1 AS idx FROM fx_stream WHERE st IN ('click','view')) WHERE idx%4=0) f LEFT JOIN nr ON nr.seq=f.seq AND rn=1 LEFT JOIN pl ON x>x0 AND x<x0+18 AND y>y0 AND y<y0+4""",
        "fx_stream",
        PLOTS_SQL,
        """nr AS (SELECT l.seq, r.x, r.y, abs(l.ts_ns-r.ts_ns) AS dt, row_number() OVER (PARTITION BY l.seq ORDER BY abs(l.ts_ns-r.ts_ns), r.ts_ns, r.seq) AS rn
  FROM fx_stream l JOIN (SELECT *, v AS x, (seq%100)/10.0::DOUBLE AS y FROM fx_stream WHERE st='purchase') r ON l.k=r.k WHERE l.st IN ('click','view'))""",
    ),
)
def frame_extraction_index(spark, sf):
    s = fx_stream(spark, sf)
    m = s.where("st IN ('click', 'view')").select("k", "ts_ns", "seq", F.col("st").alias("sensor"))
    g = s.where("st = 'purchase'").select("k", "ts_ns", "seq", F.col("v").alias("x"), (F.pmod("seq", F.lit(100)) / F.lit(10.0)).alias("y"))
    d = jobs.frame_extraction_index(m, g, _plots(spark), ["k"], 4, DAY_NS, 5.0)
    return d.select("seq", "k", "sensor", "frame_index", "x", F.round("gps_dt_ms", 4).alias("gps_dt_ms"), "plot_id", "image_path")


@query("panel_evidence", "JOB-12 JN-02 SCL-26 AGG-25")
def panel_evidence(spark, sf):
    p = fx_points(spark, sf).select(F.expr("ts_ns div 86400000000000 div 365").alias("cloud"), F.struct("seq", "sub").alias("pid"), (F.col("x") / 50).alias("x"), (F.col("y") / 5).alias("y"), (1 + 0.01 * F.col("intensity") + F.when(F.col("tax") > 6, F.col("z") / 100).otherwise(0.0)).alias("z"), F.lit(0).alias("bag"))
    clouds = p.select("bag", "cloud").distinct().select("bag", "cloud", F.col("cloud").alias("seq"), (F.col("cloud") * 1_000_000_000).alias("ts_ns"))
    poses = clouds.select("bag", F.concat(F.lit("L"), F.col("cloud")).alias("label"), (F.col("ts_ns") + 90_000_000).alias("ts_ns"), "seq", *[F.lit(v).alias(n) for n, v in (("cx", 1.0), ("cy", 1.0), ("cz", 1.03), ("nx", 0.0), ("ny", 0.0), ("nz", 2.0))])
    d = jobs.panel_evidence(poses, clouds, p, ["bag"], "pid", hypotheses=24)
    return d.select("label", "points", "n", "detected", F.round(F.abs(F.get("normal", F.lit(2))), 4).alias("nz"), F.round("rms", 5).alias("rms"))


@query(
    "presentation_samples",
    "JOB-13 JN-05 JN-13 FLT-09",
    with_sql(
        f"""SELECT k, target, max(seq) FILTER (st='view') AS view_seq, max(seq) FILTER (st='click') AS click_seq, max(seq) FILTER (st='purchase') AS purchase_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY k, target, st ORDER BY dt, ts_ns, seq) AS r2 FROM near WHERE rn=1 AND dt<=CASE WHEN st='purchase' THEN {3 * DAY_NS} ELSE {DAY_NS} END) WHERE r2=1 GROUP BY k, target""",
        "fx_stream",
        """m AS (SELECT * FROM fx_stream WHERE st IN ('view','click','purchase')), b AS (SELECT k, min(ts_ns) AS s, max(ts_ns) AS e FROM m GROUP BY k),
t AS (SELECT k, (i-1)::INT AS target, s + (e-s)//4*i + ((e-s)%4*i)//4 AS t_ns FROM b, (SELECT unnest([1,2,3]) AS i)),
near AS (SELECT m.k, m.st, m.ts_ns, m.seq, t.target, abs(m.ts_ns-t.t_ns) AS dt, row_number() OVER (PARTITION BY m.seq ORDER BY abs(m.ts_ns-t.t_ns), t.t_ns) AS rn FROM m JOIN t ON m.k=t.k)""",
    ),
)
def presentation_samples(spark, sf):
    s = fx_stream(spark, sf).where("st IN ('view', 'click', 'purchase')")
    fix = F.col("st") == "purchase"
    m = s.select("k", F.col("st").alias("sensor"), "ts_ns", "seq", F.when(fix, F.col("v")).alias("x"), F.when(fix, F.pmod("seq", F.lit(100)) / F.lit(10.0)).alias("y"))
    d = jobs.presentation_samples(m, "purchase", _plots(spark), ["k"], 3, {"view": DAY_NS, "click": DAY_NS, "purchase": 3 * DAY_NS}, 5.0)
    return d.select("k", "target", "view_seq", "click_seq", "purchase_seq")


@query(
    "campaign_consolidation",
    "JOB-14 WIN-05 JN-17 AGG-33",
    with_sql(
        """SELECT sensor, count(*) AS n, count_if(used)::BIGINT AS kept_existing, count_if(used AND a IS NOT NULL)::BIGINT AS with_alternative FROM (SELECT sensor, a, b IS NOT NULL AND (a IS NULL OR b>a) AS used FROM (
  SELECT k, st AS sensor, max(CASE WHEN v>80 THEN 5e5::DOUBLE ELSE 0 END+v+0.1::DOUBLE*(seq%97)) AS a FROM fx_stream GROUP BY k, st) FULL JOIN (SELECT k, st AS sensor, max(v)*5000 AS b FROM fx_stream GROUP BY k, st) USING (k, sensor)) GROUP BY sensor""",
        "fx_stream",
    ),
)
def campaign_consolidation(spark, sf):
    s = fx_stream(spark, sf)
    a = s.select("k", F.col("st").alias("sensor"), F.when(F.col("v") > 80, "model_strong").otherwise("weak_reject").alias("confidence"), F.col("v").alias("score"), F.pmod("seq", F.lit(97)).alias("quality"), F.col("seq").alias("pos"), F.lit("new").alias("method"))
    e = s.groupBy("k", F.col("st").alias("sensor")).agg((F.max("v") * 5000).alias("score")).withColumn("method", F.lit("old"))
    return jobs.consolidate_campaign(a, e, ["k", "sensor"])["counts"]


# Sigma 3 with a reach of 12 cells and mirrored borders, by columns, then by rows.
SWEEP_SQL = """top AS (SELECT frame, r, c, greatest(v*1.0::DOUBLE, v*0.5::DOUBLE+20) AS v, (v>128)::INT AS g FROM fx_pixels),
q AS (SELECT frame, quantile_cont(v,0.08) AS lo, quantile_cont(v,0.97) AS hi, max(r)+1 AS nr, max(c)+1 AS nc FROM top GROUP BY frame),
k AS (SELECT i, exp(-0.5::DOUBLE*(i/3.0::DOUBLE)*(i/3.0::DOUBLE)) AS w FROM range(-12,13) t(i)), kn AS (SELECT i, w/(SELECT sum(w) FROM k) AS w FROM k),
ask AS (SELECT frame, r, c, w, CASE WHEN c+i<0 THEN -(c+i) WHEN c+i>=nc THEN 2*(nc-1)-(c+i) ELSE c+i END AS at FROM top JOIN q USING (frame), kn),
h AS (SELECT a.frame, a.r, a.c, sum(w*b.g) AS g FROM ask a JOIN top b ON b.frame=a.frame AND b.r=a.r AND b.c=a.at GROUP BY a.frame, a.r, a.c),
ask2 AS (SELECT frame, r, c, w, CASE WHEN r+i<0 THEN -(r+i) WHEN r+i>=nr THEN 2*(nr-1)-(r+i) ELSE r+i END AS at FROM top JOIN q USING (frame), kn),
veg AS (SELECT a.frame, a.r, a.c, sum(w*b.g) AS g FROM ask2 a JOIN h b ON b.frame=a.frame AND b.c=a.c AND b.r=a.at GROUP BY a.frame, a.r, a.c)"""


@query(
    "sweep_intensity_image",
    "JOB-15 AGG-11 AGG-16 SCL-20 RAS-03",
    with_sql("SELECT frame, r, c, round(pow(least(greatest((v-lo)/(CASE WHEN hi<=lo THEN 1.0::DOUBLE ELSE hi-lo END),0),1),0.75::DOUBLE)*(0.18::DOUBLE+0.82::DOUBLE*veg.g),6) AS value FROM top JOIN q USING (frame) JOIN veg USING (frame, r, c)", "fx_pixels", SWEEP_SQL),
)
def sweep_intensity_image(spark, sf):
    px = _dem_px(spark, sf)
    sweeps = px.select("frame", "r", "c", F.explode(F.array(F.col("v") * 1.0, F.col("v") * 0.5 + 20)).alias("intensity"))
    veg = px.select("frame", "r", "c", (F.col("v") > 128).cast("int").alias("veg"))
    return jobs.sweep_intensity(sweeps, veg, ["frame", "r", "c"]).withColumn("value", F.round("value", 6))
