"""Queries of the multisensor frame sets: sync, crop, LiDAR layers and soil cover over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sensorlake.plans import framesets
from sensorlake.plans.fixtures import fx_pixels, fx_points, with_sql
from sensorlake.plans.registry import query
from sensorlake.session import cut_lineage

TOLERANCE_NS = 120_000_000
HOMOGRAPHIES = {
    "vis": (1.02, 0.01, 2.0, -0.01, 0.98, 1.0, 0.0001, 0.0002, 1.0),
    "nir": (0.97, -0.02, -1.0, 0.02, 1.01, 3.0, 0.0, 0.0001, 1.0),
    "thermal": (1.0, 0.0, -1.5, 0.0, 1.05, -2.0, 0.0, 0.0, 1.0),
}
LENS, DIST = (40.0, 40.0, 32.0, 32.0), (-0.05, 0.01, 0.001, -0.001, 0.0)
ROTATION, SHIFT = (0.0, -1.0, 0.0, 0.0, 0.0, -1.0, 1.0, 0.0, 0.0), (0.1, -0.05, 0.2)
MARGIN, TRIM, SPLAT, MAX_RANGE, MIN_SIDE = 1, 2, 3, 8.0, 24
CLOUDS = 8


def _frame_set_inputs(spark, sf):
    """Master frames per second of two recordings; a camera at double rate, one with a tie, one that is late now and then."""
    px = fx_pixels(spark, sf).select(F.pmod("frame", F.lit(2)).alias("k"), "frame", "r", "c", "v")
    f = cut_lineage(px.select("k", "frame").distinct()).withColumn("ts_ns", F.col("frame") * 1_000_000_000)
    master = f.select("k", "frame", "ts_ns", F.col("frame").alias("seq"))

    def stream(name, own, dt):
        return f.select("k", F.lit(name).alias("st"), own.alias("frame"), (F.col("ts_ns") + dt).alias("ts_ns"), own.alias("seq"))

    n = F.col("frame")
    late = F.when(F.pmod(n, F.lit(5)) == 3, F.lit(200_000_000)).otherwise(F.lit(10_000_000))
    p = fx_points(spark, sf).select("seq", "sub", F.pmod("frame", F.lit(CLOUDS)).alias("frame"), (F.col("x") / 10.0 + 0.5).alias("x"), ((F.col("y") - 5.0) * 0.6).alias("y"), ((F.col("z") - 25.0) / 10.0).alias("z"), "intensity")
    p = p.withColumn("k", F.pmod("frame", F.lit(2)))
    clouds = cut_lineage(p.select("k", "frame").distinct()).select("k", F.lit("cloud").alias("st"), "frame", (F.col("frame") * 1_000_000_000 + 60_000_000).alias("ts_ns"), F.col("frame").alias("seq"))
    messages = (
        stream("vis", 2 * n, F.lit(-30_000_000)).unionByName(stream("vis", 2 * n + 1, F.lit(50_000_000)))
        .unionByName(stream("nir", 2 * n, F.lit(-40_000_000))).unionByName(stream("nir", 2 * n + 1, F.lit(40_000_000)))
        .unionByName(stream("thermal", n, late)).unionByName(clouds)
    )

    def camera(own, v):
        return px.select("k", own.alias("frame"), "r", "c", v.cast("double").alias("v"))

    v = F.col("v")
    pixels = {
        "vis": camera(2 * n, v).unionByName(camera(2 * n + 1, 255 - v)),
        "nir": camera(2 * n, v * 0.5).unionByName(camera(2 * n + 1, v)),
        "thermal": camera(n, 10 + v / F.lit(10.0)),
    }
    leaf = F.pmod(F.floor(F.col("r") / 16) + F.floor(F.col("c") / 16) + n, F.lit(2))
    rgb = px.select("k", "frame", "r", "c", v.alias("red"), F.least(F.lit(255), v + 80 * leaf).cast("int").alias("green"), F.floor(v / 2).cast("int").alias("blue"))
    return master, messages, rgb, pixels, p


def _frame_sets(spark, sf):
    master, messages, rgb, pixels, points = _frame_set_inputs(spark, sf)
    return framesets.multisensor_frame_sets(master, messages, rgb, pixels, points, ["k"], HOMOGRAPHIES, TOLERANCE_NS, ["seq", "sub"], LENS, DIST, ROTATION, SHIFT, MARGIN, TRIM, MIN_SIDE, MIN_SIDE, SPLAT, MAX_RANGE)


def _warped(name: str, source: str) -> str:
    a = np.linalg.inv(np.array(HOMOGRAPHIES[name]).reshape(3, 3))
    a = [float(x) for x in (a / a[2, 2]).ravel()]
    at = lambda i: f"({a[i]!r}::DOUBLE*c+{a[i + 1]!r}::DOUBLE*r+{a[i + 2]!r}::DOUBLE)"
    return f"""{name} AS (SELECT frame, r, c, sum(w*v) AS {name} FROM (SELECT t.frame, t.r, t.c, s.v, (CASE WHEN j=1 THEN a ELSE 1-a END)*(CASE WHEN i=1 THEN b ELSE 1-b END) AS w, j=(a>=0.5)::INT AND i=(b>=0.5)::INT AS near
  FROM (SELECT *, u-floor(u) AS a, w0-floor(w0) AS b FROM (SELECT frame, {name} AS own, r, c, {at(0)}/{at(6)} AS u, {at(3)}/{at(6)} AS w0 FROM sy JOIN rgb USING (frame) WHERE synced)) t,
  (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j), ({source}) s WHERE s.own=t.own AND s.r=floor(w0)::INT+i AND s.c=floor(u)::INT+j) GROUP BY frame, r, c HAVING bool_or(near))"""


def _window(value: str, fn: str, k: int, source: str, name: str) -> str:
    """Square window over dense cells: along the row, then along the column."""
    span = f"RANGE BETWEEN {k // 2} PRECEDING AND {k // 2} FOLLOWING"
    return f"""{name} AS (SELECT frame, r, c, {fn}(m) OVER (PARTITION BY frame, c ORDER BY r {span}) AS {value} FROM (
  SELECT frame, r, c, {fn}({value}) OVER (PARTITION BY frame, r ORDER BY c {span}) AS m FROM {source}))"""


CX, CY, CZ = "(-y+0.1::DOUBLE)", "(-z-0.05::DOUBLE)", "(x+0.2::DOUBLE)"
PARTS = [
    "fx_pixels",
    "fx_points",
    "rgb AS (SELECT frame, r, c, v AS red, least(255, v+80*((r//16+c//16+frame)%2))::INT AS green, (v//2)::INT AS blue FROM fx_pixels)",
    "f AS (SELECT DISTINCT frame, frame%2 AS k, frame*1000000000 AS ts FROM fx_pixels)",
    """ms AS (SELECT k, 'vis' AS st, 2*frame AS own, ts-30000000 AS ts FROM f UNION ALL SELECT k, 'vis', 2*frame+1, ts+50000000 FROM f
  UNION ALL SELECT k, 'nir', 2*frame, ts-40000000 FROM f UNION ALL SELECT k, 'nir', 2*frame+1, ts+40000000 FROM f
  UNION ALL SELECT k, 'thermal', frame, ts+CASE WHEN frame%5=3 THEN 200000000 ELSE 10000000 END FROM f
  UNION ALL SELECT DISTINCT (frame%8)%2, 'cloud', frame%8, (frame%8)*1000000000+60000000 FROM fx_points)""",
    """sy AS MATERIALIZED (SELECT *, vis IS NOT NULL AND nir IS NOT NULL AND thermal IS NOT NULL AS synced FROM (
  SELECT frame, max(own) FILTER (st='vis') AS vis, max(own) FILTER (st='nir') AS nir, max(own) FILTER (st='thermal') AS thermal, max(own) FILTER (st='cloud') AS cloud FROM f LEFT JOIN (
    SELECT f.frame, st, own FROM f JOIN ms USING (k) WHERE true QUALIFY row_number() OVER (PARTITION BY f.frame, st ORDER BY abs(ms.ts-f.ts), ms.ts, own)=1 AND abs(ms.ts-f.ts)<=120000000) USING (frame) GROUP BY frame))""",
    _warped("vis", "SELECT 2*frame AS own, r, c, v::DOUBLE AS v FROM fx_pixels UNION ALL SELECT 2*frame+1, r, c, 255-v FROM fx_pixels"),
    _warped("nir", "SELECT 2*frame AS own, r, c, v*0.5::DOUBLE AS v FROM fx_pixels UNION ALL SELECT 2*frame+1, r, c, v FROM fx_pixels"),
    _warped("thermal", "SELECT frame AS own, r, c, 10+v/10.0::DOUBLE AS v FROM fx_pixels"),
    """wide AS MATERIALIZED (SELECT rgb.*, vis.vis, nir.nir, thermal.thermal, (vis.vis IS NOT NULL AND nir.nir IS NOT NULL AND thermal.thermal IS NOT NULL)::INT AS ok FROM rgb JOIN sy USING (frame)
  LEFT JOIN vis USING (frame, r, c) LEFT JOIN nir USING (frame, r, c) LEFT JOIN thermal USING (frame, r, c) WHERE synced)""",
    _window("ok", "min", 2 * MARGIN + 1, "wide", "safe"),
    "ru AS MATERIALIZED (SELECT frame, r, c, r-row_number() OVER (PARTITION BY frame, c ORDER BY r) AS run FROM safe WHERE ok=1)",
    "hs AS (SELECT frame, r, c, row_number() OVER (PARTITION BY frame, c, run ORDER BY r) AS h FROM ru)",
    f"""bx AS (SELECT frame, x0, y0, x1, least(y1, greatest(y0+32, y1-{TRIM}))::INT AS y1 FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY (x1-x0)*(y1-y0) DESC, y0, x0, x1, y1) AS rn FROM (
  SELECT frame, y0, y1, min(c)::INT AS x0, (max(c)+1)::INT AS x1 FROM (SELECT *, c-row_number() OVER (PARTITION BY frame, y0, y1 ORDER BY c) AS run FROM (
    SELECT frame, c, (r+1-k)::INT AS y0, (r+1)::INT AS y1 FROM hs, range(1,65) t(k) WHERE k<=h)) GROUP BY frame, y0, y1, run)) WHERE rn=1)""",
    f"""st AS MATERIALIZED (SELECT sy.frame, vis, nir, thermal, cloud, x0, y0, x1, y1, CASE WHEN NOT synced THEN 'no_sync' WHEN x0 IS NULL THEN 'no_common_intersection' WHEN x1-x0<{MIN_SIDE} OR y1-y0<{MIN_SIDE} THEN 'common_intersection_too_small' ELSE 'ok' END AS status FROM sy LEFT JOIN bx ON bx.frame=sy.frame)""",
    "ce AS MATERIALIZED (SELECT wide.* FROM wide JOIN st USING (frame) WHERE status='ok' AND c>=x0 AND c<x1 AND r>=y0 AND r<y1)",
    "gl AS (SELECT frame, r, c, red, green, blue, trunc(least(greatest((CASE WHEN 2*green+red+blue>1e-6::DOUBLE THEN (2*green-red-blue)/(2*green+red+blue)::DOUBLE ELSE 0 END+1)*127.5::DOUBLE,0),255))::BIGINT AS g FROM ce)",
    """ot AS (SELECT frame, g AS threshold FROM (SELECT frame, g, row_number() OVER (PARTITION BY frame ORDER BY CASE WHEN n>w0 THEN w0*(n-w0)*(s0/w0-(s-s0)/(n-w0))*(s0/w0-(s-s0)/(n-w0)) ELSE 0 END DESC, g) AS rn FROM (
  SELECT frame, g, sum(n) OVER w AS w0, sum(n*g) OVER w AS s0, sum(n) OVER (PARTITION BY frame) AS n, sum(n*g) OVER (PARTITION BY frame) AS s FROM (SELECT frame, g, count(*)::DOUBLE AS n FROM gl GROUP BY frame, g) WINDOW w AS (PARTITION BY frame ORDER BY g))) WHERE rn=1)""",
    # the fixture's green is at least its red, and its red more than its blue
    """ve AS (SELECT frame, r, c, (g>threshold AND hue>25 AND hue<100 AND sat>25)::INT AS veg FROM (SELECT *, round_even((120+60.0::DOUBLE*(blue-red)/(green-blue))/2,0) AS hue, round_even(255.0::DOUBLE*(green-blue)/green,0) AS sat FROM gl) JOIN ot USING (frame))""",
    _window("veg", "min", 5, "ve", "v1"),
    _window("veg", "max", 5, "v1", "v2"),
    _window("veg", "max", 7, "v2", "v3"),
    _window("veg", "min", 7, "v3", "v4"),
    f"""pr AS (SELECT frame, seq, sub, x0, y0, x1, y1, px AS x, py AS y, -pz AS up, intensity, 1000*cz AS depth, cx/cz AS a, cy/cz AS b FROM (SELECT *, {CX.replace('y', 'py')} AS cx, {CY.replace('z', 'pz')} AS cy, {CZ.replace('x', 'px')} AS cz FROM (
  SELECT seq, sub, frame%8 AS cloud, x/10+0.5::DOUBLE AS px, (y-5)*0.6::DOUBLE AS py, (z-25)/10 AS pz, intensity FROM fx_points)) p JOIN st USING (cloud) WHERE status='ok' AND cz>0.05::DOUBLE AND sqrt(px*px+py*py+pz*pz)>0.35::DOUBLE AND sqrt(px*px+py*py+pz*pz)<{MAX_RANGE!r}::DOUBLE)""",
    f"""uv AS (SELECT *, 40*(a*rad+2*{DIST[2]!r}::DOUBLE*a*b+{DIST[3]!r}::DOUBLE*(r2+2*a*a))+32 AS u, 40*(b*rad+{DIST[2]!r}::DOUBLE*(r2+2*b*b)+2*{DIST[3]!r}::DOUBLE*a*b)+32 AS v FROM (
  SELECT *, 1+r2*({DIST[0]!r}::DOUBLE+r2*{DIST[1]!r}::DOUBLE) AS rad FROM (SELECT *, a*a+b*b AS r2 FROM pr)))""",
    """ins AS MATERIALIZED (SELECT * FROM (SELECT *, (x0+round_even(u-x0,0))::INT AS c, (y0+round_even(v-y0,0))::INT AS r FROM uv WHERE u>=x0 AND u<x1 AND v>=y0 AND v<y1) WHERE c<x1 AND r<y1)""",
    "lo AS (SELECT frame, quantile_cont(up,0.65) AS q, count(*) AS n FROM ins GROUP BY frame)",
    """pl AS (SELECT frame, avg(x) AS mx, avg(y) AS my, avg(up) AS mz, var_pop(x) AS xx, covar_pop(x,y) AS xy, var_pop(y) AS yy, covar_pop(x,up) AS xz, covar_pop(y,up) AS yz FROM ins JOIN lo USING (frame) WHERE up<=q GROUP BY frame)""",
    """hi AS (SELECT *, CASE WHEN n<20 THEN 0 ELSE greatest(rel-quantile_cont(rel,0.05) OVER (PARTITION BY frame),0) END AS height FROM (
  SELECT ins.*, n, up-((xz*yy-yz*xy)/(xx*yy-xy*xy)*(x-mx)+(yz*xx-xz*xy)/(xx*yy-xy*xy)*(y-my)+mz) AS rel FROM ins JOIN lo USING (frame) JOIN pl USING (frame)))""",
    "zb AS (SELECT frame, r, c, depth, height, intensity FROM hi QUALIFY row_number() OVER (PARTITION BY frame, r, c ORDER BY depth, seq, sub, height, intensity)=1)",
    """sp AS (SELECT frame, r+i AS r, c+j AS c, max(depth) AS depth, max(height) AS height, max(intensity) AS intensity FROM zb, (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j) GROUP BY 1, 2, 3)""",
]


@query(
    "multisensor_crops",
    "JOB-05 JN-04 AGG-34 AGG-35 AGG-36 AGG-18 RAS-02",
    with_sql(
        "SELECT st.*, vegetation_cover_pct, soil_visible_pct FROM st LEFT JOIN (SELECT frame, round(avg(veg)*100,2) AS vegetation_cover_pct, round(avg(1-veg)*100,2) AS soil_visible_pct FROM v4 GROUP BY frame) USING (frame)",
        *PARTS,
    ),
)
def multisensor_crops(spark, sf):
    d = _frame_sets(spark, sf)["sets"]
    return d.select("frame", "vis", "nir", "thermal", "cloud", "x0", "y0", "x1", "y1", "status", "vegetation_cover_pct", "soil_visible_pct")


@query(
    "multisensor_frame_cells",
    "JOB-05 JN-04 RAS-01 RAS-02 AGG-10 AGG-18 AGG-24 AGG-35 SCL-09",
    with_sql(
        """SELECT ce.frame, ce.r, ce.c, red, green, blue, round(vis,5) AS vis, round(nir,5) AS nir, round(thermal,5) AS thermal, round(depth,4) AS depth_mm, round(height,5) AS height, intensity, veg
FROM ce JOIN v4 USING (frame, r, c) LEFT JOIN sp USING (frame, r, c)""",
        *PARTS,
    ),
)
def multisensor_frame_cells(spark, sf):
    d = _frame_sets(spark, sf)["cells"]
    return d.select("frame", "r", "c", "red", "green", "blue", *[F.round(v, 5).alias(v) for v in ("vis", "nir", "thermal")], F.round("depth_mm", 4).alias("depth_mm"), F.round("height", 5).alias("height"), "intensity", "veg")
