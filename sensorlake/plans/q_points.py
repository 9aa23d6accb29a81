"""Queries on points: cells, surfaces, buffers, fusion, blending."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake.functions.color import hsv, is_bright_pale
from sensorlake.operators import rasterize as rz
from sensorlake.plans.fixtures import fx_pixels, fx_points, with_sql
from sensorlake.plans.registry import query

TIE = ["seq", "sub"]


def cells_sql(res: float) -> str:
    return f"""meta AS (SELECT min(x)-{2 * res}::DOUBLE AS emin, max(x)+{2 * res}::DOUBLE AS emax, min(y)-{2 * res}::DOUBLE AS nmin, max(y)+{2 * res}::DOUBLE AS nmax FROM fx_points),
size AS (SELECT *, greatest(1, ceil((emax-emin)/{res}::DOUBLE)::INT) AS width, greatest(1, ceil((nmax-nmin)/{res}::DOUBLE)::INT) AS height FROM meta),
cells AS (SELECT p.*, least(greatest(trunc((nmax-y)/{res}::DOUBLE)::INT,0),height-1) AS row, least(greatest(trunc((x-emin)/{res}::DOUBLE)::INT,0),width-1) AS col FROM fx_points p, size)"""


def _cells(spark, sf, res):
    p = fx_points(spark, sf)
    return rz.with_cells(p, rz.raster_meta(p, res))


@query(
    "dsm_max_surface",
    "AGG-05 SCL-17",
    with_sql(
        """SELECT row, col, z, intensity, n FROM (SELECT *, count(*) OVER (PARTITION BY row, col) AS n,
  row_number() OVER (PARTITION BY row, col ORDER BY z DESC, seq DESC, sub DESC) AS rn FROM cells) WHERE rn=1""",
        "fx_points",
        cells_sql(0.5),
    ),
)
def dsm_max_surface(spark, sf):
    return rz.surface_max(_cells(spark, sf, 0.5), ["row", "col"], "z", TIE, ["intensity"])


@query(
    "dsm_p95_surface",
    "AGG-06 AGG-07",
    with_sql(
        """SELECT row, col, CASE WHEN n>=4 THEN pz ELSE mz END AS z, CASE WHEN n>=4 THEN pi ELSE mi END AS intensity, n FROM (
  SELECT row, col, count(*) AS n, arg_min(z, {'d': abs(z-q), 'z': z, 's': seq, 'b': sub}) AS pz, arg_min(intensity, {'d': abs(z-q), 'z': z, 's': seq, 'b': sub}) AS pi,
    arg_max(z, {'z': z, 's': seq, 'b': sub}) AS mz, arg_max(intensity, {'z': z, 's': seq, 'b': sub}) AS mi
  FROM cells JOIN (SELECT row, col, quantile_cont(z, 0.95) AS q FROM cells GROUP BY row, col) USING (row, col) GROUP BY row, col)""",
        "fx_points",
        cells_sql(0.2),
    ),
)
def dsm_p95_surface(spark, sf):
    return rz.surface_p95(_cells(spark, sf, 0.2), ["row", "col"], "z", TIE, ["intensity"])


@query("density_raster", "AGG-07", with_sql("SELECT row, col, count(*) AS n FROM cells GROUP BY row, col", "fx_points", cells_sql(1.0)))
def density_raster(spark, sf):
    return rz.surface_max(_cells(spark, sf, 1.0), ["row", "col"], "z", TIE, []).select("row", "col", "n")


@query(
    "highest_point_raster",
    "AGG-08",
    with_sql(
        """SELECT row, col, z, tax, price, intensity FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY z DESC, seq DESC, sub DESC) AS rn FROM cells) WHERE rn=1""",
        "fx_points",
        cells_sql(0.4),
    ),
)
def highest_point_raster(spark, sf):
    return rz.surface_max(_cells(spark, sf, 0.4), ["row", "col"], "z", TIE, ["tax", "price", "intensity"]).drop("n")


@query(
    "topdown_max_raster",
    "AGG-09 SCL-17",
    with_sql(
        "SELECT row, col, greatest(max(intensity-3),0) AS intensity, greatest(max(z-20),0) AS height, count(*) AS n, true AS support FROM (SELECT *, floor(y/0.5::DOUBLE)::INT AS row, floor(x/0.5::DOUBLE)::INT AS col FROM fx_points) GROUP BY row, col",
        "fx_points",
    ),
)
def topdown_max_raster(spark, sf):
    p = fx_points(spark, sf).select(
        F.floor(F.col("y") / 0.5).cast("int").alias("row"), F.floor(F.col("x") / 0.5).cast("int").alias("col"), (F.col("intensity") - 3).alias("intensity"), (F.col("z") - 20).alias("height")
    )
    return rz.topdown_max(p, ["row", "col"], "intensity", "height")


PIX = "px AS (SELECT *, trunc(x)::INT AS px, trunc(y)::INT AS py, (ts_ns//86400000000000//365)::BIGINT AS sweep FROM fx_points)"


def _pix(spark, sf):
    day = F.expr("ts_ns div 86400000000000 div 365")
    return fx_points(spark, sf).select("*", F.col("x").cast("int").alias("px"), F.col("y").cast("int").alias("py"), day.alias("sweep"))


@query(
    "zbuffer_nearest",
    "AGG-10",
    with_sql(
        "SELECT flag, px, py, price, z, intensity FROM (SELECT *, row_number() OVER (PARTITION BY flag, px, py ORDER BY price, seq, sub) AS rn FROM px) WHERE rn=1",
        "fx_points",
        PIX,
    ),
)
def zbuffer_nearest(spark, sf):
    return rz.zbuffer(_pix(spark, sf), ["flag", "px", "py"], "price", TIE, ["z", "intensity"])


@query(
    "multi_sweep_fusion",
    "AGG-11 AGG-10",
    with_sql(
        """SELECT px, py, min(price) AS price, max(z) AS z, max(intensity) AS intensity, bool_or(tax>4) AS support FROM (
  SELECT *, row_number() OVER (PARTITION BY sweep, px, py ORDER BY price, seq, sub) AS rn FROM px) WHERE rn=1 GROUP BY px, py""",
        "fx_points",
        PIX,
    ),
)
def multi_sweep_fusion(spark, sf):
    d = rz.zbuffer(_pix(spark, sf), ["sweep", "px", "py"], "price", TIE, ["z", "intensity", "tax"])
    return rz.fuse_sweeps(d.withColumn("seen", F.col("tax") > 4), ["px", "py"], "price", "z", "intensity", "seen")


@query(
    "best_view_painting",
    "AGG-12 SCL-18 FLT-15",
    with_sql(
        """SELECT row, col, round(score,6) AS score, frame, price FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY score DESC, frame, seq, sub) AS rn FROM (
  SELECT *, -(((u-50)/35.0::DOUBLE)*((u-50)/35.0::DOUBLE)+((v-40)/28.0::DOUBLE)*((v-40)/28.0::DOUBLE)) AS score
  FROM (SELECT *, z*2 AS u, tax*10 AS v FROM cells) WHERE u>=0 AND u<100 AND v>=0 AND v<80)) WHERE rn=1""",
        "fx_points",
        cells_sql(0.5),
    ),
)
def best_view_painting(spark, sf):
    d = _cells(spark, sf, 0.5).withColumn("u", F.col("z") * 2).withColumn("v", F.col("tax") * 10)
    d = d.where("u >= 0 AND u < 100 AND v >= 0 AND v < 80")
    d = d.withColumn("score", rz.centre_score(F.col("u"), F.col("v"), (0.0, 0.0, 100.0, 80.0)))
    return rz.best_view(d, ["row", "col"], "score", "frame", TIE, ["price"]).withColumn("score", F.round("score", 6))


@query(
    "weighted_blend",
    "AGG-13",
    with_sql(
        """SELECT row, col, round(sum(w*z)/greatest(sum(w),0.001::DOUBLE),6) AS z, round(sum(w*price)/greatest(sum(w),0.001::DOUBLE),4) AS price, round(sum(w),6) AS weight, sum(w)>0.05::DOUBLE AS valid
FROM (SELECT *, exp(-0.5::DOUBLE*((tax-4)/1.5::DOUBLE)*((tax-4)/1.5::DOUBLE)) AS w FROM cells) GROUP BY row, col""",
        "fx_points",
        cells_sql(0.2),
    ),
)
def weighted_blend(spark, sf):
    a = (F.col("tax") - 4) / F.lit(1.5)
    d = _cells(spark, sf, 0.2).withColumn("w", F.exp(F.lit(-0.5) * a * a))
    b = rz.weighted_blend(d, ["row", "col"], ["z", "price"], "w")
    return b.select("row", "col", F.round("z", 6).alias("z"), F.round("price", 4).alias("price"), F.round("weight", 6).alias("weight"), "valid")


@query("max_blend", "AGG-13", with_sql("SELECT row, col, max(z) AS z FROM cells WHERE tax>2 GROUP BY row, col", "fx_points", cells_sql(1.0)))
def max_blend(spark, sf):
    return rz.max_blend(_cells(spark, sf, 1.0).withColumn("ok", F.col("tax") > 2), ["row", "col"], ["z"], "ok")


@query(
    "colour_balance",
    "AGG-14",
    with_sql(
        """SELECT frame, r, c, trunc(least(greatest((v-m)*least(greatest(rs/greatest(s,1.0::DOUBLE),0.75::DOUBLE),1.35::DOUBLE)+rm,0),255))::INT AS v
FROM fx_pixels JOIN st USING (frame), (SELECT m AS rm, s AS rs FROM st WHERE frame=(SELECT frame FROM (SELECT frame, row_number() OVER (ORDER BY frame)-1 AS i, count(*) OVER () AS n FROM st) WHERE i=n//2))""",
        "fx_pixels",
        "st AS (SELECT frame, avg(v) AS m, stddev_pop(v) AS s FROM fx_pixels GROUP BY frame)",
    ),
)
def colour_balance(spark, sf):
    p = fx_pixels(spark, sf).select("frame", "r", "c", "v")
    return rz.balance_channels(p, "frame", ["v"], F.col("frame") == rz.middle_frame(p, "frame"))


@query(
    "voxel_first",
    "AGG-15",
    with_sql(
        """SELECT vx, vy, vz, seq, sub, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY seq, sub) AS rn FROM (
  SELECT *, floor(x/2.5::DOUBLE)::BIGINT AS vx, floor(y/2.5::DOUBLE)::BIGINT AS vy, floor(z/2.5::DOUBLE)::BIGINT AS vz FROM fx_points)) WHERE rn=1""",
        "fx_points",
    ),
)
def voxel_first(spark, sf):
    return rz.voxel_first(fx_points(spark, sf), [], ["x", "y", "z"], 2.5, TIE)


@query(
    "robust_stretch",
    "AGG-16",
    with_sql(
        """SELECT frame, r, c, trunc(least(greatest((v-lo)*255.0::DOUBLE/((CASE WHEN hi<=lo THEN lo+1 ELSE hi END)-lo),0),255))::INT AS u8
FROM fx_pixels JOIN (SELECT frame, quantile_cont(v::DOUBLE,0.01) AS lo, quantile_cont(v::DOUBLE,0.99) AS hi FROM fx_pixels GROUP BY frame) USING (frame)""",
        "fx_pixels",
    ),
)
def robust_stretch(spark, sf):
    return rz.robust_stretch(fx_pixels(spark, sf).select("frame", "r", "c", "v"), ["frame"], "v").select("frame", "r", "c", "u8")


@query(
    "zscore_stretch",
    "AGG-17",
    with_sql(
        """SELECT frame, r, c, round(z,6) AS z FROM z""",
        "fx_pixels",
        "z AS (SELECT frame, r, c, (v-m)/(s+1e-6::DOUBLE) AS z FROM fx_pixels JOIN (SELECT frame, avg(v) AS m, stddev_pop(v) AS s FROM fx_pixels GROUP BY frame) USING (frame))",
    ),
)
def zscore_stretch(spark, sf):
    p = fx_pixels(spark, sf).select("frame", "r", "c", "v")
    s = p.groupBy("frame").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return p.join(s, "frame").select("frame", "r", "c", F.round((F.col("v") - F.col("m")) / (F.col("s") + 1e-6), 6).alias("z"))


@query(
    "zscore_stretch_u8",
    "AGG-17",
    with_sql(
        """SELECT u8, count(*) AS n FROM (SELECT trunc(least(greatest((z-lo)*255.0::DOUBLE/((CASE WHEN hi<=lo THEN lo+1 ELSE hi END)-lo),0),255)+1e-9::DOUBLE)::INT//8 AS u8
  FROM z JOIN (SELECT frame, quantile_cont(z,0.005) AS lo, quantile_cont(z,0.995) AS hi FROM z GROUP BY frame) USING (frame)) GROUP BY u8""",
        "fx_pixels",
        "z AS (SELECT frame, r, c, (v-m)/(s+1e-6::DOUBLE) AS z FROM fx_pixels JOIN (SELECT frame, avg(v) AS m, stddev_pop(v) AS s FROM fx_pixels GROUP BY frame) USING (frame))",
    ),
)
def zscore_stretch_u8(spark, sf):
    d = rz.zscore_stretch(fx_pixels(spark, sf).select("frame", "r", "c", "v"), ["frame"], "v")
    return d.groupBy(F.expr("cast(u8 div 8 as int)").alias("u8")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "otsu_cover",
    "AGG-18 WIN-13",
    with_sql(
        """SELECT frame, threshold, round(avg((v>threshold)::INT)*100,2) AS veg_pct, round(avg((v<=threshold)::INT)*100,2) AS soil_pct FROM fx_pixels JOIN (
  SELECT frame, bin AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY b DESC, bin) AS rn FROM (
    SELECT frame, bin, CASE WHEN n>w0 THEN w0*(n-w0)*(s0/w0-(s-s0)/(n-w0))*(s0/w0-(s-s0)/(n-w0)) ELSE 0 END AS b FROM (
      SELECT frame, bin, sum(c) OVER w AS w0, sum(c*bin) OVER w AS s0, sum(c) OVER (PARTITION BY frame) AS n, sum(c*bin) OVER (PARTITION BY frame) AS s
      FROM (SELECT frame, v::BIGINT AS bin, count(*)::DOUBLE AS c FROM fx_pixels GROUP BY frame, v) WINDOW w AS (PARTITION BY frame ORDER BY bin)))) WHERE rn=1) USING (frame) GROUP BY frame, threshold""",
        "fx_pixels",
    ),
)
def otsu_cover(spark, sf):
    p = fx_pixels(spark, sf)
    t = rz.otsu(p, ["frame"], "v")
    d = p.join(t, "frame")
    return rz.cover(d, ["frame", "threshold"], {"veg_pct": F.col("v") > F.col("threshold"), "soil_pct": F.col("v") <= F.col("threshold")})


@query(
    "point_range_filter",
    "FLT-10 FLT-11",
    with_sql("SELECT seq, sub, x, y, z FROM fx_points WHERE sqrt(x*x+y*y+z*z)>0.5 AND sqrt(x*x+y*y+z*z)<40 AND abs(y)<2.2 AND x>-1.5 AND x<30", "fx_points"),
)
def point_range_filter(spark, sf):
    from sensorlake.operators.pointfilters import in_range, in_swath

    return in_swath(in_range(fx_points(spark, sf), 0.5, 40.0), max_range=30.0).select("seq", "sub", "x", "y", "z")


@query(
    "colour_rejection",
    "FLT-14 SCL-19",
    with_sql(
        """SELECT seq, sub, h, s, vv FROM (SELECT *, greatest(r,g,b) AS vv, CASE WHEN greatest(r,g,b)>0 THEN round_even(255*(greatest(r,g,b)-least(r,g,b))/greatest(r,g,b),0)::INT ELSE 0 END AS s,
  (round_even((CASE WHEN deg<0 THEN deg+360 ELSE deg END)/2,0)::INT)%180 AS h FROM (SELECT *, CASE WHEN greatest(r,g,b)=least(r,g,b) THEN 0::DOUBLE WHEN greatest(r,g,b)=r THEN 60::DOUBLE*(g-b)/(greatest(r,g,b)-least(r,g,b))
    WHEN greatest(r,g,b)=g THEN 120+60::DOUBLE*(b-r)/(greatest(r,g,b)-least(r,g,b)) ELSE 240+60::DOUBLE*(r-g)/(greatest(r,g,b)-least(r,g,b)) END AS deg FROM rgb)) WHERE NOT (vv>230 AND s<55)""",
        "fx_points",
        "rgb AS (SELECT seq, sub, (z*5)::INT AS r, (seq%256)::INT AS g, (sub%251)::INT AS b FROM fx_points)",
    ),
)
def colour_rejection(spark, sf):
    p = fx_points(spark, sf).select(
        "seq", "sub", (F.col("z") * 5).cast("int").alias("r"), F.pmod("seq", F.lit(256)).cast("int").alias("g"), F.pmod("sub", F.lit(251)).cast("int").alias("b")
    )
    p = p.withColumn("hsv", hsv(F.col("r"), F.col("g"), F.col("b"))).where(~is_bright_pale(F.col("hsv")))
    return p.select("seq", "sub", F.col("hsv.h").alias("h"), F.col("hsv.s").alias("s"), F.col("hsv.v").alias("vv"))


@query(
    "relative_height_cells",
    "RAS-07 AGG-05",
    with_sql(
        "SELECT row, col, round(z-q,6) AS height FROM m, (SELECT quantile_cont(z,0.05) AS q FROM m)",
        "fx_points",
        cells_sql(0.2),
        "m AS (SELECT row, col, max(z) AS z FROM cells GROUP BY row, col)",
    ),
)
def relative_height_cells(spark, sf):
    m = rz.surface_max(_cells(spark, sf, 0.2), ["row", "col"], "z", TIE, [])
    return rz.relative_height(m, "z").select("row", "col", F.round("height", 6).alias("height"))
