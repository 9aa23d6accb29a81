"""Queries of the stream export: the given tables packed into messages, exported, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake.plans import exports
from sensorlake.plans.fixtures import DAY_NS, fx_points, fx_stream, with_sql
from sensorlake.plans.q_sources import _pack_clouds, _pack_imu
from sensorlake.plans.registry import query
from sensorlake.session import shared_folder

START_NS = 1_704_067_200_000_000_000
HALF_NS = 10 * DAY_NS
CLOUD_STEP_NS = 60_000_000_000

ROWS_SQL = f"""ro AS (SELECT 'imu' AS stream, k::VARCHAR AS bag_id, ts_ns, seq, seq%11=0 AS failed, CASE WHEN seq%11<>0 THEN round((v::FLOAT)::DOUBLE*9.80665::DOUBLE,8) END AS a, CASE WHEN seq%11<>0 THEN round(radians((v*-0.5::DOUBLE)::FLOAT::DOUBLE),6) END AS b FROM fx_stream
UNION ALL SELECT 'gnss', k::VARCHAR, ts_ns, seq, false, round(v,6), round(v+1,6) FROM fx_stream WHERE seq%4>0 AND seq%6<>0 AND seq%5<>0
UNION ALL SELECT 'velocity', k::VARCHAR, ts_ns, seq, st='error', CASE WHEN st<>'error' THEN round(sqrt(v*v+1+(seq%3)*(seq%3)),6) END, NULL FROM fx_stream
UNION ALL SELECT 'cloud', 'b', {START_NS}+frame*{CLOUD_STEP_NS}, row_number() OVER (PARTITION BY frame ORDER BY seq, sub, x, y, z, intensity)-1, false, round(x::FLOAT::DOUBLE,6), round(intensity::FLOAT::DOUBLE,6) FROM fx_points),
wi AS (SELECT * FROM ro WHERE ts_ns BETWEEN {START_NS} AND {START_NS + 2 * HALF_NS})"""


def _exported(spark, sf):
    s = fx_stream(spark, sf)
    nan, n, v = F.lit(float("nan")), F.col("seq"), F.col("v")
    key = F.col("k").cast("string").alias("bag_id")
    imu = s.select("k", "ts_ns", "seq", "v").mapInPandas(_pack_imu, "bag_id string, ts_ns bigint, seq bigint, raw binary")
    fixes = s.select(key, "ts_ns", "seq", (n % 4 - 1).alias("status"), F.when(n % 6 == 0, nan).otherwise(v).alias("lat"), (v + 1).alias("lon"), F.when(n % 5 == 0, nan).otherwise(v).alias("alt"))
    lin = F.struct(v.alias("x"), F.lit(1.0).alias("y"), F.pmod("seq", F.lit(3)).cast("double").alias("z"))
    vel = s.select(key, "ts_ns", "seq", F.when(F.col("st") != "error", F.struct(lin.alias("linear"))).alias("twist"))
    g = fx_points(spark, sf).groupBy((START_NS + F.col("frame") * CLOUD_STEP_NS).alias("frame"))
    g = g.agg(F.array_sort(F.collect_list(F.struct("seq", "sub", "x", "y", "z", "intensity"))).alias("pts"))  # a handful of points per order
    g = g.select("frame", *[F.col(f"pts.{f}").alias(f) for f in ("x", "y", "z", "intensity")])
    schema = "bag_id string, cloud_ts bigint, height int, width int, point_step int, fields array<struct<name:string,offset:int,datatype:int>>, data binary"
    streams = exports.typed_streams(imu, g.mapInPandas(_pack_clouds, schema), fixes, vel, START_NS + HALF_NS, HALF_NS)
    return exports.write_streams(streams, shared_folder(spark, "export"))


@query("slam_export_rows", "JOB-10 FLT-03 SRC-05 SRC-07 SRC-08 SRC-09 SNK-03 SNK-09", with_sql("SELECT * FROM wi", "fx_stream", "fx_points", ROWS_SQL))
def slam_export_rows(spark, sf):
    w = _exported(spark, sf)
    none = F.lit(None).cast("double")
    r6 = lambda c: F.round(F.col(c).cast("double"), 6)
    values = {"imu": (F.round("accel_x_mps2", 8), r6("gyro_y_radps")), "gnss": (r6("lat"), r6("lon")), "velocity": (r6("speed_mps"), none), "cloud": (r6("x"), r6("intensity"))}
    parts = [w[s].select(F.lit(s).alias("stream"), "bag_id", "ts_ns", "seq", "failed", a.alias("a"), b.alias("b")) for s, (a, b) in values.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "slam_export_summary",
    "JOB-10 SNK-05",
    with_sql("SELECT stream, bag_id, count(*) FILTER (NOT failed) AS rows, count(*) FILTER (failed) AS failed, min(ts_ns) FILTER (NOT failed) AS start_ns, max(ts_ns) FILTER (NOT failed) AS end_ns FROM wi GROUP BY stream, bag_id", "fx_stream", "fx_points", ROWS_SQL),
)
def slam_export_summary(spark, sf):
    return exports.stream_manifest(_exported(spark, sf))
