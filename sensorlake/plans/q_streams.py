"""Queries that drive the streaming operators over the event table as a file stream.

The ``stream_whole_*`` queries close the stream after its last row and return
all that the operators give; the others return what the watermark has passed
while more rows may follow, and of that the part that their SQL names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake.plans.fixtures import DAY_NS, HOUR_NS, _ns, table, with_sql
from sensorlake.plans.registry import query
from sensorlake.streaming import twins
from sensorlake.streaming.run import run_available, run_whole

DELAY_NS = HOUR_NS


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return s.select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.col("event_type").alias("st"), _ns("ts").alias("ts_ns"), F.col("value").alias("v"))


#: More than the delay, the window and both tolerances together.
HORIZON_NS = 2 * DAY_NS


def _last_ns(spark, sf):
    return table(spark, sf, "events").agg(F.max(_ns("ts"))).first()[0]


MARK = f"mk AS (SELECT (max(ts_ns)-{DELAY_NS})//1000000 AS wm FROM fx_stream)"


@query(
    "stream_rate_monitor",
    "ST-3 AGG-01",
    with_sql(
        """SELECT w*21600 AS start_s, st, count(*) AS n, round((count(*)-1)/((max(ts_ns)-min(ts_ns))/1e9::DOUBLE),6) AS rate_hz, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std
FROM (SELECT *, ts_ns//21600000000000 AS w FROM fx_stream) WHERE (w+1)*21600000<=(SELECT wm FROM mk) GROUP BY w, st HAVING max(ts_ns)>min(ts_ns)""",
        "fx_stream",
        MARK,
    ),
)
def stream_rate_monitor(spark, sf):
    d = run_available(twins.rate_monitor(_stream(spark, sf), ["st"], "v", "6 hours", "1 hour"))
    return d.where("rate_hz IS NOT NULL").select(F.unix_seconds("start").alias("start_s"), "st", "n", *[F.round(c, 6).alias(c) for c in ("rate_hz", "mean", "std")])


@query(
    "stream_nearest_join",
    "ST-2 JN-01",
    with_sql(
        f"""SELECT seq, k, dt AS dt_ns, r_seq FROM (SELECT l.seq, l.k, abs(l.ts_ns-r.ts_ns) AS dt, r.seq AS r_seq, row_number() OVER (PARTITION BY l.seq ORDER BY abs(l.ts_ns-r.ts_ns), r.ts_ns, r.seq) AS rn
  FROM fx_stream l JOIN fx_stream r ON l.k=r.k AND r.st='purchase' AND abs(l.ts_ns-r.ts_ns)<={HOUR_NS} WHERE l.st='click' AND (l.ts_ns//1000000)<(SELECT wm FROM mk)-{2 * DELAY_NS // 1000000}) WHERE rn=1""",
        "fx_stream",
        MARK,
    ),
)
def stream_nearest_join(spark, sf):
    s = _stream(spark, sf)
    left, right = s.where("st = 'click'"), s.where("st = 'purchase'")
    d = run_available(twins.nearest_stream_join(left, right, "k", "1 HOUR", HOUR_NS, "1 hour"))
    ev = table(spark, sf, "events").agg(F.max(_ns("ts")).alias("m")).select(F.expr(f"(m - {DELAY_NS}) div 1000000 - {2 * DELAY_NS // 1000000}"))
    return d.where(F.col("dt_ns").isNotNull() & (F.expr("ts_ns div 1000000") < ev.scalar())).select("seq", "k", "dt_ns", "r_seq")


@query(
    "stream_index_and_best",
    "ST-1 WIN-01 WIN-02",
    with_sql(
        "SELECT k::VARCHAR AS bag, st AS sensor, seq, row_number() OVER (PARTITION BY k, st ORDER BY ts_ns, seq)-1 AS idx, 'frame' AS kind FROM fx_stream WHERE ts_ns//1000000+1<=(SELECT wm FROM mk)",
        "fx_stream",
        MARK,
    ),
)
def stream_index_and_best(spark, sf):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, twins.ROCKSDB)
    try:
        s = _stream(spark, sf).select(F.col("k").cast("string").alias("bag"), F.col("st").alias("sensor"), "ts_ns", "seq", F.col("v").alias("quality"))
        d = run_available(twins.index_and_best(s, 3, "1 hour"))
    finally:
        spark.conf.set(name, before)
    return d.where("kind = 'frame'").select("bag", "sensor", "seq", "idx", "kind")


@query(
    "stream_whole_rate_monitor",
    "ST-3 AGG-01",
    with_sql(
        """SELECT w*21600 AS start_s, st, count(*) AS n, CASE WHEN max(ts_ns)>min(ts_ns) THEN round((count(*)-1)/((max(ts_ns)-min(ts_ns))/1e9::DOUBLE),6) END AS rate_hz, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std
FROM (SELECT *, ts_ns//21600000000000 AS w FROM fx_stream) GROUP BY w, st""",
        "fx_stream",
    ),
)
def stream_whole_rate_monitor(spark, sf):
    d = run_whole([_stream(spark, sf)], lambda s: twins.rate_monitor(s, ["st"], "v", "6 hours", "1 hour"), _last_ns(spark, sf), HORIZON_NS)
    return d.select(F.unix_seconds("start").alias("start_s"), "st", "n", *[F.round(c, 6).alias(c) for c in ("rate_hz", "mean", "std")])


@query(
    "stream_whole_nearest_join",
    "ST-2 JN-01",
    with_sql(
        f"""SELECT l.seq, l.k, h.dt AS dt_ns, h.r_seq FROM (SELECT * FROM fx_stream WHERE st='click') l LEFT JOIN
  (SELECT l.seq, abs(l.ts_ns-r.ts_ns) AS dt, r.seq AS r_seq, row_number() OVER (PARTITION BY l.seq ORDER BY abs(l.ts_ns-r.ts_ns), r.ts_ns, r.seq) AS rn
  FROM fx_stream l JOIN fx_stream r ON l.k=r.k AND r.st='purchase' AND abs(l.ts_ns-r.ts_ns)<={HOUR_NS} WHERE l.st='click') h ON h.seq=l.seq AND h.rn=1""",
        "fx_stream",
    ),
)
def stream_whole_nearest_join(spark, sf):
    s = _stream(spark, sf)
    d = run_whole([s.where("st = 'click'"), s.where("st = 'purchase'")], lambda a, b: twins.nearest_stream_join(a, b, "k", "1 HOUR", HOUR_NS, "1 hour"), _last_ns(spark, sf), HORIZON_NS)
    return d.select("seq", "k", "dt_ns", "r_seq")


@query(
    "stream_whole_index_and_best",
    "ST-1 WIN-01 WIN-02",
    with_sql(
        """SELECT bag, sensor, seq, idx, 'frame' AS kind FROM ranked
UNION ALL SELECT bag, sensor, seq, n AS idx, 'best_' || best AS kind FROM (SELECT *, row_number() OVER (PARTITION BY bag, sensor ORDER BY v DESC, idx) AS best, count(*) OVER (PARTITION BY bag, sensor) AS n FROM ranked) WHERE best<=3""",
        "fx_stream",
        "ranked AS (SELECT k::VARCHAR AS bag, st AS sensor, seq, v, row_number() OVER (PARTITION BY k, st ORDER BY ts_ns, seq)-1 AS idx FROM fx_stream)",
    ),
)
def stream_whole_index_and_best(spark, sf):
    """Every frame with its index, and the last list of best frames per key."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, twins.ROCKSDB)
    try:
        s = _stream(spark, sf).select(F.col("k").cast("string").alias("bag"), F.col("st").alias("sensor"), "ts_ns", "seq", F.col("v").alias("quality"))
        d = run_whole([s], lambda x: twins.index_and_best(x, 3, "1 hour"), _last_ns(spark, sf), HORIZON_NS)
    finally:
        spark.conf.set(name, before)
    best = d.where("kind <> 'frame'")
    last = best.groupBy("bag", "sensor").agg(F.max("idx").alias("idx"))
    return d.where("kind = 'frame'").unionByName(best.join(last, ["bag", "sensor", "idx"])).select("bag", "sensor", "seq", "idx", "kind")
