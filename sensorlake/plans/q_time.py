"""Queries on time: as-of joins, sampling, windows, running work."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake.operators import asof, ordered, quantiles
from sensorlake.plans.fixtures import DAY_NS, HOUR_NS, fx_stream, with_sql
from sensorlake.plans.registry import query

NEAREST_SQL = """hits AS (
  SELECT l.*, r.ts_ns AS r_ts_ns, r.seq AS r_seq, r.v AS r_v, abs(l.ts_ns-r.ts_ns) AS dt,
    row_number() OVER (PARTITION BY l.seq ORDER BY abs(l.ts_ns-r.ts_ns), r.ts_ns, r.seq) AS rn
  FROM fx_stream l JOIN fx_stream r ON l.k=r.k AND r.st='purchase' WHERE l.st='click'),
best AS (SELECT * FROM hits WHERE rn=1)"""


def _clicks(spark, sf):
    s = fx_stream(spark, sf)
    return s.where("st = 'click'").select("seq", "k", "ts_ns"), s.where("st = 'purchase'").select("seq", "k", "ts_ns", "v")


@query(
    "asof_nearest_tolerance",
    "JN-01",
    with_sql(
        f"""SELECT c.seq, c.k, b.dt AS dt_ns, CASE WHEN b.dt<={DAY_NS} THEN b.r_seq END AS r_seq,
  CASE WHEN b.dt<={DAY_NS} THEN b.r_v END AS r_v
FROM fx_stream c LEFT JOIN best b ON c.seq=b.seq WHERE c.st='click'""",
        "fx_stream",
        NEAREST_SQL,
    ),
)
def asof_nearest_tolerance(spark, sf):
    left, right = _clicks(spark, sf)
    return asof.nearest_join(left, right, ["k"], DAY_NS, ["v"]).select("seq", "k", "dt_ns", "r_seq", "r_v")


@query(
    "asof_residual_stats",
    "JN-01 JN-03 AGG-19",
    with_sql(
        f"""SELECT k, count(*) AS n, round(avg(ms),6) AS mean_ms, round(median(ms),6) AS median_ms,
  round(quantile_cont(ms,0.9),6) AS p90_ms, max(ms) AS max_ms, round(sqrt(avg(ms*ms)),6) AS rms_ms
FROM (SELECT k, dt/1e6::DOUBLE AS ms FROM best WHERE dt<={HOUR_NS}) GROUP BY k""",
        "fx_stream",
        NEAREST_SQL,
    ),
)
def asof_residual_stats(spark, sf):
    from sensorlake.operators.robust import residual_metrics

    left, right = _clicks(spark, sf)
    near = asof.nearest_join(left, right, ["k"], HOUR_NS, how="inner")
    near = near.select("k", (F.col("dt_ns") / F.lit(1e6)).alias("ms"))
    m = residual_metrics(near, ["k"], "ms")
    return m.select(
        "k", "n", *[F.round(c, 6).alias(f"{c}_ms") for c in ("mean", "median", "p90")], F.col("max").alias("max_ms"), F.round("rms", 6).alias("rms_ms")
    )


@query(
    "pose_fix_association",
    "JN-03",
    with_sql(
        f"SELECT seq, k, r_seq, round(dt/1e6::DOUBLE,6) AS dt_ms FROM best WHERE dt<={6 * HOUR_NS}", "fx_stream", NEAREST_SQL
    ),
)
def pose_fix_association(spark, sf):
    left, right = _clicks(spark, sf)
    near = asof.nearest_join(left, right, ["k"], 6 * HOUR_NS, how="inner")
    return near.select("seq", "k", "r_seq", F.round(F.col("dt_ns") / F.lit(1e6), 6).alias("dt_ms"))


@query(
    "asof_without_tolerance",
    "JN-02",
    with_sql("SELECT c.seq, c.k, b.dt AS dt_ns, b.r_seq FROM fx_stream c LEFT JOIN best b ON c.seq=b.seq WHERE c.st='click'", "fx_stream", NEAREST_SQL),
)
def asof_without_tolerance(spark, sf):
    left, right = _clicks(spark, sf)
    return asof.nearest_join(left, right, ["k"]).select("seq", "k", "dt_ns", "r_seq")


@query(
    "multi_sensor_sync",
    "JN-04",
    with_sql(
        f"""SELECT seq, k, p.seq AS purchase_seq, v.seq AS view_seq, CASE WHEN e.dt<={DAY_NS} THEN e.seq END AS error_seq FROM near WHERE p.dt<={2 * DAY_NS} AND v.dt<={2 * DAY_NS}""",
        "fx_stream",
        """near AS (SELECT l.seq, l.k, min({'dt': abs(l.ts_ns-r.ts_ns), 'ts': r.ts_ns, 'seq': r.seq}) FILTER (r.st='purchase') AS p,
    min({'dt': abs(l.ts_ns-r.ts_ns), 'ts': r.ts_ns, 'seq': r.seq}) FILTER (r.st='view') AS v, min({'dt': abs(l.ts_ns-r.ts_ns), 'ts': r.ts_ns, 'seq': r.seq}) FILTER (r.st='error') AS e
  FROM fx_stream l JOIN fx_stream r ON l.k=r.k WHERE l.st='click' AND r.st IN ('purchase','view','error') GROUP BY l.seq, l.k)""",
    ),
)
def multi_sensor_sync(spark, sf):
    s = fx_stream(spark, sf)
    left = s.where("st = 'click'").select("seq", "k", "ts_ns")
    got = asof.nearest_per_stream(left, s, ["k"], {"purchase": 2 * DAY_NS, "view": 2 * DAY_NS, "error": DAY_NS}, "st")
    got = got.where(F.col("purchase.seq").isNotNull() & F.col("view.seq").isNotNull())
    return got.select("seq", "k", *[F.col(f"{n}.seq").alias(f"{n}_seq") for n in ("purchase", "view", "error")])


@query(
    "reverse_nearest_targets",
    "JN-05 FLT-09",
    with_sql(
        f"""SELECT k, target, st, arg.dt AS dt_ns, arg.ts AS ts_ns, arg.seq AS seq FROM (
  SELECT k, target, st, min({{'dt': dt, 'ts': ts_ns, 'seq': seq}}) AS arg FROM near
  WHERE rn=1 AND dt <= CASE WHEN st='view' THEN {3 * DAY_NS} ELSE {DAY_NS} END GROUP BY k, target, st)""",
        "fx_stream",
        """b AS (SELECT k, min(ts_ns) AS s, max(ts_ns) AS e FROM fx_stream GROUP BY k),
t AS (SELECT k, i-1 AS target, s + (e-s)//5*i + ((e-s)%5*i)//5 AS t_ns FROM b, (SELECT unnest([1,2,3,4]) AS i)),
near AS (SELECT m.k, m.st, m.ts_ns, m.seq, t.target, abs(m.ts_ns-t.t_ns) AS dt,
  row_number() OVER (PARTITION BY m.seq ORDER BY abs(m.ts_ns-t.t_ns), t.t_ns) AS rn
  FROM fx_stream m JOIN t ON m.k=t.k WHERE m.st IN ('view','click','purchase'))""",
    ),
)
def reverse_nearest_targets(spark, sf):
    from sensorlake.operators import sampling

    s = fx_stream(spark, sf)
    t = sampling.target_times(sampling.stream_bounds(s, ["k"]), 4)
    t = t.select("k", "target", "ts_ns", F.col("target").cast("bigint").alias("seq"))
    m = s.where("st IN ('view', 'click', 'purchase')").select("k", "st", "ts_ns", "seq")
    return asof.reverse_nearest(m, t, ["k"], "target", "st", {"view": 3 * DAY_NS, "click": DAY_NS, "purchase": DAY_NS})


@query(
    "interval_join_window",
    "JN-06 FLT-03",
    with_sql(
        f"""SELECT l.seq, l.k, r.seq AS r_seq, abs(l.ts_ns-r.ts_ns) AS dt_ns,
  row_number() OVER (PARTITION BY l.seq ORDER BY abs(l.ts_ns-r.ts_ns), r.ts_ns, r.seq) AS near_rank
FROM fx_stream l JOIN fx_stream r ON l.k=r.k AND abs(l.ts_ns-r.ts_ns)<={6 * HOUR_NS} WHERE l.st='purchase' AND r.st='click'""",
        "fx_stream",
    ),
)
def interval_join_window(spark, sf):
    from pyspark.sql.window import Window

    s = fx_stream(spark, sf)
    left = s.where("st = 'purchase'").select("seq", "k", "ts_ns")
    right = s.where("st = 'click'").select("seq", "k", "ts_ns")
    j = asof.within_interval(left, right, ["k"], 6 * HOUR_NS).withColumn("dt_ns", F.abs(F.col("ts_ns") - F.col("r_ts_ns")))
    w = Window.partitionBy("seq").orderBy("dt_ns", "r_ts_ns", "r_seq")
    return j.select("seq", "k", "r_seq", "dt_ns", F.row_number().over(w).cast("bigint").alias("near_rank"))


@query(
    "bracketed_slice",
    "JN-07",
    with_sql(
        """SELECT seq, s_seq, clip_ns FROM kept WHERE n >= 2""",
        "fx_stream",
        """iv AS (SELECT seq, k, ts_ns AS t0, lead(ts_ns) OVER (PARTITION BY k ORDER BY ts_ns, seq) AS t1 FROM fx_stream WHERE st='purchase'),
smp AS (SELECT seq AS s_seq, k, ts_ns, lag(ts_ns) OVER (PARTITION BY k ORDER BY ts_ns, seq) AS p, lead(ts_ns) OVER (PARTITION BY k ORDER BY ts_ns, seq) AS n
  FROM fx_stream WHERE st='click'),
hit AS (SELECT iv.seq, s.s_seq, s.ts_ns, least(greatest(s.ts_ns, t0), t1) AS clip_ns FROM iv JOIN smp s ON iv.k=s.k
  WHERE t1 IS NOT NULL AND coalesce(s.n, 9000000000000000000) >= t0 AND coalesce(s.p, 0) <= t1),
gap AS (SELECT *, clip_ns - lag(clip_ns) OVER (PARTITION BY seq ORDER BY ts_ns, s_seq) AS g FROM hit),
kept AS (SELECT *, count(*) OVER (PARTITION BY seq) AS n FROM gap WHERE g IS NULL OR g > 100)""",
    ),
)
def bracketed_slice(spark, sf):
    s = fx_stream(spark, sf)
    iv = ordered.previous_row(s.where("st = 'purchase'").select("seq", "k", "ts_ns"), ["k"], ["ts_ns", "seq"], {"ts_ns": "t1_ns"}, forward=True)
    iv = iv.where("t1_ns IS NOT NULL").select("k", F.col("seq").alias("iv"), F.col("ts_ns").alias("t0_ns"), "t1_ns")
    smp = s.where("st = 'click'").select("k", "seq", "ts_ns")
    got = asof.bracketed_slice(iv, smp, ["k"], "iv", [], bucket_ns=DAY_NS)
    return got.select(F.col("iv").alias("seq"), F.col("seq").alias("s_seq"), "clip_ns")


IDX = "ix AS (SELECT *, row_number() OVER (PARTITION BY k, st ORDER BY ts_ns, seq)-1 AS idx, count(*) OVER (PARTITION BY k, st) AS n FROM fx_stream)"
KEY = ["k", "st"]
ORDER = ["ts_ns", "seq"]


def _slim(spark, sf):
    return fx_stream(spark, sf).select("seq", "k", "st", "ts_ns")


@query("frame_index_sampling", "WIN-01 FLT-05", with_sql("SELECT seq, k, st, idx FROM ix WHERE idx % 5 = 0", "fx_stream", IDX))
def frame_index_sampling(spark, sf):
    from sensorlake.operators import sampling

    return sampling.every_nth(_slim(spark, sf), KEY, ORDER, 5).select("seq", "k", "st", "idx")


@query("running_frame_index", "WIN-01", with_sql("SELECT seq, k, st, idx, n AS frames FROM ix", "fx_stream", IDX))
def running_frame_index(spark, sf):
    return ordered.running_index(_slim(spark, sf), KEY, ORDER, "idx", "frames").select("seq", "k", "st", "idx", "frames")


@query(
    "evenly_spaced_sample",
    "FLT-06",
    with_sql(
        "SELECT seq, k, st, idx FROM ix WHERE n<=6 OR list_contains([CASE WHEN i=5 THEN n-1 ELSE floor((n-1)::DOUBLE/5::DOUBLE*i)::BIGINT END for i in [0,1,2,3,4,5]], idx)",
        "fx_stream",
        IDX,
    ),
)
def evenly_spaced_sample(spark, sf):
    from sensorlake.operators import sampling

    return sampling.evenly_spaced(_slim(spark, sf), KEY, ORDER, 6).select("seq", "k", "st", "idx")


@query(
    "inner_even_sample",
    "FLT-06",
    with_sql(
        "SELECT seq, k, st, idx FROM ix WHERE n<=4 OR list_contains([floor((n-1)::DOUBLE/5::DOUBLE*i)::BIGINT for i in [1,2,3,4]], idx)",
        "fx_stream",
        IDX,
    ),
)
def inner_even_sample(spark, sf):
    from sensorlake.operators import sampling

    return sampling.evenly_spaced(_slim(spark, sf), KEY, ORDER, 4, drop_ends=True).select("seq", "k", "st", "idx")


@query(
    "centre_out_sample",
    "FLT-07",
    with_sql(
        """SELECT seq, k, st, idx FROM (SELECT *, list_filter([n//2, n//2-1, n//2+1, n//2-2, n//2+2, 0, n-1], lambda i: i>=0 AND i<n) AS w FROM ix)
WHERE list_position(w, idx) IS NOT NULL AND len(list_distinct(w[1:list_position(w, idx)])) <= 5""",
        "fx_stream",
        IDX,
    ),
)
def centre_out_sample(spark, sf):
    from sensorlake.operators import sampling

    return sampling.centre_out(_slim(spark, sf), KEY, ORDER, 5).select("seq", "k", "st", "idx")


@query(
    "middle_window_sample",
    "FLT-08",
    with_sql("SELECT seq, k, st, idx FROM ix WHERE n<=7 OR (idx >= greatest(n//2-3,0) AND idx < greatest(n//2-3,0)+7)", "fx_stream", IDX),
)
def middle_window_sample(spark, sf):
    from sensorlake.operators import sampling

    return sampling.middle_window(_slim(spark, sf), KEY, ORDER, 7).select("seq", "k", "st", "idx")


@query(
    "middle_stride_sample",
    "FLT-08",
    with_sql(
        "SELECT seq, k, st, idx FROM (SELECT *, greatest(n//2-2*3,0) AS s FROM ix) WHERE idx>=s AND idx<s+5*3 AND (idx-s)%3=0", "fx_stream", IDX
    ),
)
def middle_stride_sample(spark, sf):
    from sensorlake.operators import sampling

    return sampling.middle_window(_slim(spark, sf), KEY, ORDER, 5, 3).select("seq", "k", "st", "idx")


@query(
    "target_times",
    "FLT-09 SRC-17",
    with_sql(
        "SELECT k, s AS start_ns, e AS end_ns, i-1 AS target, s + (e-s)//6*i + ((e-s)%6*i)//6 AS ts_ns FROM b, (SELECT unnest([1,2,3,4,5]) AS i)",
        "fx_stream",
        "b AS (SELECT k, min(ts_ns) AS s, max(ts_ns) AS e FROM fx_stream GROUP BY k)",
    ),
)
def target_times(spark, sf):
    from sensorlake.operators import sampling

    return sampling.target_times(sampling.stream_bounds(fx_stream(spark, sf), ["k"]), 5)


@query(
    "window_ladder",
    "FLT-04",
    with_sql(
        f"""SELECT seq, k, st, half AS half_ns, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY k, st ORDER BY d, ts_ns, seq) AS rank FROM h WHERE half IS NULL OR d<=half) WHERE rank<=3""",
        "fx_stream",
        f"""m AS (SELECT k, (min(ts_ns)+max(ts_ns))//2 AS mid FROM fx_stream GROUP BY k),
d AS (SELECT f.*, abs(f.ts_ns-mid) AS d FROM fx_stream f JOIN m USING (k)),
need AS (SELECT k, max(d) AS need FROM (SELECT k, st, min(d) AS d FROM d GROUP BY k, st) GROUP BY k),
h AS (SELECT d.*, CASE WHEN need<={12 * HOUR_NS} THEN {12 * HOUR_NS} WHEN need<={DAY_NS} THEN {DAY_NS} WHEN need<={2 * DAY_NS} THEN {2 * DAY_NS} END AS half
  FROM d JOIN need USING (k))""",
    ),
)
def window_ladder(spark, sf):
    from sensorlake.operators import sampling

    got = sampling.window_ladder(_slim(spark, sf), "k", "st", 3, (12 * HOUR_NS, DAY_NS, 2 * DAY_NS))
    return got.select("seq", "k", "st", "half_ns", F.col("rank").cast("bigint").alias("rank"))


@query(
    "topn_quality_frames",
    "WIN-02",
    with_sql(
        "SELECT k, st, seq, v, rank FROM (SELECT *, row_number() OVER (PARTITION BY k, st ORDER BY v DESC, ts_ns, seq) AS rank FROM fx_stream) WHERE rank<=3",
        "fx_stream",
    ),
)
def topn_quality_frames(spark, sf):
    from sensorlake.operators import sampling

    d = sampling.top_quality(fx_stream(spark, sf), KEY, "v", ORDER, 3)
    return d.select("k", "st", "seq", "v", F.col("rank").cast("bigint").alias("rank"))


@query(
    "stream_stats",
    "AGG-01 SRC-17",
    with_sql(
        """SELECT st, count(*) AS n, round((max(ts_ns)-min(ts_ns))/1e9::DOUBLE,6) AS duration_s, round(1/avg(dt),6) AS mean_hz,
  round(1/median(dt),6) AS median_hz, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std
FROM (SELECT *, (ts_ns-lag(ts_ns) OVER (PARTITION BY st ORDER BY ts_ns, seq))/1e9::DOUBLE AS dt FROM fx_stream) GROUP BY st""",
        "fx_stream",
    ),
)
def stream_stats(spark, sf):
    from sensorlake.operators import sampling

    d = sampling.stream_statistics(fx_stream(spark, sf), ["st"], "v")
    return d.select("st", "n", *[F.round(c, 6).alias(c) for c in ("duration_s", "mean_hz", "median_hz", "mean", "std")])


@query(
    "consecutive_deltas",
    "WIN-08",
    with_sql(
        """SELECT seq, k, round(dt,6) AS dt_s, round(coalesce((v+pv)/2, v, pv),6) AS mean_speed, CASE WHEN dt IS NOT NULL THEN round(least(greatest((v+pv)/2*dt*1e-5::DOUBLE,0),1.2::DOUBLE),6) END AS step
FROM (SELECT *, (ts_ns-lag(ts_ns) OVER w)/1e9::DOUBLE AS dt, lag(v) OVER w AS pv FROM fx_stream WINDOW w AS (PARTITION BY k ORDER BY ts_ns, seq))""",
        "fx_stream",
    ),
)
def consecutive_deltas(spark, sf):
    from sensorlake.operators import trajectory

    d = trajectory.consecutive_deltas(fx_stream(spark, sf).select("seq", "k", "ts_ns", "v"), ["k"], "v", speed_scale=1e-5)
    return d.select("seq", "k", *[F.round(c, 6).alias(c) for c in ("dt_s", "mean_speed", "step")])


@query(
    "dead_reckoning",
    "WIN-09",
    with_sql(
        """SELECT seq, k, round(sum(coalesce((v+pv)/2*dt,0)) OVER (PARTITION BY k ORDER BY ts_ns, seq)/1e6::DOUBLE,4) AS x
FROM (SELECT *, (ts_ns-lag(ts_ns) OVER w)/1e9::DOUBLE AS dt, lag(v) OVER w AS pv FROM fx_stream WINDOW w AS (PARTITION BY k ORDER BY ts_ns, seq))""",
        "fx_stream",
    ),
)
def dead_reckoning(spark, sf):
    from sensorlake.operators import trajectory

    d = trajectory.dead_reckoning(fx_stream(spark, sf).select("seq", "k", "ts_ns", "v"), ["k"], "v", "x_plus")
    return d.select("seq", "k", F.round(F.col("x") / F.lit(1e6), 4).alias("x"))


@query(
    "path_length",
    "WIN-12 AGG-37",
    with_sql(
        """SELECT k, round(sum(sqrt((v-pv)*(v-pv)+(t-pt)*(t-pt))),4) AS path, round(max(v)-min(v),6) AS span_x, round(max(t)-min(t),6) AS span_y
FROM (SELECT k, v, t, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM (SELECT *, (ts_ns//1000000000%86400)/3600.0::DOUBLE AS t FROM fx_stream) WINDOW w AS (PARTITION BY k ORDER BY ts_ns, seq)) GROUP BY k""",
        "fx_stream",
    ),
)
def path_length(spark, sf):
    from sensorlake.operators import trajectory

    s = fx_stream(spark, sf).select("seq", "k", "ts_ns", F.col("v").alias("x"), (F.pmod(F.expr("ts_ns div 1000000000"), F.lit(86400)) / F.lit(3600.0)).alias("y"))
    d = trajectory.path_and_span(s, ["k"], ["x", "y"])
    return d.select("k", F.round("path", 4).alias("path"), F.round("span_x", 6).alias("span_x"), F.round("span_y", 6).alias("span_y"))


@query(
    "evidence_gate_status",
    "FLT-18 AGG-04",
    with_sql("SELECT k, st, count(*) AS n, CASE WHEN count(*)>=20 THEN 'ok' ELSE 'too_few_rows' END AS status FROM fx_stream GROUP BY k, st", "fx_stream"),
)
def evidence_gate_status(spark, sf):
    from sensorlake.operators import sampling

    return sampling.evidence_gate(fx_stream(spark, sf), KEY, 20, "too_few_rows")


@query(
    "stream_mode_value",
    "AGG-04",
    with_sql(
        "SELECT k, st, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, st) AS rn FROM (SELECT k, st, count(*) AS n FROM fx_stream GROUP BY k, st)) WHERE rn=1",
        "fx_stream",
    ),
)
def stream_mode_value(spark, sf):
    from sensorlake.operators import sampling

    return sampling.most_frequent(fx_stream(spark, sf), ["k"], "st")


@query(
    "hash_subset",
    "FLT-17",
    with_sql("SELECT * FROM (SELECT * FROM slim QUALIFY row_number() OVER (ORDER BY CAST('0x'||substr(md5('31:'||seq),1,15) AS BIGINT), seq)<=500)", "fx_stream", "slim AS (SELECT seq, k, st, ts_ns FROM fx_stream)"),
)
def hash_subset(spark, sf):
    from sensorlake.operators import sampling

    return sampling.exact_subset(_slim(spark, sf), ["seq"], 500, seed=31)


@query(
    "global_percentile_clip",
    "FLT-12",
    with_sql(
        "SELECT seq, v FROM fx_stream, (SELECT quantile_cont(v,0.01) AS lo, quantile_cont(v,0.995) AS hi FROM fx_stream) WHERE v>=lo AND v<=hi", "fx_stream"
    ),
)
def global_percentile_clip(spark, sf):
    s = fx_stream(spark, sf).select("seq", "v")
    return quantiles.attach_quantiles(s, [], "v", {"lo": 0.01, "hi": 0.995}).where("v >= lo AND v <= hi").select("seq", "v")
