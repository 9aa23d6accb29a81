"""Queries on sources, sinks and the remaining scalar rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sensorlake.functions import color, geometry as gm
from sensorlake.functions import labels as lb
from sensorlake.operators import asof, fit, merging, ordered, pairing, pointfilters, quantiles, spatial, trajectory
from sensorlake.plans.fixtures import DAY_NS, fx_docs, fx_pairs, fx_pixels, fx_points, fx_stream, table, with_sql
from sensorlake.plans.registry import query
from sensorlake.session import cut_lineage, shared_folder
from sensorlake.sinks import tables as sinks
from sensorlake.sources import decode, documents, recordings
from sensorlake.sources import schemas as sc


@query(
    "manifest_selection",
    "SRC-01 FLT-01",
    with_sql(
        """SELECT k::VARCHAR AS bag, label AS label_norm, msgs AS messages, gb AS size_gb FROM (SELECT k, CASE WHEN k%13=0 THEN 'Test_'||k ELSE 'pose_'||k END AS label, count(*)::INT AS msgs, CASE WHEN k%7<>0 THEN round(sum(v),2) END AS gb, count_if(st='purchase') AS rgb FROM fx_stream GROUP BY k)
WHERE k%5<>0 AND NOT contains(lower(label),'test') AND rgb>0""",
        "fx_stream",
    ),
)
def manifest_selection(spark, sf):
    g = fx_stream(spark, sf).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("gb"), F.count_if(F.col("st") == "purchase").alias("rgb"))
    k, s = F.col("k"), "string"
    cols = {
        "include_default": F.when(k % 5 == 0, "no").otherwise("yes"), "bag": k.cast(s), "bag_path": F.concat(F.lit("/data/"), k.cast(s)),
        "label_norm": F.concat(F.when(k % 13 == 0, "Test_").otherwise("pose_"), k.cast(s)), "size_gb": F.when(k % 7 == 0, " ").otherwise(F.col("gb").cast(s)),
        "messages": F.concat(F.col("n").cast(s), F.lit(".0")), "rgb_msgs": F.col("rgb").cast(s),
    }
    raw = g.select(*[cols.get(c, F.lit("")).alias(c) for c in (*sc.MANIFEST_TEXT, *sc.MANIFEST_DOUBLE, *sc.MANIFEST_INT)])
    m = recordings.select_recordings(recordings.clean_manifest(raw), sensors=["rgb"])
    return m.select("bag", "label_norm", "messages", "size_gb")


@query(
    "topic_selection_stamps",
    "SRC-03 SRC-04 FLT-02 SCL-03 SCL-24",
    with_sql(
        """SELECT seq, CASE st WHEN 'click' THEN 'rgb' ELSE 'vis' END AS sensor, CASE WHEN seq%4=0 THEN ts_ns ELSE ts_ns//1000000000*1000000000+77 END AS stamp_ns, ts_ns//1000000000 AS sec, (ts_ns%1000000000)::INT AS nanosec,
  (CASE st WHEN 'click' THEN 'rgb' ELSE 'vis' END) || '/' || lpad((seq%900)::VARCHAR,6,'0') || '_' || ts_ns || '.png' AS image_path FROM fx_stream WHERE st IN ('click','view')""",
        "fx_stream",
    ),
)
def topic_selection_stamps(spark, sf):
    m = fx_stream(spark, sf).withColumn("topic", F.col("st"))
    d = recordings.select_topics(m, {"click": "rgb", "view": "vis"})
    whole = F.expr("ts_ns div 1000000000")
    sec, nano = F.when(F.pmod("seq", F.lit(4)) == 0, F.lit(0)).otherwise(whole), F.when(F.pmod("seq", F.lit(4)) == 0, F.lit(0)).otherwise(F.lit(77))
    s = recordings.split_stamp(F.col("ts_ns"))
    return d.select(
        "seq", "sensor", recordings.header_stamp(sec, nano, F.col("ts_ns")).alias("stamp_ns"), s["sec"].alias("sec"), s["nanosec"].alias("nanosec"),
        lb.frame_name(F.col("sensor"), F.pmod("seq", F.lit(900)), F.col("ts_ns")).alias("image_path"),
    )


@query(
    "gnss_fix_filter",
    "SRC-05",
    with_sql(
        "SELECT 'georeference' AS mode, count(*) AS n, count(*) AS with_alt FROM g WHERE status>=0 AND lat IS NOT NULL AND alt IS NOT NULL UNION ALL SELECT 'index', count(*), count(alt) FROM g WHERE lat IS NOT NULL",
        "fx_stream",
        "g AS (SELECT seq%4-1 AS status, CASE WHEN seq%6<>0 THEN v END AS lat, CASE WHEN seq%5<>0 THEN v END AS alt FROM fx_stream)",
    ),
)
def gnss_fix_filter(spark, sf):
    nan = F.lit(float("nan"))
    s, v = F.col("seq"), F.col("v")
    g = fx_stream(spark, sf).select((s % 4 - 1).alias("status"), F.when(s % 6 == 0, nan).otherwise(v).alias("lat"), v.alias("lon"), F.when(s % 5 == 0, nan).otherwise(v).alias("alt"))
    parts = [recordings.gnss_fixes(g, m).agg(F.count(F.lit(1)).alias("n"), F.count("alt").alias("with_alt")).select(F.lit(m).alias("mode"), "n", "with_alt") for m in ("georeference", "index")]
    return parts[0].unionByName(parts[1])


@query(
    "velocity_speed",
    "SRC-07",
    with_sql("SELECT seq, CASE WHEN st<>'error' THEN round(sqrt(v*v+1+(seq%3)*(seq%3)),6) END AS speed FROM fx_stream", "fx_stream"),
)
def velocity_speed(spark, sf):
    lin = F.struct(F.col("v").alias("x"), F.lit(1.0).alias("y"), F.pmod("seq", F.lit(3)).cast("double").alias("z"))
    s = fx_stream(spark, sf).withColumn("twist", F.when(F.col("st") != "error", F.struct(lin.alias("linear"))))
    return s.select("seq", F.round(recordings.speed(), 6).alias("speed"))


@query(
    "odometry_columns",
    "SRC-06",
    with_sql("SELECT CASE WHEN seq%5=0 THEN (ts_ns//1000000000)*1000000000 ELSE ts_ns END AS stamp_ns, v AS x, v*2 AS y, -v AS z, 1.0::DOUBLE AS qw FROM fx_stream", "fx_stream"),
)
def odometry_columns(spark, sf):
    """Poses written as CSV with dotted headers, some stamps in floating point form, and read back."""
    s, zero = fx_stream(spark, sf), F.lit(0.0)
    stamp = F.when(F.col("seq") % 5 == 0, F.concat(F.expr("ts_ns div 1000000000").cast("string"), F.lit("E9"))).otherwise(F.concat(F.lit(" "), F.col("ts_ns").cast("string")))
    cols = {"stamp_ns": stamp, "x": F.col("v"), "y": F.col("v") * 2, "z": -F.col("v"), "qx": zero, "qy": zero, "qz": zero, "qw": F.lit(1.0)}
    path = shared_folder(spark, "odometry")
    s.select(*[c.alias(recordings.ODOMETRY[n]) for n, c in cols.items()]).write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return recordings.read_odometry(spark, path).select("stamp_ns", "x", "y", "z", "qw")


@query(
    "odometry_rejects",
    "SRC-06 SNK-09",
    with_sql(
        """SELECT CASE WHEN seq%11<>0 THEN ts_ns END AS stamp_ns, CASE WHEN seq%7<>0 THEN v END AS x, v*2 AS y,
  CASE WHEN seq%11=0 AND seq%7=0 THEN 'stamp_ns,x' WHEN seq%11=0 THEN 'stamp_ns' WHEN seq%7=0 THEN 'x' END AS error FROM fx_stream""",
        "fx_stream",
    ),
)
def odometry_rejects(spark, sf):
    """Some stamps are missing and some positions are no numbers; these rows come with their error, the rest is read."""
    s, zero = fx_stream(spark, sf), F.lit("0.0")
    stamp = F.when(F.col("seq") % 11 != 0, F.col("ts_ns").cast("string"))
    x = F.when(F.col("seq") % 7 == 0, F.when(F.col("seq") % 2 == 0, "n/a").otherwise("NaN")).otherwise(F.col("v").cast("string"))
    cols = {"stamp_ns": stamp, "x": x, "y": F.col("v") * 2, "z": zero, "qx": zero, "qy": zero, "qz": zero, "qw": zero}
    path = shared_folder(spark, "odometry")
    s.select(*[c.alias(recordings.ODOMETRY[n]) for n, c in cols.items()]).write.csv(path, header=True)
    return recordings.read_odometry_checked(spark, path).select("stamp_ns", "x", "y", "error")


@query("recording_discovery", "SRC-02", with_sql("SELECT DISTINCT 'bag_'||k AS bag FROM fx_stream", "fx_stream"))
def recording_discovery(spark, sf):
    """One folder per recording is written and the recordings are found by their files."""
    path = shared_folder(spark, "recordings")
    rows = fx_stream(spark, sf).select(F.concat(F.lit("bag_"), F.col("k")).alias("bag"), "seq", "ts_ns")
    # a file costs more than its rows, so tasks are as many as the cores ask for, not as the bytes do
    tasks = recordings.LISTING_TASKS * spark.sparkContext.defaultParallelism
    rows.repartition(tasks, "bag").write.partitionBy("bag").parquet(path)
    found = recordings.find_recordings(spark, path, "*.parquet")
    return found.select(F.regexp_extract("path", r"/bag=([^/]+)/", 1).alias("bag")).distinct()


@query(
    "plot_layer_file",
    "SRC-13 JN-13",
    with_sql(
        """SELECT seq, sub, CASE WHEN x>10 AND x<30 AND y>1 AND y<9 AND NOT (x>=15 AND x<=20 AND y>=3 AND y<=6) THEN '1' WHEN (x>40 AND x<50 OR x>60 AND x<75) AND y>2 AND y<8 THEN '2' END AS plot_id FROM fx_points""",
        "fx_points",
    ),
)
def plot_layer_file(spark, sf):
    """A GeoJSON file with a hole and a plot of two parts, written from rows, read as a plot layer and joined with the points."""
    box = lambda a, b, c, d: f"[[{a},{b}],[{c},{b}],[{c},{d}],[{a},{d}],[{a},{b}]]"
    shapes = [("Polygon", f"[{box(10, 1, 30, 9)},{box(15, 3, 20, 6)}]"), ("MultiPolygon", f"[[{box(40, 2, 50, 8)}],[{box(60, 2, 75, 8)}]]")]
    text = ",".join(f'{{"type":"Feature","properties":{{" name ":"p"}},"geometry":{{"type":"{t}","coordinates":{c}}}}}' for t, c in shapes)
    path = shared_folder(spark, "plots")
    spark.range(1).select(F.lit(f'{{"type":"FeatureCollection","features":[{text}]}}')).write.text(path)
    plots = documents.read_plots(spark, path)
    d = spatial.assign_plot(fx_points(spark, sf).select("seq", "sub", "x", "y"), plots, ["seq", "sub"], 5.0)
    return d.select("seq", "sub", "plot_id")


@query(
    "frame_index_names",
    "SRC-14 JN-04",
    with_sql("SELECT seq, 'bag_'||k AS bag_id, ts_ns, (seq%900)::INT AS frame_index FROM fx_stream", "fx_stream"),
)
def frame_index_names(spark, sf):
    s = fx_stream(spark, sf)
    t = F.col("ts_ns").cast("string")
    raw = s.select(
        "seq", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("bag_"), F.col("k"))).alias("bag_id"), F.concat(F.lit("/in/bag_"), F.col("k"), F.lit(".bag")).alias("bag"), F.col("st").alias("sensor"),
        F.pmod("seq", F.lit(900)).cast("string").alias("frame_index"), F.when(F.col("seq") % 3 == 0, t).otherwise("").alias("stamp_ns"), F.concat(F.lit("images/x/000012_"), t, F.lit("_7.png")).alias("image_path"),
    )
    idx = recordings.frame_index(raw.withColumn("bag_id", F.concat_ws("|", F.coalesce("bag_id", F.lit("")), F.lit(""))).withColumn("bag_id", F.regexp_replace("bag_id", r"\|", "")).withColumn("sensor", F.col("seq").cast("string")))
    return idx.select(F.col("sensor").cast("bigint").alias("seq"), "bag_id", "ts_ns", "frame_index")


@query(
    "review_folder_sets",
    "SRC-15",
    with_sql("SELECT 'f'||k||'_'||(ts_ns//259200000000000) AS frame_id, count(DISTINCT st) AS files FROM fx_stream WHERE st IN ('click','view','error','purchase') GROUP BY 1 HAVING count(DISTINCT st)=4", "fx_stream"),
)
def review_folder_sets(spark, sf):
    s = fx_stream(spark, sf)
    frame = F.concat(F.lit("f"), F.col("k"), F.lit("_"), F.call_function("div", F.col("ts_ns"), F.lit(3 * DAY_NS)))
    name = F.when(F.col("st") == "click", "rgb.jpg").when(F.col("st") == "view", "vis.jpg").when(F.col("st") == "error", "nir.jpg").when(F.col("st") == "purchase", "thermal_c.jpg")
    d = recordings.review_sets(s.select(F.concat_ws("/", F.lit("file:/in"), frame, name).alias("path")))
    return d.select("frame_id", F.lit(4).cast("bigint").alias("files"))


@query(
    "nested_detection_scan",
    "SRC-11 SNK-07 FLT-16",
    with_sql(
        """SELECT 'L'||k AS label, st AS sensor, seq::INT AS frame_index, v AS score, 12 AS corners, true AS complete FROM (SELECT *, row_number() OVER (PARTITION BY k, st ORDER BY v DESC, seq DESC) AS rn FROM fx_stream) WHERE rn=1""",
        "fx_stream",
    ),
)
def nested_detection_scan(spark, sf):
    best = fx_stream(spark, sf).groupBy("k", "st").agg(F.max(F.struct("v", "seq")).alias("b"))
    grid = F.array(*[F.array((F.col("b.v") + c).cast("double"), F.lit(float(r))) for r in range(3) for c in range(4)])
    det = F.struct(F.lit(True).alias("checker_detected"), F.col("b.v").alias("score"), F.col("b.seq").alias("frame_index"), grid.alias("corners_px"), F.array(F.lit(4), F.lit(3)).alias("pattern_internal_corners"))
    per = best.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("st", det))).alias("detections"))
    text = F.to_json(F.struct(F.array(F.struct(F.lit("").alias("label_norm"), F.concat(F.lit("L"), F.col("k")).alias("label_raw"), F.lit("b").alias("bag"), "detections")).alias("results")))
    docs = per.select(F.from_json(text, sc.DETECTION_DOCUMENT).alias("d")).select("d.*")
    d = documents.flatten_detections(docs, "scan")
    return d.select("label", "sensor", "frame_index", "score", F.size("corners").alias("corners"), pointfilters.complete_pattern(F.col("corners"), F.col("cols"), F.col("rows"), 4, 3).alias("complete"))


@query(
    "detection_document_rejects",
    "SRC-11 SNK-09",
    with_sql(
        """SELECT path, CASE WHEN h=0 THEN 'unreadable document' WHEN h=1 THEN 'no results' WHEN h=2 THEN 'empty document' END AS error, CASE WHEN h>2 THEN n ELSE 0 END AS n, CASE WHEN h>2 THEN best END AS best
FROM (SELECT 'doc_'||k AS path, k%5 AS h, count(DISTINCT st) AS n, max(v) AS best FROM fx_stream GROUP BY k)""",
        "fx_stream",
    ),
)
def detection_document_rejects(spark, sf):
    """One document per recording is written to a table of documents, some cut off, without results or empty; each gives its detections or its error."""
    best = fx_stream(spark, sf).groupBy("k", "st").agg(F.max("v").alias("v"))
    det = F.struct(F.lit(True).alias("checker_detected"), F.col("v").alias("score"))
    per = best.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("st", det))).alias("detections"))
    text = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("doc_"), F.col("k")).alias("label_norm"), "detections")).alias("results")))
    kind = F.pmod("k", F.lit(5))
    text = F.when(kind == 0, F.substring(text, 1, 40)).when(kind == 1, '{"other": 1}').when(kind == 2, " ").otherwise(text)
    texts = cut_lineage(per.select(F.concat(F.lit("doc_"), F.col("k")).alias("path"), text.alias("text")))
    rows, rejects = documents.checked_detections(texts, "scan")
    good = rows.groupBy(F.col("label").alias("path")).agg(F.lit(None).cast("string").alias("error"), F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    return good.union(rejects.select("path", "error", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("best")))


@query(
    "calibration_documents",
    "SRC-12",
    with_sql("SELECT g::VARCHAR AS name, round(avg(sx),6) AS h02, round(avg(sy),6) AS h12 FROM fx_pairs GROUP BY g", "fx_pairs"),
)
def calibration_documents(spark, sf):
    g = fx_pairs(spark, sf).groupBy("g").agg(F.avg("sx").alias("a"), F.avg("sy").alias("b"))
    m = F.array(F.array(F.lit(1.0), F.lit(0.0), F.col("a")), F.array(F.lit(0.0), F.lit(1.0), F.col("b")), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    text = F.to_json(F.struct(F.create_map(F.col("g").cast("string"), m, F.lit("broken"), F.slice(m, 1, 2)).alias("homographies")))
    docs = g.select(F.from_json(text, documents.sc.HOMOGRAPHY_DOCUMENT).alias("d")).select("d.*")
    h = documents.flatten_homographies(docs)
    return h.select("name", F.round(F.get("h", F.lit(2)), 6).alias("h02"), F.round(F.get("h", F.lit(5)), 6).alias("h12"))


@query(
    "initial_intrinsics_lookup",
    "SCL-33",
    with_sql(
        "SELECT seq, CASE WHEN st='error' THEN 'no_initial_intrinsics' WHEN seq%3<>0 THEN 'resolution_differs' ELSE 'initial_intrinsics' END AS reason, CASE WHEN st<>'error' AND seq%3=0 THEN 1000.0::DOUBLE ELSE 1.4::DOUBLE*greatest(640+seq%3,480) END AS fx FROM fx_stream",
        "fx_stream",
    ),
)
def initial_intrinsics_lookup(spark, sf):
    s = fx_stream(spark, sf)
    k = F.array(*[F.lit(v) for v in (1000.0, 0.0, 320.0, 0.0, 1000.0, 240.0, 0.0, 0.0, 1.0)])
    known = s.select(F.col("st").alias("sensor")).where("st <> 'error'").distinct().select("sensor", k.alias("k"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    frames = s.select("seq", F.col("st").alias("sensor"), (F.pmod("seq", F.lit(3)) + 640).alias("width"), F.lit(480).alias("height"))
    return documents.initial_intrinsics(frames, known).select("seq", "reason", F.get("k", F.lit(0)).alias("fx"))


def _pack_imu(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fixture: message rows to packets; every 11th is cut short."""
    for pdf in it:
        rec = np.zeros(len(pdf), decode.IMU_DTYPE)
        rec["diag"] = rec["accel_ts"] = pdf["ts_ns"].astype("u8")
        rec["gyro_ts"] = pdf["ts_ns"].astype("u8") + 500
        for i, f in enumerate((1.0, 0.5, 0.25)):
            rec["a"][:, i] = pdf["v"] * f
            rec["w"][:, i] = pdf["v"] * -f
        raw = [rec[i].tobytes()[: 47 if s % 11 == 0 else 48] for i, s in enumerate(pdf["seq"])]
        yield pd.DataFrame({"bag_id": pdf["k"].astype(str), "ts_ns": pdf["ts_ns"], "seq": pdf["seq"], "raw": raw})


@query(
    "imu_decode",
    "SRC-08 SNK-09",
    with_sql(
        """SELECT seq, CASE WHEN seq%11=0 THEN 47 ELSE 48 END AS buf_len, seq%11=0 AS failed, CASE WHEN seq%11<>0 THEN ts_ns+500 END AS gyro_ts_ns, CASE WHEN seq%11<>0 THEN round((v::FLOAT)::DOUBLE*9.80665::DOUBLE,8) END AS ax, CASE WHEN seq%11<>0 THEN round(radians((v*-0.5::DOUBLE)::FLOAT::DOUBLE),6) END AS gy FROM fx_stream""",
        "fx_stream",
    ),
)
def imu_decode(spark, sf):
    m = fx_stream(spark, sf).select("k", "ts_ns", "seq", "v").mapInPandas(_pack_imu, "bag_id string, ts_ns bigint, seq bigint, raw binary")
    d = decode.decode_imu(m)
    return d.select("seq", "buf_len", F.col("error").isNotNull().alias("failed"), "gyro_ts_ns", F.round("accel_x_mps2", 8).alias("ax"), F.round("gyro_y_radps", 6).alias("gy"))


def _pack_clouds(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    dtype = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("pad", "u1", 4), ("intensity", "<f4")])
    for pdf in it:
        fields = [{"name": f, "offset": int(dtype.fields[f][1]), "datatype": 7} for f in ("x", "y", "z", "intensity")]
        n = pdf["x"].map(len)
        rec = np.zeros(n.sum(), dtype)
        for f in ("x", "y", "z", "intensity"):
            rec[f] = np.concatenate(pdf[f].to_list())
        whole, ends = rec.tobytes(), (n.cumsum() * dtype.itemsize).to_list()
        data = [whole[a:b] for a, b in zip([0, *ends], ends)]
        yield pd.DataFrame({"bag_id": "b", "cloud_ts": pdf["frame"], "height": 1, "width": n, "point_step": dtype.itemsize, "fields": [fields] * len(pdf), "data": data})


@query(
    "pointcloud_explode",
    "SRC-09",
    with_sql("SELECT frame AS cloud_ts, count(*) AS n, round(sum(x::FLOAT::DOUBLE),4) AS sx, round(max(intensity::FLOAT::DOUBLE),4) AS mi FROM fx_points GROUP BY frame", "fx_points"),
)
def pointcloud_explode(spark, sf):
    g = fx_points(spark, sf).groupBy("frame").agg(F.collect_list(F.struct("x", "y", "z", "intensity")).alias("pts"))  # a handful of points per order
    schema = "bag_id string, cloud_ts bigint, height int, width int, point_step int, fields array<struct<name:string,offset:int,datatype:int>>, data binary"
    g = g.select("frame", *[F.col(f"pts.{f}").alias(f) for f in ("x", "y", "z", "intensity")])
    p = decode.explode_clouds(g.mapInPandas(_pack_clouds, schema), ("x", "y", "intensity"))
    return p.groupBy("cloud_ts").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x").cast("double")), 4).alias("sx"), F.round(F.max(F.col("intensity").cast("double")), 4).alias("mi"))


def _pack_frames(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        data = [np.clip((np.asarray(e, "f8") + 1) * 127.5, 0, 255).astype("u1").tobytes() for e in pdf["embedding"]]
        enc = ["mystery" if i % 9 == 0 else "mono8" for i in pdf["vec_id"]]
        yield pd.DataFrame({"frame_id": pdf["vec_id"].astype(str), "encoding": enc, "height": 8, "width": 8, "data": data})


@query(
    "frame_explode",
    "SRC-10 SNK-09",
    with_sql(
        "SELECT rr::VARCHAR AS frame_id, count(*) AS cells, sum(v)::BIGINT AS total, NULL::VARCHAR AS error FROM fx_pixels WHERE rr%9<>0 GROUP BY rr UNION ALL SELECT DISTINCT rr::VARCHAR, 0, NULL::BIGINT, 'unknown encoding' FROM fx_pixels WHERE rr%9=0",
        "fx_pixels",
    ),
)
def frame_explode(spark, sf):
    m = table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(_pack_frames, "frame_id string, encoding string, height int, width int, data binary")
    d = decode.explode_frames(m)
    good, bad = merging.split_failures(d)
    g = good.groupBy("frame_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").cast("bigint").alias("total"), F.lit(None).cast("string").alias("error"))
    return g.unionByName(bad.select("frame_id", F.lit(0).cast("bigint").alias("cells"), F.lit(None).cast("bigint").alias("total"), "error"))


@query("union_sorted_table", "SNK-01", with_sql("SELECT doc_id, lang, NULL::VARCHAR AS url FROM fx_docs UNION ALL SELECT page_id, NULL, url FROM pages", "fx_docs"))
def union_sorted_table(spark, sf):
    return sinks.union_sorted(fx_docs(spark, sf).select("doc_id", "lang"), table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url"))


@query(
    "geojson_features",
    "SNK-02",
    with_sql(
        """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (9+seq%7)::VARCHAR || '.0,' || (45+seq%5)::VARCHAR || '.0]},"properties":{"seq":' || seq || ',"st":"' || st || '"}}' AS value FROM fx_stream WHERE seq%6<>0""",
        "fx_stream",
    ),
)
def geojson_features(spark, sf):
    s = fx_stream(spark, sf)
    lon = F.when(F.col("seq") % 6 != 0, (F.pmod("seq", F.lit(7)) + 9).cast("double"))
    return sinks.feature_points(s.select("seq", "st", lon.alias("gps_lon"), (F.pmod("seq", F.lit(5)) + 45).cast("double").alias("gps_lat")))


@query(
    "geojson_track_lines",
    "SNK-02",
    with_sql(
        "SELECT k, count(*) AS vertices, max(v) FILTER (i=0) AS lon_0, max(v) FILTER (i=40) AS lon_40, max(v) FILTER (i=n-1) AS lon_last FROM ix GROUP BY k HAVING count(*)>1",
        "fx_stream",
        "ix AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY ts_ns, seq)-1 AS i, count(*) OVER (PARTITION BY k) AS n FROM fx_stream)",
    ),
)
def geojson_track_lines(spark, sf):
    s = fx_stream(spark, sf).select("k", "ts_ns", "seq", F.col("v").alias("lon"), F.lit(45.0).alias("lat"))
    d = sinks.feature_lines(s, ["k"], ["ts_ns", "seq"], "lon", "lat", 40)
    c = F.from_json("value", "geometry struct<coordinates: array<array<double>>>")["geometry"]["coordinates"]
    lon = lambda i: F.try_element_at(F.try_element_at(c, F.lit(i)), F.lit(1))
    return d.select("k", F.size(c).cast("bigint").alias("vertices"), lon(1).alias("lon_0"), lon(41).alias("lon_40"), lon(-1).alias("lon_last"))


@query(
    "stream_tables",
    "SNK-03",
    with_sql("SELECT k AS bag_id, st AS topic, seq, row_number() OVER (PARTITION BY k, st ORDER BY ts_ns, seq)-1 AS index FROM fx_stream", "fx_stream"),
)
def stream_tables(spark, sf):
    m = fx_stream(spark, sf).select(F.col("k").alias("bag_id"), F.col("st").alias("topic"), "ts_ns", "seq")
    return sinks.stream_table(m).select("bag_id", "topic", "seq", "index")


@query(
    "raster_layer_rows",
    "SNK-04 RAS-07",
    with_sql("SELECT 'z' AS layer, row, col, max(z) AS value FROM c GROUP BY row, col UNION ALL SELECT 'n', row, col, count(*)::DOUBLE FROM c GROUP BY row, col", "fx_points", "c AS (SELECT floor(y)::INT AS row, floor(x)::INT AS col, z FROM fx_points)"),
)
def raster_layer_rows(spark, sf):
    c = fx_points(spark, sf).groupBy(F.floor("y").cast("int").alias("row"), F.floor("x").cast("int").alias("col")).agg(F.max("z").alias("z"), F.count(F.lit(1)).alias("n"))
    return sinks.raster_layers(c, {"z": "z", "n": "n"})


@query("run_summary_document", "SNK-05", with_sql("""SELECT '{"messages":' || count(*) || ',"start_ns":' || min(ts_ns) || ',"streams":' || count(DISTINCT st) || '}' AS value FROM fx_stream""", "fx_stream"))
def run_summary_document(spark, sf):
    return sinks.run_summary(fx_stream(spark, sf), {"messages": F.count(F.lit(1)), "start_ns": F.min("ts_ns"), "streams": F.count_distinct("st")})


@query(
    "compact_calibration_table",
    "SNK-06 SCL-21",
    with_sql(
        """SELECT 'intrinsics' AS block, st AS sensor, CASE WHEN max(v)<=2 THEN 'candidate_model_assisted' ELSE 'candidate' END AS status, count(*) AS n_views_or_pairs, round(avg(v),6) AS rms_or_median_px, NULL::VARCHAR AS notes FROM fx_stream GROUP BY st
UNION ALL SELECT 'homography_to_rgb', st, CASE WHEN median(v)<=15 THEN 'target_plane_homography_candidate' WHEN median(v)<=30 THEN 'target_plane_homography_weak_high_error' ELSE 'target_plane_homography_rejected_high_error' END, count(*), round(median(v),6), 'grid' FROM fx_stream GROUP BY st
UNION ALL SELECT 'stereo_to_rgb', st, CASE WHEN min(v)<=10 THEN 'physical_extrinsic_candidate' ELSE 'physical_extrinsic_weak_high_stereo_rms' END, count(*), min(v), NULL FROM fx_stream GROUP BY st""",
        "fx_stream",
    ),
)
def compact_calibration_table(spark, sf):
    s = fx_stream(spark, sf)
    q = quantiles.exact_quantiles(s, ["st"], "v", {"med": 0.5}, moments=True)
    g = q.join(s.groupBy("st").agg(F.min("v").alias("lo")), "st")
    none = F.lit(None).cast("string")
    a = g.select(F.col("st").alias("sensor"), lb.intrinsics_status(F.col("st"), F.col("mean"), F.col("med")).alias("status"), "n", F.round("mean", 6).alias("error_px"), none.alias("notes"))
    b = g.select(F.col("st").alias("sensor"), lb.homography_status(F.col("st"), F.col("med")).alias("status"), "n", F.round("med", 6).alias("error_px"), F.lit("grid").alias("notes"))
    c = g.select(F.col("st").alias("sensor"), lb.stereo_status(F.col("lo")).alias("status"), "n", F.col("lo").alias("error_px"), none.alias("notes"))
    return sinks.compact_calibration(a, b, c)


@query(
    "pose_tables",
    "SNK-10 SCL-08 JN-03",
    with_sql("SELECT id, round(1.5::DOUBLE*(cos(0.3::DOUBLE)*sx-sin(0.3::DOUBLE)*sy)+400,6) AS e, round(sqrt(0.01::DOUBLE*n*n+0.04::DOUBLE*n*n),6) AS residual FROM (SELECT vec_id AS id, embedding[1]::DOUBLE*100 AS sx, embedding[2]::DOUBLE*100 AS sy, embedding[3]::DOUBLE AS n FROM embeddings)", "fx_pairs"),
)
def pose_tables(spark, sf):
    p = fx_pairs(spark, sf)
    e, n = gm.similarity_apply(F.col("sx"), F.col("sy"), F.lit(1.5), F.lit(0.3), F.lit(400.0), F.lit(5000.0))
    r = F.sqrt((e - F.col("dx")) * (e - F.col("dx")) + (n - F.col("dy")) * (n - F.col("dy")))
    return p.select("id", F.round(e, 6).alias("e"), F.round(r, 6).alias("residual"))


@query(
    "tone_and_crop_rules",
    "SCL-20 SCL-27 SCL-30 SCL-19",
    with_sql(
        """SELECT seq, sub, round(pow(least(greatest((z-5)/35.0::DOUBLE,0),1),0.75::DOUBLE),6) AS tone, round_even((100+z)*0.15::DOUBLE,0)::INT AS g0, trunc((100+z)*0.15::DOUBLE)::INT AS p0, trunc(least(greatest(z*1500,0),65535))::INT AS mm, round(CASE WHEN 2*intensity+tax+z>1e-6::DOUBLE THEN (2*intensity-tax-z)/(2*intensity+tax+z) ELSE 0 END,6) AS gli FROM fx_points""",
        "fx_points",
    ),
)
def tone_and_crop_rules(spark, sf):
    z = F.col("z")
    g0, _ = pairing.crop_edges(z + 100, 0.15, 0.85, "gallery")
    p0, _ = pairing.crop_edges(z + 100, 0.15, 0.85, "plot")
    tone = color.gamma_curve(z, F.lit(5.0), F.lit(40.0), 0.75)
    return fx_points(spark, sf).select("seq", "sub", F.round(tone, 6).alias("tone"), g0.alias("g0"), p0.alias("p0"), color.depth_mm(z * 1.5).alias("mm"), F.round(color.gli(F.col("tax"), F.col("intensity"), z), 6).alias("gli"))


@query(
    "pair_transform_ladder",
    "SCL-28 SCL-29",
    with_sql(
        """SELECT seq, CASE WHEN st='click' AND n>=25 THEN 'rgb_feature_vertical_strip' WHEN n>=18 THEN 'soil_feature_vertical_strip' WHEN seq%3=0 THEN 'rgb_ecc_vertical_strip' WHEN seq%3=1 THEN 'rgb_phase_vertical_strip' ELSE 'fallback_translation' END AS method,
  round(CASE WHEN st='click' AND n>=25 THEN v WHEN n>=18 THEN v/2 WHEN seq%3=0 THEN -v WHEN seq%3=1 THEN -2*v ELSE -0.28::DOUBLE*480 END,6) AS dy, 0.0::DOUBLE AS dx_strip FROM (SELECT *, seq%40 AS n FROM fx_stream)""",
        "fx_stream",
    ),
)
def pair_transform_ladder(spark, sf):
    shift = lambda dy, ok: F.when(ok, F.array(*[F.lit(v) for v in (1.0, 0.0, 3.0, 0.0, 1.0)], dy, *[F.lit(v) for v in (0.0, 0.0, 1.0)]))
    n, v, s = F.pmod("seq", F.lit(40)), F.col("v"), F.pmod("seq", F.lit(3))
    p = fx_stream(spark, sf).select(
        "seq", shift(v, F.col("st") == "click").alias("h_rgb"), n.alias("n_rgb"), shift(v / 2, F.lit(True)).alias("h_soil"), n.alias("n_soil"), shift(-v, s == 0).alias("h_ecc"), shift(-2 * v, s == 1).alias("h_phase")
    )
    d = pairing.pair_transform(p, 640, 480, "vertical_strip")
    return d.select("seq", "method", F.round(F.get("h", F.lit(5)), 6).alias("dy"), F.get("h", F.lit(2)).alias("dx_strip"))


@query(
    "pose_chain",
    "WIN-11 SCL-06",
    with_sql(
        "SELECT seq, k, round(sum(s) OVER w,5) AS x, round(sum(t) OVER w,5) AS y FROM (SELECT seq, k, ts_ns, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY ts_ns, seq)=1 THEN 0 ELSE v/100 END AS s, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY ts_ns, seq)=1 THEN 0 ELSE (seq%7)/10.0::DOUBLE END AS t FROM fx_stream) WINDOW w AS (PARTITION BY k ORDER BY ts_ns, seq)",
        "fx_stream",
    ),
)
def pose_chain(spark, sf):
    s = ordered.previous_row(fx_stream(spark, sf).select("seq", "k", "ts_ns", "v"), ["k"], ["ts_ns", "seq"], {"seq": "_p"})
    step = F.when(F.col("_p").isNotNull(), F.array(F.lit(1.0), F.lit(0.0), F.col("v") / 100, F.lit(0.0), F.lit(1.0), F.pmod("seq", F.lit(7)) / F.lit(10.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    d = trajectory.pose_chain(s.withColumn("step", step), ["k"], "step", 3, block=16)
    return d.select("seq", "k", F.round(F.get("pose", F.lit(2)), 5).alias("x"), F.round(F.get("pose", F.lit(5)), 5).alias("y"))


@query(
    "gyro_rotation",
    "WIN-10 JN-07",
    with_sql(
        """SELECT seq, n, round(coalesce(a,0),6) AS rot FROM (SELECT seq, count(*) AS n, sum(a) AS a FROM (SELECT *, (v+lag(v) OVER w)/2*(clip_ns-lag(clip_ns) OVER w)/1e15::DOUBLE AS a FROM kept WHERE n>=2 WINDOW w AS (PARTITION BY seq ORDER BY clip_ns, ts_ns, s_seq)) GROUP BY seq)""",
        "fx_stream",
        """iv AS (SELECT seq, k, ts_ns AS t0, lead(ts_ns) OVER (PARTITION BY k ORDER BY ts_ns, seq) AS t1 FROM fx_stream WHERE st='purchase'),
smp AS (SELECT seq AS s_seq, k, ts_ns, v, lag(ts_ns) OVER (PARTITION BY k ORDER BY ts_ns, seq) AS p, lead(ts_ns) OVER (PARTITION BY k ORDER BY ts_ns, seq) AS n FROM fx_stream WHERE st='click'),
hit AS (SELECT iv.seq, s.s_seq, s.ts_ns, s.v, least(greatest(s.ts_ns, t0), t1) AS clip_ns FROM iv JOIN smp s ON iv.k=s.k WHERE t1 IS NOT NULL AND coalesce(s.n, 9000000000000000000) >= t0 AND coalesce(s.p, 0) <= t1),
gap AS (SELECT *, clip_ns - lag(clip_ns) OVER (PARTITION BY seq ORDER BY ts_ns, s_seq) AS g FROM hit),
kept AS (SELECT *, count(*) OVER (PARTITION BY seq) AS n FROM gap WHERE g IS NULL OR g > 100)""",
    ),
)
def gyro_rotation(spark, sf):
    s = fx_stream(spark, sf)
    iv = ordered.previous_row(s.where("st = 'purchase'").select("seq", "k", "ts_ns"), ["k"], ["ts_ns", "seq"], {"ts_ns": "t1_ns"}, forward=True)
    iv = iv.where("t1_ns IS NOT NULL").select("k", F.col("seq").alias("iv"), F.col("ts_ns").alias("t0_ns"), "t1_ns")
    got = asof.bracketed_slice(iv, s.where("st = 'click'").select("k", "seq", "ts_ns", "v"), ["k"], "iv", ["v"], bucket_ns=DAY_NS)
    g = trajectory.gyro_rotation(got.select("iv", "v", F.col("clip_ns"), "seq"), ["iv"], ["v"], "clip_ns")
    return g.select(F.col("iv").alias("seq"), "n", F.round(F.col("rot_v") / F.lit(1e6), 6).alias("rot"))


@query(
    "subgrid_best_option",
    "JN-14 SCL-16 WIN-07",
    with_sql(
        "SELECT k, 1 AS ac0, 0 AS ar0, 0 AS bc0, 1 AS br0, 4 AS cc, 3 AS cr, true AS accepted FROM (SELECT DISTINCT k FROM fx_stream)",
        "fx_stream",
    ),
)
def subgrid_best_option(spark, sf):
    from sensorlake.operators.ranking import best_option

    g = fx_stream(spark, sf).groupBy("k").agg((F.max("v") + 20).alias("s"))
    grid = lambda cols, rows, c0, r0: F.array(*[F.struct((F.col("s") * (c + c0) + 0.3 * c * r).alias("x"), (F.col("s") * (r + r0)).alias("y")) for r in range(rows) for c in range(cols)])
    a = g.select("k", F.lit(5).alias("cols"), F.lit(3).alias("rows"), grid(5, 3, 0, 1).alias("corners"))
    b = g.select("k", F.lit(4).alias("cols"), F.lit(4).alias("rows"), grid(4, 4, 1, 0).alias("corners"))
    p = pairing.subgrid_pairs(pairing.subgrid_options(a, b, "k", (3, 3)), "k")
    dx, dy = F.col("sx") - F.col("dx"), F.col("sy") - F.col("dy")
    best = best_option(p.withColumn("err", F.sqrt(dx * dx + dy * dy)), ["k"], "opt", "err", 10.0)
    o = p.select("k", "opt", "ac0", "ar0", "bc0", "br0", "cc", "cr").distinct()
    return best.join(o, ["k", "opt"]).select("k", "ac0", "ar0", "bc0", "br0", "cc", "cr", "accepted")


@query(
    "alignment_evaluation",
    "AGG-38",
    with_sql(
        """SELECT id, fold, round(degrees(acos(least(greatest(abs(c),0),1))),5) AS normal_deg, round(abs(gx*0.6::DOUBLE+gz*0.8::DOUBLE),6) AS plane_m, round(sqrt(gx*gx+gz*gz),6) AS centroid_m FROM (
  SELECT id, ((row_number() OVER (ORDER BY id)-1)%5)::INT AS fold, 0.6::DOUBLE*sin(n)+0.8::DOUBLE*cos(n) AS c, sx/1000 AS gx, sy/1000 AS gz FROM (SELECT vec_id AS id, embedding[1]::DOUBLE*100 AS sx, embedding[2]::DOUBLE*100 AS sy, embedding[3]::DOUBLE AS n FROM embeddings))""",
        "fx_pairs",
    ),
)
def alignment_evaluation(spark, sf):
    e = table(spark, sf, "embeddings")
    at = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    o = F.lit(0.0)
    p = e.select(
        F.col("vec_id").alias("id"), F.array(F.sin(at[2]), o, F.cos(at[2])).alias("cn"), F.array(at[0] * 100 / 1000, o, at[1] * 100 / 1000).alias("cc"), F.array(F.lit(0.6), o, F.lit(0.8)).alias("ln"), F.array(o, o, o).alias("lc")
    )
    d = fit.alignment_evaluation(p, 5, "id")
    return d.select("id", "fold", F.round("normal_deg", 5).alias("normal_deg"), F.round("plane_m", 6).alias("plane_m"), F.round("centroid_m", 6).alias("centroid_m"))


@query(
    "overlay_metrics",
    "AGG-39",
    with_sql(
        "SELECT flag, count(*) AS n, round(avg((x BETWEEN 20 AND 70 AND y BETWEEN 2 AND 9)::INT),6) AS inside, round(median(x)-45,6) AS du, round(median(y)-5.5::DOUBLE,6) AS dv FROM fx_points GROUP BY flag",
        "fx_points",
    ),
)
def overlay_metrics(spark, sf):
    p = fx_points(spark, sf).select("flag", "x", "y", gm.box(20.0, 2.0, 70.0, 9.0).alias("b"))
    m = pairing.overlay_metrics(p, ["flag"], "x", "y", "b")
    return m.select("flag", "n", *[F.round(c, 6).alias(c) for c in ("inside", "du", "dv")])


@query(
    "hull_area",
    "SCL-14 SCL-31",
    with_sql(
        """SELECT board, round(-sum(part),6) AS area FROM (SELECT board, list_sum(list_transform(range(1, len(s)), lambda k: (s[k+1].x-s[k].x)*(s[k+1].y+s[k].y)/2)) AS part FROM chain WHERE i>len(p)) GROUP BY board""",
        "fx_points",
        """cols AS (SELECT ts_ns//86400000000000//30 AS board, x, min(y) AS lo, max(y) AS hi FROM fx_points GROUP BY 1, 2),
side AS (SELECT board, list({'x': x, 'y': lo} ORDER BY x) AS p FROM cols GROUP BY board UNION ALL SELECT board, list({'x': x, 'y': -hi} ORDER BY x) FROM cols GROUP BY board),
chain(board, p, i, s) AS (SELECT board, p, 1, p[1:0] FROM side UNION ALL SELECT board, p,
  CASE WHEN len(s)>1 AND (s[-1].x-s[-2].x)*(p[i].y-s[-2].y)-(s[-1].y-s[-2].y)*(p[i].x-s[-2].x)<=0 THEN i ELSE i+1 END,
  CASE WHEN len(s)>1 AND (s[-1].x-s[-2].x)*(p[i].y-s[-2].y)-(s[-1].y-s[-2].y)*(p[i].x-s[-2].x)<=0 THEN s[1:-2] ELSE list_append(s, p[i]) END FROM chain WHERE i<=len(p))""",
        recursive=True,
    ),
)
def hull_area(spark, sf):
    from sensorlake.operators.hull import hull_areas

    p = fx_points(spark, sf).select(F.expr("ts_ns div 86400000000000 div 30").alias("board"), "x", "y")
    return hull_areas(p, ["board"], "x", "y").select("board", F.round("area", 6).alias("area"))


@query(
    "mosaic_canvas",
    "SCL-28 JOB-06",
    with_sql("SELECT k, (120-floor(min(v)))::INT AS tx, (120-floor(min(-2*v)))::INT AS ty, (ceil(max(v+64))-floor(min(v))+240)::INT AS width, (ceil(max(-2*v+48))-floor(min(-2*v))+240)::INT AS height FROM fx_stream GROUP BY k", "fx_stream"),
)
def mosaic_canvas(spark, sf):
    v = F.col("v")
    h = F.array(F.lit(1.0), F.lit(0.0), v, F.lit(0.0), F.lit(1.0), -2 * v, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    d = pairing.canvas(fx_stream(spark, sf).select("k", h.alias("h")), ["k"], "h", 64, 48)
    return d


@query(
    "pixel_band_preview",
    "SCL-25",
    with_sql(
        """SELECT frame, (r//4)::INT AS br, (c//4)::INT AS bc, round(avg(v),6) AS mean FROM fx_pixels
JOIN (SELECT frame, max(r)+1 AS nr, max(c)+1 AS nc FROM fx_pixels GROUP BY frame) USING (frame) WHERE r<nr-nr%4 AND c<nc-nc%4 GROUP BY 1,2,3""",
        "fx_pixels",
    ),
)
def pixel_band_preview(spark, sf):
    from sensorlake.operators.pixels import complete_blocks, with_band

    d = complete_blocks(fx_pixels(spark, sf).select("frame", "r", "c", "v"), ["frame"], 4)
    return with_band(d, 4).groupBy("frame", "br", "bc").agg(F.round(F.avg("v"), 6).alias("mean"))
