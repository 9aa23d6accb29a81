"""The given tables seen as recordings, and the same views in SQL for the checks.

Each ``fx_*`` function has a twin in ``SQL`` with the same columns.  Session
time is UTC; nanosecond stamps stay BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000
DAY_NS = 24 * HOUR_NS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ns(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) * F.lit(1000).cast("bigint")


def fx_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Messages: key ``k`` (recording), stream ``st``, stamp, value."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("k"),
        F.col("event_type").alias("st"),
        _ns("ts").alias("ts_ns"),
        F.col("value").alias("v"),
        "props",
    )


def fx_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points on a 100 x 10 plane; (seq, sub) is unique and gives arrival order."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("seq"),
        (F.col("l_partkey") * 1_000_000_000 + F.col("l_suppkey")).cast("bigint").alias("sub"),
        F.col("l_orderkey").alias("frame"),
        (F.pmod(F.col("l_partkey"), F.lit(1000)) / F.lit(10.0)).alias("x"),
        (F.pmod(F.col("l_suppkey"), F.lit(100)) / F.lit(10.0)).alias("y"),
        F.col("l_quantity").alias("z"),
        (F.col("l_discount") * 100 + F.lit(0.0)).alias("intensity"),
        (F.col("l_tax") * 100 + F.lit(0.0)).alias("tax"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"),
        _ns("l_shipdate").alias("ts_ns"),
    )


def fx_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """One tall u8 raster, 64 columns wide, cut into frames of 64 rows."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "e"))
    u8 = F.least(F.greatest((F.col("e").cast("double") + 1) * 127.5, F.lit(0.0)), F.lit(255.0)).cast("int")
    return e.select(
        F.floor(F.col("vec_id") / 64).cast("bigint").alias("frame"),
        F.pmod("vec_id", F.lit(64)).cast("int").alias("r"),
        F.col("pos").cast("int").alias("c"),
        F.col("vec_id").alias("rr"),
        F.col("label").alias("label"),
        u8.alias("v"),
    )


def fx_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Matched 2-D points: a scaled, turned and shifted copy with a small disturbance."""
    e = table(spark, sf, "embeddings")
    at = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    s = e.select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("g"), (at[0] * 100).alias("sx"), (at[1] * 100).alias("sy"), at[2].alias("n"))
    c, d = F.cos(F.lit(0.3)), F.sin(F.lit(0.3))
    return s.select(
        "id",
        "g",
        "sx",
        "sy",
        (1.5 * (c * F.col("sx") - d * F.col("sy")) + 400 + 0.1 * F.col("n")).alias("dx"),
        (1.5 * (d * F.col("sx") + c * F.col("sy")) + 5000 + 0.2 * F.col("n")).alias("dy"),
    )


def fx_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Detection-like rows: label per document, sensor by language, campaign by source."""
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))


SQL = {
    "fx_stream": """fx_stream AS (
  SELECT event_id AS seq, user_id AS k, event_type AS st, epoch_us(ts)*1000 AS ts_ns, value AS v, props FROM events)""",
    "fx_points": """fx_points AS (
  SELECT l_orderkey*10+l_linenumber AS seq, l_partkey*1000000000+l_suppkey AS sub, l_orderkey AS frame,
    (l_partkey%1000)/10.0::DOUBLE AS x, (l_suppkey%100)/10.0::DOUBLE AS y, l_quantity AS z,
    l_discount*100+0.0::DOUBLE AS intensity, l_tax*100+0.0::DOUBLE AS tax, l_extendedprice AS price,
    l_returnflag AS flag, epoch_us(l_shipdate)*1000 AS ts_ns FROM lineitem)""",
    "fx_pixels": """fx_pixels AS (
  SELECT vec_id//64 AS frame, (vec_id%64)::INT AS r, i::INT AS c, vec_id AS rr, label,
    trunc(least(greatest((e::DOUBLE+1)*127.5::DOUBLE,0),255))::INT AS v
  FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding,1)-1 AS i FROM embeddings))""",
    "fx_pairs": """fx_pairs AS (
  SELECT id, g, sx, sy, 1.5::DOUBLE*(cos(0.3::DOUBLE)*sx-sin(0.3::DOUBLE)*sy)+400+0.1::DOUBLE*n AS dx,
    1.5::DOUBLE*(sin(0.3::DOUBLE)*sx+cos(0.3::DOUBLE)*sy)+5000+0.2::DOUBLE*n AS dy
  FROM (SELECT vec_id AS id, label::BIGINT AS g, embedding[1]::DOUBLE*100 AS sx, embedding[2]::DOUBLE*100 AS sy, embedding[3]::DOUBLE AS n FROM embeddings))""",
    "fx_docs": """fx_docs AS (
  SELECT doc_id, lang, source, n_chars::BIGINT AS n_chars FROM documents)""",
}


def with_sql(body: str, *names: str, recursive: bool = False) -> str:
    """SQL text with the named views (and further CTEs given as text) in front."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL.get(n, n) for n in names) + "\n" + body
