"""Nested JSON documents: detections, homographies, camera models, plot polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sensorlake.functions.labels import label_of
from sensorlake.sources import schemas as sc


def read_detections(spark: SparkSession, path: str | None, source: str) -> DataFrame:
    """Detection rows of a results document; a missing optional document gives no rows."""
    if path is None:
        return flatten_detections(spark.createDataFrame([], sc.DETECTION_DOCUMENT), source)
    return flatten_detections(spark.read.schema(sc.DETECTION_DOCUMENT).json(path, multiLine=True), source)


def parse_detections(texts: DataFrame) -> DataFrame:
    """``path, results, error`` of whole detection documents (``path, text``).

    A document is taken whole or not at all: ``error`` says why one is not read
    (empty, unreadable as JSON of the expected types, or without results), and its ``results`` are NULL.
    """
    schema = StructType([*sc.DETECTION_DOCUMENT.fields, StructField("_broken", StringType())])
    d = F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    d = texts.select("path", d.alias("_d"), blank.alias("_blank"))
    error = F.when(F.col("_blank"), "empty document").when(F.col("_d").isNull() | F.col("_d._broken").isNotNull(), "unreadable document").when(F.col("_d.results").isNull(), "no results")
    d = d.withColumn("error", error)
    return d.select("path", F.when(F.col("error").isNull(), F.col("_d.results")).alias("results"), "error")


def read_detections_checked(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Detection rows of all readable documents below ``path``, one file each, and ``path, error`` of the others."""
    return checked_detections(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), source)


def checked_detections(texts: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """The same of whole documents in a table (``path, text``): many documents need no folder and file each."""
    d = parse_detections(texts)
    return flatten_detections(d.where("error IS NULL"), source), d.where("error IS NOT NULL").select("path", "error")


def flatten_detections(docs: DataFrame, source: str) -> DataFrame:
    """One row per result and sensor with typed corners and pattern."""
    r = docs.select(F.inline("results"))
    d = r.select(label_of(F.col("label_norm"), F.col("label_raw"), F.col("bag")).alias("label"), "bag", F.explode("detections").alias("sensor", "d"))
    corners = F.transform("d.corners_px", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    pattern = F.col("d.pattern_internal_corners")
    return d.select(
        "label", "bag", "sensor", F.lit(source).alias("source"), F.coalesce("d.checker_detected", F.lit(False)).alias("detected"),
        F.col("d.method").alias("method"), F.col("d.confidence").alias("confidence"), F.col("d.frame_index").alias("frame_index"), F.col("d.stamp_ns").alias("stamp_ns"),
        F.coalesce("d.score", "d.quality").alias("score"), F.col("d.rotation_ok").alias("rotation_ok"),
        F.get(pattern, F.lit(0)).alias("cols"), F.get(pattern, F.lit(1)).alias("rows"), corners.alias("corners"), F.col("d.panel_box_xyxy").alias("panel_box"),
    )


def matrix_row(m: Column, n: int) -> Column:
    """Row-major ARRAY<DOUBLE> of an n x n nested array; NULL when the shape or a value is wrong."""
    square = (F.size(m) == n) & F.forall(m, lambda r: (F.size(r) == n) & F.forall(r, lambda v: v.isNotNull() & ~F.isnan(v)))
    return F.when(F.coalesce(square, F.lit(False)), F.flatten(m))


def flatten_homographies(docs: DataFrame) -> DataFrame:
    """``name, h`` rows of a homography document."""
    return docs.select(F.explode("homographies").alias("name", "m")).select("name", matrix_row(F.col("m"), 3).alias("h")).where(F.col("h").isNotNull())


def read_homographies(spark: SparkSession, path: str) -> DataFrame:
    return flatten_homographies(spark.read.schema(sc.HOMOGRAPHY_DOCUMENT).json(path, multiLine=True))


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """``sensor, k, dist, width, height`` of a camera document (``intrinsics`` keyed by sensor)."""
    schema = "intrinsics map<string, struct<K: array<array<double>>, dist_coeffs: array<double>, resolution_px: array<int>>>"
    d = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("intrinsics").alias("sensor", "i"))
    return d.select("sensor", matrix_row(F.col("i.K"), 3).alias("k"), F.coalesce("i.dist_coeffs", F.array(*[F.lit(0.0)] * 5)).alias("dist"), F.get("i.resolution_px", F.lit(0)).alias("width"), F.get("i.resolution_px", F.lit(1)).alias("height"))


def initial_intrinsics(frames: DataFrame, known: DataFrame) -> DataFrame:
    """Start values per frame set (``sensor, width, height``): the known camera, or a guess from the image size.

    A known camera is ignored, with a reason, when its resolution differs.
    """
    k = known.select("sensor", F.col("k").alias("_k"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    d = frames.join(k, "sensor", "left")
    same = (F.col("_w") == F.col("width")) & (F.col("_h") == F.col("height"))
    f = 1.4 * F.greatest("width", "height")
    guess = F.array(f, F.lit(0.0), F.col("width") / 2.0, F.lit(0.0), f, F.col("height") / 2.0, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    reason = F.when(F.col("_k").isNull(), "no_initial_intrinsics").when(~same, "resolution_differs").otherwise("initial_intrinsics")
    return d.select(*frames.columns, F.when(F.coalesce(same, F.lit(False)) & F.col("_k").isNotNull(), F.col("_k")).otherwise(guess).alias("k"), reason.alias("reason"))


def plots_from_rings(raw: DataFrame, order: str) -> DataFrame:
    """Plot layer with 1-based text ids in layer order, ``pos``, and the trimmed attribute names."""
    from sensorlake.operators.ordered import running_index

    d = raw.select(*[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns])
    d = running_index(d, [], [order], "pos")
    return d.withColumn("plot_id", (F.col("pos") + 1).cast("string"))


_POINTS = "array<array<double>>"


def read_plots(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON polygons as ``pos, plot_id, ring, rings`` plus their properties.

    ``rings`` holds every ring of a Polygon or MultiPolygon, holes included;
    ``ring`` is the first outer one.  Other geometries have neither.
    """
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string,string>>>"
    d = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("pos", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    raw = F.when(kind == "Polygon", F.from_json(text, f"array<{_POINTS}>")).when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<array<{_POINTS}>>")))
    # a GeoJSON ring repeats its first point
    points = lambda r: F.transform(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    d = d.withColumn("rings", F.transform(raw, points))
    return d.select("pos", (F.col("pos") + 1).cast("string").alias("plot_id"), F.get("rings", F.lit(0)).alias("ring"), "rings", F.transform_keys("f.properties", lambda k, _: F.trim(k)).alias("properties"))
