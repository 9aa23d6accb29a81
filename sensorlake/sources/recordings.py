"""Manifests, recordings, message tables and the streams inside them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.sources import schemas as sc


def blank_to_null(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Session manifest CSV; blanks become NULL, numbers are cast, text columns stay text."""
    names = (*sc.MANIFEST_TEXT, *sc.MANIFEST_DOUBLE, *sc.MANIFEST_INT)
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("enforceSchema", False).csv(path, header=True)
    return clean_manifest(raw)


def clean_manifest(raw: DataFrame) -> DataFrame:
    """Typed manifest from all-text columns; counts may be written as decimals."""
    return raw.select(
        *[blank_to_null(c).alias(c) for c in sc.MANIFEST_TEXT],
        *[blank_to_null(c).try_cast("double").alias(c) for c in sc.MANIFEST_DOUBLE],
        *[F.coalesce(blank_to_null(c).try_cast("double"), F.lit(0.0)).cast("int").alias(c) for c in sc.MANIFEST_INT],
    )


SENSORS = ("rgb", "vis", "nir", "thermal_c")


def select_recordings(
    manifest: DataFrame, include_all: bool = False, include_test: bool = False, label: str | None = None, sensors: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Default recordings only, without test rows, optionally by label part and with messages of the given sensors."""
    unknown = [s for s in sensors if s not in SENSORS]
    if unknown:
        raise ValueError(f"unknown sensors {unknown}")
    d = manifest
    if not include_all:
        d = d.where(F.lower("include_default") == "yes")
    if not include_test:
        d = d.where(~F.lower(F.coalesce("label_norm", F.lit(""))).contains("test"))
    if label:
        d = d.where(F.lower("label_norm").contains(label.lower()))
    for s in sensors:
        d = d.where(F.col(f"{s}_msgs") > 0)
    return d if limit is None else d.orderBy("bag").limit(limit)


#: Tasks per core that take up the names of found files.
LISTING_TASKS = 4


def find_recordings(spark: SparkSession, path: str, pattern: str = "*.bag") -> DataFrame:
    """Distinct recording files below a folder (names and sizes only; contents are not read).

    Spark plans a partition for every few files, whatever their size; as names
    are all that is taken, many of them go to one task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length").coalesce(LISTING_TASKS * spark.sparkContext.defaultParallelism).distinct()


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Message table partitioned by recording and topic."""
    return spark.read.schema(sc.MESSAGES).parquet(path)


def select_topics(messages: DataFrame, topics: Mapping[str, str], required: bool = False) -> DataFrame:
    """Messages of the wanted topics with their ``sensor`` name; the topic list reaches the scan.

    ``required`` fails the job when a wanted topic has no message at all.
    """
    d = messages.where(F.col("topic").isin(*topics))
    name = F.coalesce(*[F.when(F.col("topic") == t, F.lit(s)) for t, s in topics.items()])
    if required:
        found = d.agg(F.count_distinct("topic").alias("n")).select(F.assert_true(F.col("n") == len(topics), F.lit("a required topic has no messages")).isNull().alias("ok"))
        d = d.where(found.scalar())
    return d.withColumn("sensor", name)


def header_stamp(sec: Column, nanosec: Column, fallback: Column, zero_is_missing: bool = True) -> Column:
    """Header stamp in ns, or the recording's stamp when missing (and, by choice, when not positive)."""
    t = sec.cast("bigint") * F.lit(1_000_000_000).cast("bigint") + nanosec.cast("bigint")
    return F.coalesce(F.when(t > 0, t) if zero_is_missing else t, fallback)


def split_stamp(ts: Column) -> Column:
    """STRUCT<sec, nanosec> of integer nanoseconds."""
    g = F.lit(1_000_000_000).cast("bigint")
    return F.struct(F.call_function("div", ts - F.pmod(ts, g), g).alias("sec"), F.pmod(ts, g).cast("int").alias("nanosec"))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text of integer nanoseconds (display only)."""
    return F.date_format(F.timestamp_micros(F.call_function("div", ts, F.lit(1000).cast("bigint"))), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def gnss_fixes(df: DataFrame, mode: str = "georeference") -> DataFrame:
    """Usable fixes of ``lat, lon, alt, status``.

    ``georeference`` wants a status of at least 0 and all three values finite;
    ``index`` wants latitude and longitude only and turns a non-finite altitude
    into NULL.
    """
    lat, lon, alt = F.col("lat"), F.col("lon"), F.col("alt")
    if mode == "georeference":
        return df.where((F.col("status") >= 0) & _finite(lat) & _finite(lon) & _finite(alt))
    if mode != "index":
        raise ValueError(f"unknown mode {mode}")
    return df.where(_finite(lat) & _finite(lon)).withColumn("alt", F.when(_finite(alt), alt))


def speed(twist: str = "twist") -> Column:
    """Norm of the linear velocity, NULL without a twist."""
    x, y, z = (F.col(f"{twist}.linear.{a}") for a in "xyz")
    return F.sqrt(x * x + y * y + z * z)


ODOMETRY = {
    "stamp_ns": "field.header.stamp",
    **{a: f"field.pose.pose.position.{a}" for a in "xyz"},
    **{f"q{a}": f"field.pose.pose.orientation.{a}" for a in "xyzw"},
}


def read_odometry(spark: SparkSession, path: str, stamp_through_double: bool = False) -> DataFrame:
    """Pose CSV with dotted headers as ``stamp_ns, x, y, z, qx, qy, qz, qw``.

    Stamps are read as integers; ``stamp_through_double`` reproduces readers
    that parse them as floating point first and lose the last digits.
    """
    raw = spark.read.csv(path, header=True)
    stamp = F.trim(F.col(f"`{ODOMETRY['stamp_ns']}`"))
    exact = F.coalesce(stamp.try_cast("bigint"), stamp.try_cast("double").cast("bigint"))
    first = stamp.cast("double").cast("bigint") if stamp_through_double else exact
    return raw.select(first.alias("stamp_ns"), *[F.col(f"`{c}`").cast("double").alias(n) for n, c in ODOMETRY.items() if n != "stamp_ns"])


def read_odometry_checked(spark: SparkSession, path: str) -> DataFrame:
    """Pose rows like :func:`read_odometry` with ``path``, ``error`` and the ``line`` of bad rows.

    A number that is missing, unreadable or not finite makes its field NULL and is
    named in ``error``; so is a line with too few or too many fields. All rows stay, good ones with a NULL error.
    """
    header = spark.read.csv(path, header=True).columns
    schema = ", ".join(f"`{c}` string" for c in [*header, "_line"])
    raw = spark.read.schema(schema).csv(path, header=True, columnNameOfCorruptRecord="_line").select("*", F.col("_metadata.file_path").alias("path"))
    text = {n: F.trim(F.col(f"`{c}`")) if c in header else F.lit(None).cast("string") for n, c in ODOMETRY.items()}
    typed = {n: t.try_cast("double") for n, t in text.items()}
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    typed = {n: finite(v) for n, v in typed.items()}
    typed["stamp_ns"] = F.coalesce(text["stamp_ns"].try_cast("bigint"), typed["stamp_ns"].try_cast("bigint"))
    bad = F.concat_ws(",", *[F.when(v.isNull(), n) for n, v in typed.items()], F.when(F.col("_line").isNotNull(), "line"))
    return raw.select(*[v.alias(n) for n, v in typed.items()], "path", F.when(bad != "", bad).alias("error"), F.col("_line").alias("line"))


# Fixed value: smallest number taken for a nanosecond stamp in a file name.
MIN_STAMP_IN_NAME = 1_000_000_000_000


def stamp_from_name(path: Column) -> Column:
    """Last underscore-separated number of the file stem that is large enough to be a stamp."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    nums = F.transform(F.split(stem, "_"), lambda s: s.try_cast("bigint"))
    return F.try_element_at(F.filter(nums, lambda v: v > MIN_STAMP_IN_NAME), F.lit(-1))


def frame_index(raw: DataFrame) -> DataFrame:
    """Extracted-frame index from all-text columns: recording falls back to the file stem, stamp to the file name."""
    blank = lambda c: blank_to_null(c) if c in raw.columns else F.lit(None).cast("string")
    stem = F.regexp_replace(F.element_at(F.split(blank("bag"), "/"), -1), r"\.[^.]*$", "")
    return raw.select(
        F.coalesce(blank("bag_id"), stem).alias("bag_id"),
        blank("sensor").alias("sensor"),
        F.coalesce(blank("frame_index").try_cast("int"), F.lit(0)).alias("frame_index"),
        F.coalesce(blank("stamp_ns").try_cast("bigint"), stamp_from_name(blank("image_path"))).alias("ts_ns"),
        blank("image_path").alias("image_path"),
    )


def read_frame_index(spark: SparkSession, folder: str) -> DataFrame:
    return frame_index(spark.read.csv(f"{folder}/metadata/frames.csv", header=True))


REVIEW_FILES = {"rgb.jpg": "rgb", "vis.jpg": "vis", "nir.jpg": "nir", "thermal_c.jpg": "thermal"}


def review_sets(listing: DataFrame) -> DataFrame:
    """Folders of a ``path`` listing that hold all four sensor files, with one path per sensor."""
    parts = F.split("path", "/")
    name, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    sensor = F.coalesce(*[F.when(name == f, F.lit(s)) for f, s in REVIEW_FILES.items()])
    d = listing.select("path", folder.alias("frame_id"), sensor.alias("sensor")).where(F.col("sensor").isNotNull())
    g = d.groupBy("frame_id").agg(*[F.min(F.when(F.col("sensor") == s, F.col("path"))).alias(s) for s in REVIEW_FILES.values()])
    return g.dropna(subset=list(REVIEW_FILES.values()))


def read_frame_sets(spark: SparkSession, folder: str, layout: str = "auto"):
    """Index rows (``extracted``) or complete folders (``review``); ``auto`` takes the index when it exists."""
    def listing(glob: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path")

    if layout == "auto":
        has = not listing("frames.csv").where(F.col("path").endswith("/metadata/frames.csv")).isEmpty()
        layout = "extracted" if has else "review"
    return read_frame_index(spark, folder) if layout == "extracted" else review_sets(listing("*.jpg"))
