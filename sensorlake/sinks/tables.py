"""Writers: frame tables, stream tables, raster layers, GeoJSON, run documents, compact calibration tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.operators.merging import union_sources
from sensorlake.operators.ordered import running_index


def union_sorted(*parts: DataFrame) -> DataFrame:
    """All rows under the sorted union of all columns."""
    d = union_sources(*parts)
    return d.select(*sorted(d.columns))


def write_frame_table(parts: Sequence[DataFrame], path: str, fmt: str = "parquet") -> None:
    w = union_sorted(*parts).write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def feature_points(df: DataFrame, lon: str = "gps_lon", lat: str = "gps_lat") -> DataFrame:
    """GeoJSON features (one text line each) of rows with coordinates; the other columns become properties."""
    props = [c for c in df.columns if c not in (lon, lat)]
    geom = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates"))
    f = F.struct(F.lit("Feature").alias("type"), geom.alias("geometry"), F.struct(*props).alias("properties"))
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.to_json(f).alias("value"))


def feature_lines(df: DataFrame, keys: Sequence[str], order: Sequence[str], lon: str, lat: str, part_len: int = 10_000, rows_per_chunk: int | None = None) -> DataFrame:
    """One LineString feature per key with at least two vertices, in track order.

    Stretches of ``part_len`` vertices become text in parallel; a track's line
    is those texts in order, so only the text of one feature meets in a task.
    """
    args = {} if rows_per_chunk is None else {"rows_per_chunk": rows_per_chunk}
    d = running_index(df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()), keys, order, "_i", **args)
    part = F.call_function("div", F.col("_i"), F.lit(part_len).cast("bigint"))
    in_order = lambda at, what: F.transform(F.array_sort(F.collect_list(F.struct(at, what))), lambda s: s["p"])
    pts = in_order("_i", F.array(F.col(lon), F.col(lat)).alias("p"))
    g = d.withColumn("part", part).groupBy(*keys, "part").agg(pts.alias("_c"))
    text = F.to_json("_c")
    g = g.select(*keys, "part", F.size("_c").alias("_n"), F.substring(text, F.lit(2), F.length(text) - 2).alias("p"))
    g = g.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.array_join(in_order("part", "p"), ",").alias("_t")).where("_n > 1")
    head, tail = '{"type":"Feature","geometry":{"type":"LineString","coordinates":[', ']},"properties":'
    return g.select(*keys, F.concat(F.lit(head), "_t", F.lit(tail), F.to_json(F.struct(*keys)), F.lit("}")).alias("value"))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON."""
    features.select("value").write.mode("overwrite").text(path)


def stream_table(messages: DataFrame, bag: str = "bag_id", topic: str = "topic", rows_per_chunk: int | None = None) -> DataFrame:
    """Rows with a running ``index`` per recording and topic in time order."""
    args = {} if rows_per_chunk is None else {"rows_per_chunk": rows_per_chunk}
    return running_index(messages, [bag, topic], ["ts_ns", "seq"], "index", **args)


def write_stream_tables(messages: DataFrame, topics: Mapping[str, str], path: str) -> None:
    """One table per topic, partitioned by recording and sorted by time within files."""
    d = stream_table(messages)
    for topic, name in topics.items():
        part = d.where(F.col("topic") == topic).drop("topic")
        part.repartition("bag_id").sortWithinPartitions("bag_id", "ts_ns").write.mode("overwrite").partitionBy("bag_id").parquet(f"{path}/{name}")


def raster_layers(cells: DataFrame, layers: Mapping[str, str], row: str = "row", col: str = "col") -> DataFrame:
    """Long form ``layer, row, col, value`` of the named value columns, without missing values."""
    arr = F.array(*[F.struct(F.lit(n).alias("layer"), F.col(c).cast("double").alias("value")) for n, c in layers.items()])
    d = cells.select(F.col(row).alias("row"), F.col(col).alias("col"), F.explode(arr).alias("_l"))
    return d.select("_l.layer", "row", "col", "_l.value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def write_raster(cells: DataFrame, meta: DataFrame, layers: Mapping[str, str], path: str, epsg: int, nodata: float = -9999.0) -> None:
    raster_layers(cells, layers).write.mode("overwrite").partitionBy("layer").parquet(f"{path}/cells")
    meta.select("*", F.lit(epsg).alias("epsg"), F.lit(nodata).alias("nodata")).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def run_summary(df: DataFrame, parts: Mapping[str, Column]) -> DataFrame:
    """One JSON line with the named aggregates."""
    return df.agg(F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])).alias("value"))


def compact_calibration(intrinsics: DataFrame, homographies: DataFrame, stereo: DataFrame) -> DataFrame:
    """``block, sensor, status, n_views_or_pairs, rms_or_median_px, notes`` of the three result tables."""
    cols = ["sensor", "status", F.col("n").alias("n_views_or_pairs"), F.col("error_px").alias("rms_or_median_px"), "notes"]
    parts = [d.select(F.lit(b).alias("block"), *cols) for b, d in (("intrinsics", intrinsics), ("homography_to_rgb", homographies), ("stereo_to_rgb", stereo))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_missing(todo: DataFrame, path: str, label: str = "label") -> None:
    """Append results for labels not yet stored; each label is its own partition, so a rerun replaces only itself."""
    todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(label).parquet(path)
