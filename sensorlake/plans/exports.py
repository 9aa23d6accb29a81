"""Export of a recording window as typed streams: decoded rows, failures beside them, and a manifest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.operators.sampling import centred_window
from sensorlake.sources import decode, recordings


def typed_streams(imu: DataFrame, clouds: DataFrame, fixes: DataFrame, velocities: DataFrame, centre_ns: int | None, half_ns: int, gnss_mode: str = "georeference") -> dict[str, DataFrame]:
    """``imu, cloud, gnss, velocity`` as decoded tables of the window, each with its own columns.

    All have ``bag_id, ts_ns, seq, error`` (``seq`` of a cloud's point is its
    number in the cloud).  The window is cut before anything is decoded; without
    a centre everything is taken.  ``error`` says why a message gave no values;
    fixes that the GNSS rule does not want are left out, as everywhere.
    """

    def window(df: DataFrame, ts: str = "ts_ns") -> DataFrame:
        return df if centre_ns is None else centred_window(df, centre_ns, half_ns, ts)

    points = decode.explode_clouds(window(clouds, "cloud_ts"))
    moving = window(velocities).withColumn("speed_mps", recordings.speed())
    return {
        "imu": decode.decode_imu(window(imu)).withColumnRenamed("bag_ts_ns", "ts_ns"),
        "cloud": points.withColumnRenamed("cloud_ts", "ts_ns").withColumn("seq", F.col("i").cast("bigint")).drop("i"),
        "gnss": recordings.gnss_fixes(window(fixes), gnss_mode).withColumn("error", F.lit(None).cast("string")),
        "velocity": moving.withColumn("error", F.when(F.col("speed_mps").isNull(), "no twist")),
    }


def write_streams(streams: Mapping[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Write every stream once, partitioned by ``failed``, and return the tables read back.

    Tasks write where their rows are, so a recording with most of the rows is
    written by many tasks.  There are as many files as tasks, however many
    recordings there are: within a file the rows lie by recording and time, so
    reading one recording skips the others by the statistics of the row groups.
    """
    out = {}
    for name, df in streams.items():
        df = df.withColumn("failed", F.col("error").isNotNull())
        df.sortWithinPartitions("failed", "bag_id", "ts_ns").write.mode("overwrite").partitionBy("failed").parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
    return out


def stream_manifest(written: Mapping[str, DataFrame]) -> DataFrame:
    """``stream, bag_id, rows, failed, start_ns, end_ns`` of the written streams; the span is that of the good rows."""
    parts = []
    for name, df in written.items():
        good = F.when(~F.col("failed"), F.col("ts_ns"))
        parts.append(df.groupBy("bag_id").agg(F.count_if(~F.col("failed")).alias("rows"), F.count_if("failed").alias("failed"), F.min(good).alias("start_ns"), F.max(good).alias("end_ns")).select(F.lit(name).alias("stream"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
