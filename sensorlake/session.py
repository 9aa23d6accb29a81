"""Session settings the library relies on, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "sensorlake", cpus: str = "8", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared folder in ``spark.checkpoint.dir``.

    A path without a scheme lies on Spark's default file system, as everywhere
    in Spark. Without that setting the folder is below the warehouse, which all
    executors share too; a local session (tests) gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_cut"
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared checkpoint folder and read on from there.

    The written table survives lost executors, is computed once however often
    it is used, and has a measured size, so joins with it are planned by size.
    """
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
