"""Running a streaming query over what is there now and reading back what it emitted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType

from sensorlake.session import shared_folder


def _run(df: DataFrame, root: str, mode: str) -> None:
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input once, write the emitted rows as files, and return them as a table."""
    spark = df.sparkSession
    root = shared_folder(spark, "stream")
    _run(df, root, mode)
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def run_whole(streams: list[DataFrame], build: Callable[..., DataFrame], last_ns: int | None, horizon_ns: int, ts: str = "ts_ns", mode: str = "append") -> DataFrame:
    """Like ``run_available`` of ``build(*streams)``, with all state emitted: the input is whole and no row is to follow.

    Each stream is united with one that is empty until all its input is
    processed. Then it brings one closing row, ``horizon_ns`` after the last
    stamp ``last_ns``, and the query goes on from its checkpoint. The horizon
    has to exceed delay, windows and tolerances together; the closing rows
    themselves stay behind the watermark and are never emitted.
    """
    spark = streams[0].sparkSession
    root, marks = shared_folder(spark, "stream"), shared_folder(spark, "closing")
    for i, s in enumerate(streams):
        spark.createDataFrame([], s.schema).write.parquet(f"{marks}/{i}")
    df = build(*[s.unionByName(spark.readStream.schema(s.schema).parquet(f"{marks}/{i}")) for i, s in enumerate(streams)])
    _run(df, root, mode)
    if last_ns is not None:
        for i, s in enumerate(streams):
            zero = {"double": 0.0, "float": 0.0}
            row = tuple(last_ns + horizon_ns if f.name == ts else zero.get(f.dataType.typeName(), 0) if isinstance(f.dataType, NumericType) else None for f in s.schema)
            spark.createDataFrame([row], s.schema).coalesce(1).write.mode("append").parquet(f"{marks}/{i}")
        _run(df, root, mode)
    return spark.read.schema(df.schema).parquet(f"{root}/out")
