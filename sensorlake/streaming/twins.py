"""Streaming forms of the main time-based operators; each gives the batch result once the watermark has passed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_time(df: DataFrame, ts: str = "ts_ns", name: str = "event_time") -> DataFrame:
    """Add a TIMESTAMP column for watermarks; the nanosecond stamp stays as it is."""
    return df.withColumn(name, F.timestamp_micros(F.call_function("div", F.col(ts), F.lit(1000).cast("bigint"))))


def rate_monitor(stream: DataFrame, keys: list[str], value: str, window: str, delay: str) -> DataFrame:
    """Count, mean rate, mean and population deviation per key and window, emitted when the window is complete."""
    d = event_time(stream).withWatermark("event_time", delay)
    g = d.groupBy(F.window("event_time", window), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")
    )
    span = (F.col("last_ns") - F.col("first_ns")) / F.lit(1e9)
    return g.select(F.col("window.start").alias("start"), *keys, "n", F.when(span > 0, (F.col("n") - 1) / span).alias("rate_hz"), "mean", "std")


def nearest_stream_join(left: DataFrame, right: DataFrame, key: str, tolerance: str, tolerance_ns: int, delay: str) -> DataFrame:
    """Nearest right row within the tolerance for each left row of two streams (``ts_ns, seq``).

    A watermarked interval join keeps only the rows that can still match; the
    minimum per left row is a second stateful step, emitted once the watermark
    has passed its last possible match.  Unmatched left rows come with NULLs.
    """
    a = event_time(left, name="l_time").withWatermark("l_time", delay).select(F.col(key).alias("l_key"), F.col("ts_ns").alias("l_ts"), F.col("seq").alias("l_seq"), "l_time")
    b = event_time(right, name="r_time").withWatermark("r_time", delay).select(F.col(key).alias("r_key"), F.col("ts_ns").alias("r_ts"), F.col("seq").alias("r_seq"), "r_time")
    wide = F.expr(f"l_key = r_key AND r_time >= l_time - INTERVAL {tolerance} - INTERVAL 1 MILLISECOND AND r_time <= l_time + INTERVAL {tolerance} + INTERVAL 1 MILLISECOND")
    j = a.join(b, wide, "leftOuter")
    dt = F.abs(F.col("r_ts") - F.col("l_ts"))
    hit = F.when(dt <= tolerance_ns, F.struct(dt.alias("dt_ns"), "r_ts", "r_seq"))
    g = j.groupBy("l_time", "l_key", "l_ts", "l_seq").agg(F.min(hit).alias("_h"))
    return g.select(F.col("l_key").alias(key), F.col("l_ts").alias("ts_ns"), F.col("l_seq").alias("seq"), "_h.dt_ns", F.col("_h.r_ts").alias("r_ts_ns"), "_h.r_seq")


#: Keys share this many groups of state. A checkpoint belongs to the number it was written with.
STATE_GROUPS = 1024

_KEY = ["bag", "sensor"]
_OUT = [*_KEY, "seq", "ts_ns", "idx", "quality", "kind"]


def _packed(pdf: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_all().to_pandas()


class _IndexAndBest(StatefulProcessor):
    """Per group of keys: the rows still open to reordering, a counter and the N best rows of each key.

    Every call to the state store is a message to the JVM, so rows go there as
    one packed table a batch and all keys of a group are released together.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.best = handle.getValueState("best", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, blobs = None, []
        for pdf in rows:
            if len(pdf):
                blobs.append((_packed(pdf[[*_KEY, "ts_ns", "seq", "quality"]]),))
                low = int(pdf["ts_ns"].min()) // 1_000_000 + 1
                first = low if first is None else min(first, low)
        if first is not None:
            self.waiting.appendList(blobs)
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1_000_000
        blobs = [_unpacked(bytes(b)) for (b,) in self.waiting.get()]
        if not blobs:
            return
        rows = pd.concat(blobs, ignore_index=True)
        later, ready = rows[rows["ts_ns"] >= mark], rows[rows["ts_ns"] < mark]
        if not len(ready):
            return
        ready = ready.sort_values(["ts_ns", "seq", "quality"]).reset_index(drop=True)
        by_key = ready.groupby(_KEY, dropna=False, sort=False)
        ready["idx"] = by_key.cumcount().astype("int64")
        new = by_key.size().rename("n").reset_index()
        if self.counter.exists():
            known = _unpacked(bytes(self.counter.get()[0]))
            before = ready[_KEY].merge(known, on=_KEY, how="left")["n"].fillna(0).astype("int64")
            ready["idx"] += before.to_numpy()
            total = pd.concat([known, new]).groupby(_KEY, dropna=False, sort=False)["n"].sum().reset_index()
            held = _unpacked(bytes(self.best.get()[0]))
        else:
            total, held = new, ready.iloc[:0]
        best = pd.concat([held, ready[held.columns]] if len(held) else [ready]).sort_values(["quality", "idx"], ascending=[False, True])
        best = best[best.groupby(_KEY, dropna=False, sort=False).cumcount() < self.keep].reset_index(drop=True)
        self.counter.update((_packed(total),))
        self.best.update((_packed(best),))
        if len(later):
            self.waiting.put([(_packed(later),)])
            self.handle.registerTimer(int(later["ts_ns"].min()) // 1_000_000 + 1)
        else:
            self.waiting.clear()
        rank = best.groupby(_KEY, dropna=False, sort=False).cumcount() + 1
        lists = best.assign(kind="best_" + rank.astype(str)).drop(columns="idx").merge(new[_KEY], on=_KEY).merge(total.rename(columns={"n": "idx"}), on=_KEY)
        yield ready.assign(kind="frame")[_OUT]
        yield lists[_OUT]

    def close(self) -> None:
        pass


def index_and_best(stream: DataFrame, keep: int, delay: str) -> DataFrame:
    """Running index of each row per (bag, sensor), and the ``keep`` best rows so far after every release.

    Rows wait in state until the watermark has passed them, so disorder within
    the delay does not change the index.  ``kind`` is ``frame`` (``idx`` is the
    running index) or ``best_<rank>`` (``idx`` is the number of rows released
    so far; the largest one per key is the current list).
    """
    d = event_time(stream).withWatermark("event_time", delay).withColumn("_group", F.pmod(F.xxhash64(*_KEY), F.lit(STATE_GROUPS)))
    return d.groupBy("_group").transformWithStateInPandas(
        statefulProcessor=_IndexAndBest(keep),
        outputStructType="bag string, sensor string, seq bigint, ts_ns bigint, idx bigint, quality double, kind string",
        outputMode="Append",
        timeMode="EventTime",
    )
