"""Small helpers that several operators of this package share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word: what ASCII white space separates. ``bytes.split()`` cuts at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    return text_bytes(text).split()


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str | StructType) -> DataFrame:
    """``fn`` turns the columns of a batch (Arrow arrays by name) into columns by name; batches stay bounded by Spark's Arrow settings."""
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn({n: c for n, c in zip(b.schema.names, b.columns)})
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def packed(df: DataFrame, *names: str | Column) -> DataFrame:
    """``row`` with all columns of ``df`` as one struct, and the named columns beside it: whatever else ``df`` has cannot clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *names)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def ranked(key: str) -> Column:
    """A repeatable pseudo-random order of rows by an id."""
    return F.xxhash64(F.lit(17), F.col(key))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled documents, drawn by a hash of doc_id.

    The ids are at most ``bound`` longs, so the join with the texts may broadcast them.
    Rows without an id or a label never take part; of repeated labels the larger counts.
    """
    ids = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = ids.orderBy(ranked("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
