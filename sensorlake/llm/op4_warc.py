"""WARC archives with revisit records.

Headers (id, digest, length) are shuffled by payload digest; the smallest id of
a digest is the original response, the others become revisits that refer to it.
Records get fresh headers and are written as WARC 1.1 files by Spark's text
writer (a record ends with CRLF CRLF, which is the writer's line separator), and
read back record by record with the lengths that the headers state.

* null payload: the empty payload
* payloads below ``least`` bytes are always responses
* rows that share the smallest id of a digest are all responses
* null id: comes after every other id; if a digest has no other, its rows are responses
* other columns are untouched and may have any name
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm.common import table
from sensorlake.session import shared_folder

LEAST_BYTES = 100
CRLF = "\r\n"
#: Names of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"
RECORD_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def headers_of(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, digest, bytes): what is known of a record without its payload."""
    data = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(F.col(key).alias("page_id"), F.sha2(data.cast("binary"), 256).alias("digest"), F.octet_length(data).cast("long").alias("n_bytes"))


def resolve_revisits(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(digest, original) of the digests that several records share; counted and reduced before the shuffle."""
    seen = headers.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    return seen.where(F.col("n") > 1).select("digest", "original")


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    head = F.concat(F.lit("WARC/1.1" + CRLF), *[F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(CRLF)) for k, v in fields], F.lit(CRLF))
    return F.concat(head, block)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", payload: str = "html", url: str = "url", least: int = LEAST_BYTES) -> None:
    """Writes gzipped WARC files below ``path``, one or more per task.

    Payloads move once: they meet the originals on their digest. A digest that very
    many pages share is a skewed key of that join, which Spark splits on the page side.
    """
    originals = resolve_revisits(headers_of(pages, key, payload), least)
    data = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), data.alias("data"), F.sha2(data.cast("binary"), 256).alias("digest"))
    rows = rows.join(originals, "digest", "left")
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    rid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    length = F.octet_length("data")
    common = [("WARC-Record-ID", rid(F.col("page_id"))), ("WARC-Date", F.lit(RECORD_DATE)), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Payload-Length", length)]
    response = _record([("WARC-Type", F.lit("response")), *common, ("Content-Type", F.lit("text/html")), ("Content-Length", length)], F.col("data"))
    revisit = _record([("WARC-Type", F.lit("revisit")), *common, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", rid(F.col("original"))), ("Content-Length", F.lit(0))], F.lit(""))
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    rows.select(F.when(again, revisit).otherwise(response).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


class _Stream:
    """The bytes of a gzipped file, inflated as far as they are asked for."""

    STEP = 1 << 20

    def __init__(self, packed: bytes):
        self.packed, self.at, self.buffer = packed, 0, b""
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        while not self.inflate.eof or self.at < len(self.packed):
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            piece = self.inflate.unconsumed_tail or self.packed[self.at : self.at + self.STEP]
            if not self.inflate.unconsumed_tail:
                if not piece:
                    return False
                self.at += len(piece)
            out = self.inflate.decompress(piece, 4 * self.STEP)
            if self.inflate.unused_data:
                self.at -= len(self.inflate.unused_data)
            if out:
                self.buffer += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        out, self.buffer = self.buffer[:i], self.buffer[i + len(mark) :]
        return out

    def digest(self, n: int) -> str:
        """SHA-256 of the next ``n`` bytes."""
        h = hashlib.sha256()
        while n:
            if not self.buffer and not self._more():
                raise ValueError("a WARC record is shorter than its Content-Length")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            h.update(part)
            n -= len(part)
        return h.hexdigest()

    def skip(self, expected: bytes) -> None:
        while len(self.buffer) < len(expected) and self._more():
            pass
        if not self.buffer.startswith(expected):
            raise ValueError("a WARC record does not end where its Content-Length says")
        self.buffer = self.buffer[len(expected) :]


def parse_records(packed: bytes) -> Iterator[dict]:
    """One row per record; checks the length and digest that the header states."""
    s = _Stream(packed)

    def page(value: str | None) -> int | None:
        inner = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return None if inner in ("", "null") else int(inner)

    while (head := s.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode("utf-8", "replace").split(CRLF)
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        f = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        block = s.digest(int(f["Content-Length"]))
        s.skip(b"\r\n\r\n")
        stated = f["WARC-Payload-Digest"].removeprefix("sha256:")
        if f["WARC-Type"] == "response" and block != stated:
            raise ValueError(f"payload of {f['WARC-Record-ID']} does not match its digest")
        yield {"page_id": page(f["WARC-Record-ID"]), "payload_bytes": int(f["WARC-Payload-Length"]), "payload_digest": stated, "record_type": f["WARC-Type"], "refers_to": page(f.get("WARC-Refers-To"))}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORD_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b.column("content"):
                rows = []
                for r in parse_records(packed.as_py()):
                    rows.append(r)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: writes all of ``pages`` as archives in the shared folder, then reads those."""
    path = shared_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
FROM o
"""
