"""Secret scans with an incremental ledger of blobs.

Every version of a document is addressed by the SHA-256 of its text. A blob is
scanned once per rule version: pairs of blob and rule version that the ledger
holds already are left out, new findings are added to it, and findings are
joined back to every path (here: document) whose content has that address.

* null text: the empty blob; no finding
* rows that share an id: each row is a path of its own
* copies of one text, however many: scanned once, the group is never gathered
* other columns are untouched and may have any name
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sensorlake.llm.common import map_rows, packed, sha256_hex, table
from sensorlake.session import cut_lineage

RULES_VERSION = "2024-1"

# The rules. Kinds in the order that breaks ties of start.
BASE = ("assign", "access", "hex")
EXTRA = ("pem", "urlauth")
KINDS = BASE + EXTRA
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
#: Credentials in a URL: a scheme (lower-case letter first), ``://``, and this.
URLAUTH = re.compile(r"[^\s/:@]+:[^\s/:@]+@")
SCHEME_REST = "0123456789+.-"
SCHEME = "abcdefghijklmnopqrstuvwxyz" + SCHEME_REST
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def url_credentials(text: str) -> list[tuple[int, int]]:
    """(start, end) of URLs with credentials. Each ``://`` looks back over its own scheme only, so the work grows with the text, however long its runs."""
    found, at, before = [], text.find("://"), 0
    while at >= 0:
        run = text[before:at]
        scheme = run[len(run.rstrip(SCHEME)) :].lstrip(SCHEME_REST)
        rest = URLAUTH.match(text, at + 3) if scheme else None
        if rest:
            found.append((at - len(scheme), rest.end()))
        before = rest.end() if rest else at + 3
        at = text.find("://", before)
    return found


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed.

    ``AKIA`` with 16 or more characters behind it, and 24 or more hex digits, are
    the maximal runs of the rules that are long enough: a shorter run fails as a whole.
    """
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [(m.start(), m.end(), 3) for m in PEM.finditer(text)]
    if "://" in text:
        found += [(s, e, 4) for s, e in url_credentials(text)]
    found.sort(key=lambda f: (f[0], f[2], f[1]))
    return [(s, e, KINDS[k]) for s, e, k in found]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, text) to one finding row per blob: counts, digest of the base spans, all spans."""

    def run(c: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for t in c["text"]:
            spans = find(t.as_py())
            base = [s for s in spans if s[2] in BASE]
            for k in BASE:
                out[f"n_{k}"].append(sum(s[2] == k for s in base))
            out["base_sha256"].append(sha256_hex(joined(base).encode()))
            out["spans"].append(joined(spans))
        return {"blob": c["blob"], **out}

    return map_rows(blobs.select("blob", "text"), run, "blob string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def addressed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds nothing but the address: (path, text, blob)."""
    return docs.select(F.col(key).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))


def findings(docs: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings per row of ``docs``, entries new in the ledger).

    One path stands for each blob, the smallest; only (blob, path) pairs are
    shuffled to find it. The texts then meet the chosen pairs on both columns, which
    spreads copies evenly, and those that stand for a blob go through the rules.
    Entries are a written table in the shared folder, so nothing is scanned twice.
    """
    paths = addressed(docs, key, text)
    todo = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        todo = todo.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    todo = todo.select(F.col("blob").alias("_blob"), F.col("path").alias("_path"))
    chosen = paths.hint("shuffle_hash").join(todo.hint("shuffle_hash"), paths["path"].eqNullSafe(todo["_path"]) & (paths["blob"] == todo["_blob"]), "left_semi")
    # Only rows that share both id and text can stand for one blob twice.
    new = cut_lineage(scan(chosen).dropDuplicates(["blob"]).withColumn("rules", F.lit(rules)))
    known = new if ledger is None else ledger.where(F.col("rules") == rules).select(*new.columns).unionByName(new)
    # Blobs without a finding are most; only the others are joined, the rest get the empty answer.
    none = {"n_assign": F.lit(0).cast("long"), "n_access": F.lit(0).cast("long"), "n_hex": F.lit(0).cast("long"), "base_sha256": F.lit(sha256_hex(b"")), "spans": F.lit("")}
    hits = known.where(F.col("spans") != "").drop("rules")
    got = paths.select(F.col("path").alias(key), "blob").join(hits, "blob", "left")
    return got.select(key, "blob", *[F.coalesce(F.col(c), v).alias(c) for c, v in none.items()]), new


def without_spans(text: str | None, spans: str | None, mark: str) -> str | None:
    """``mark`` instead of every span; overlapping spans become one."""
    if not spans or text is None:
        return text
    parts, at = [], 0
    for item in spans.split(","):
        _, a, b = item.split(":")
        if int(a) >= at:
            parts += [text[at : int(a)], mark]
        at = max(at, int(b))
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span that the ledger has for its content replaced by ``mark``; same columns, other rows unchanged. ``n_chars``, if there, follows the text."""
    new = findings(docs)[1].where(F.col("spans") != "").select("blob", "spans")
    tagged = packed(docs, "text").withColumn("address", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    tagged = tagged.join(new, tagged["address"] == new["blob"], "left").select("row", "text", "spans")

    def run(c: dict) -> dict:
        return {"row": c["row"], "clean": [without_spans(t.as_py(), s.as_py(), mark) for t, s in zip(c["text"], c["spans"])]}

    out = map_rows(tagged, run, StructType([tagged.schema["row"], StructField("clean", StringType())]))
    fields = [F.col("clean").alias("text") if c == "text" else F.coalesce(F.char_length("clean").cast(t), F.col("row.n_chars")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c, t in docs.dtypes]
    return out.select(*fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: findings of every whole text of ``documents``; the ledger starts empty."""
    return findings(table(spark, sf_dir, "documents"))[0].drop("blob")
