"""Tables and plain versions that the tests of this folder share."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """(doc_id, text[, source]) rows as documents; ``extra`` adds columns whose names operators like to use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for name in ("key", "fp", "score", "target", "size", "ids", "row", "_nth", "_id", "blob", "_blob", "_spans", "spans", "node", "root", "n", "y", "path", "digest"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def closure(n: int, links) -> list[int]:
    """Smallest index reachable, by plain search."""
    near = {i: set() for i in range(n)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = [-1] * n
    for i in range(n):
        if out[i] < 0:
            todo = [i]
            while todo:
                x = todo.pop()
                if out[x] < 0:
                    out[x] = i
                    todo.extend(near[x])
    return out


ODD = [
    (1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "one", "a"), (5, "one two", "b"), (6, "one", "a"), (6, "one", "a"), (6, "other text of the same id", "a"),
    (None, "no id here", "b"), (None, None, None), (7, "x " * 30000, "a"), (8, "üñí  字 🙂   a\x1cb", "c"),
]
