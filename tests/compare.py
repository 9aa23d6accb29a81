"""Run registered queries in Spark and their SQL in DuckDB and compare whole results.

Command line: ``python -m tests.compare [--sf DIR] [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_KIND = {"int8": "int", "int16": "int", "int32": "int", "int64": "int", "float": "double", "large_string": "string"}


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "nan")
        return (1, v + 0.0)
    if isinstance(v, bool):
        return (2, v)
    if isinstance(v, int):
        return (1, v)
    return (0, "") if v is None else (3, str(v))


def _rows(arrow):
    cols = sorted(arrow.column_names)
    return cols, sorted(zip(*[[_cell(v) for v in arrow.column(c).to_pylist()] for c in cols]))


def compare(spark_df, con, sql: str) -> list[str]:
    a = spark_df.toArrow()
    b = con.execute(sql).to_arrow_table()
    kind = lambda t: {f.name: _KIND.get(str(f.type), str(f.type)) for f in t.schema}
    ka, kb = kind(a), kind(b)
    if ka != kb:
        return [f"schema: spark {sorted(set(ka.items()) - set(kb.items()))} sql {sorted(set(kb.items()) - set(ka.items()))}"]
    if a.num_rows != b.num_rows:
        return [f"rows: spark {a.num_rows} sql {b.num_rows}"]
    cols, ra = _rows(a)
    _, rb = _rows(b)
    bad = [(x, y) for x, y in zip(ra, rb) if x != y]
    if bad:
        x, y = bad[0]
        return [f"{len(bad)} rows differ, first: {[(c, p[1], q[1]) for c, p, q in zip(cols, x, y) if p != q]}"]
    if a.num_rows == 0:
        return ["both empty"]
    return []


def main(argv: list[str]) -> int:
    from sensorlake.session import local_session
    from __spark_entry__ import oracle_sql, queries

    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    q, o, con = queries(), oracle_sql(), duck(sf)
    names = [n for n in q if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    failed = 0
    for n in names:
        t0 = time.time()
        try:
            if n in o:
                problems = compare(q[n](spark, sf), con, o[n])
            else:
                rows = q[n](spark, sf).toArrow().num_rows
                problems = [] if rows else ["empty"]
                n = f"{n} (rows only: {rows})"
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
            if "-v" in argv:
                traceback.print_exc()
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {time.time() - t0:6.2f}s {n} {' '.join(problems)}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
