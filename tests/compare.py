"""Runs registered queries on Spark and their SQL twins on DuckDB and compares the results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

TESTDATA = os.environ.get("FOLIO_TESTDATA", "/root/testdata/sf0.001")


def connect(path: str = TESTDATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in glob.glob(f"{path}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def compare(spark, con, name: str, path: str = TESTDATA) -> str:
    """'' when equal, otherwise a short text about the difference."""
    from folioscope.plans.all import QUERIES, SQL

    df = QUERIES[name](spark, path)
    columns = sorted(df.columns)
    ours = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    if name not in SQL:
        return "" if ours else "no rows"
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} / {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
    if not ours:
        return "no rows"
    if ours != theirs:
        a, b = set(ours), set(theirs)
        return f"{len(ours)} / {len(theirs)} rows; spark {sorted(a - b)[:3]} duckdb {sorted(b - a)[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from folioscope.plans.all import QUERIES, SQL
    from folioscope.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("OFF")
    con = connect()
    wanted = sys.argv[1:]
    bad = 0
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{time.time() - start:6.2f}s {name:32} {'sql' if name in SQL else 'rows':5} {problem or 'ok'}", flush=True)
    print("different:", bad)
