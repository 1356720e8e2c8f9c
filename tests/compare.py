"""Run registered queries against their SQL counterparts and report differences."""

from __future__ import annotations

import datetime as dt
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return repr([plain(v) for v in value])
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, query, sql):
    """None when equal, else a short description of the first difference."""
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs = rows_of([c[0] for c in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return (f"rows {len(mine[1])} against {len(theirs[1])}, {len(a - b)} and {len(b - a)} unmatched\n"
                f"  columns {mine[0]}\n  ours   {sorted(a - b)[:3]}\n  theirs {sorted(b - a)[:3]}")
    return None if mine[1] else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from epiwake.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), entry.oracle_sql()
    only = sys.argv[1:]
    for name, query in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, folder, name, query, sql[name])
                print(f"{name:32s} {'ok' if problem is None else 'DIFF ' + problem} {time.time() - start:.1f}s", flush=True)
            else:
                n = query(spark, folder).count()
                print(f"{name:32s} rows {n} {time.time() - start:.1f}s", flush=True)
        except Exception as exc:  # report and go on with the next query
            print(f"{name:32s} ERROR {str(exc)[:1500]}", flush=True)
