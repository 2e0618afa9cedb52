"""Holds a query's rows against its SQL on DuckDB, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{round(x, 6) + 0.0:.6f}"
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def differences(spark, query, sql, sf_dir):
    """None if equal, else a text."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(sf_dir).execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    a, b = set(got[1]), set(want[1])
    return f"rows {len(got[1])} != {len(want[1])}; only here {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from emberlog.plans.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            if name in o:
                d = differences(spark, q[name], o[name], sf)
            else:
                df = q[name](spark, sf)
                d = None
                print("   rows", len(df.collect()), df.columns)
        except Exception as ex:
            d = repr(ex)[:1500]
        bad += d is not None
        print(("ok  " if d is None else "BAD ") + name + ("" if name in o else " (no SQL)"), round(time.time() - t, 1), d or "", flush=True)
    print("bad:", bad)
    spark.stop()
