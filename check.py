"""Compare registered queries with their SQL in DuckDB: ``check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from seqloom.plans.catalog import load
from seqloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None:
            return "~"
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return str(v)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, query, sf_dir):
    """(message, spark rows, seconds in Spark, seconds in DuckDB); an empty message is a match."""
    t0 = time.time()
    df = query.run(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if query.sql is None:
        return "", len(got[1]), t1 - t0, None
    cur = con.execute(query.sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    message = ""
    if got[0] != want[0]:
        message = f"columns {got[0]} != {want[0]}"
    elif got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        message = f"{len(got[1])} vs {len(want[1])} rows; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return message, len(got[1]), t1 - t0, t2 - t1


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    catalog = load()
    spark, con = local_session("check"), connect(sf_dir)
    bad = 0
    for name in argv[1:] or catalog:
        try:
            message, n, a, b = compare(spark, con, catalog[name], sf_dir)
        except Exception as e:  # report every query
            message, n, a, b = f"{type(e).__name__}: {str(e)[:600]}", 0, 0, None
        bad += bool(message)
        state = "FAIL " + message if message else ("ok" if b is not None else "rows only")
        print(f"{name:32s} {n:8d} rows  spark {a:6.2f}  sql {b if b is None else round(b, 2)}  {state}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
