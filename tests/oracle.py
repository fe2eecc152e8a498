"""Holds a query against its SQL in DuckDB."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
there = os.path.isdir(SF)


def norm(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{x:.10g}" if isinstance(x, float) else str(x)


def same(df, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.sql(sql)
    assert sorted(df.columns) == sorted(cur.columns)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    order = [cur.columns.index(c) for c in sorted(cur.columns)]
    want = sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    assert got == want
