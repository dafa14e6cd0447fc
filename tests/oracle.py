"""Spark rows against DuckDB rows of the same query."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(float(x))
    return str(x)


def same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = con.sql(sql)
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == names
    want = sorted(tuple(plain(r[at[c]]) for c in names) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
