"""Running a query and its SQL oracle over the same tables."""

from __future__ import annotations

import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return c


def both(spark, folder: str, query, sql: str) -> tuple[list, list]:
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = connect(folder).execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    return got, sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)
