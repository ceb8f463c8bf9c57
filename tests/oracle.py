"""Runs a query and its SQL on the same tables and compares all rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([text(x) for x in v])
    return str(v)


def compare(spark, sf_dir: str, query, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    want = con.sql(sql)
    names = want.columns
    got = query(spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    a = sorted(tuple(text(r[c]) for c in names) for r in got.collect())
    b = sorted(tuple(text(x) for x in r) for r in want.fetchall())
    assert a == b
