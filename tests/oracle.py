"""Comparing a query with its SQL form in DuckDB."""

from __future__ import annotations

import decimal
import glob
import os


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(v: object) -> object:
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def assert_same(df, con, sql: str) -> None:
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    assert got == want
