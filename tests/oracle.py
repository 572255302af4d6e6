"""Compare a query with its SQL on the same tables, as sets of rows."""

from __future__ import annotations

import math
import os
from glob import glob

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def assert_same(df, con, sql: str) -> None:
    result = con.sql(sql)
    names, expected = result.columns, result.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    have = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(plain(row[names.index(c)]) for c in order) for row in expected), key=key)
    assert len(have) == len(want)
    different = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    assert not different, different[:3]
