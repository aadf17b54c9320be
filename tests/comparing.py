"""Rows of a Spark query against rows of its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pyarrow.parquet as pq

DATA = "/root/testdata/sf0.001"


def connection(folder: str = DATA):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):  # by way of Arrow: Parquet statistics hide NaN from this SQL engine
        con.register(p.stem, pq.read_table(p))
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float) and math.isnan(v):
        return "not a number"  # not the same as null
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def same_rows(df, con, sql: str) -> None:
    relation = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert len(got) == len(want)
    assert got == want
