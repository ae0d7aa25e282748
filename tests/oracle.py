"""Compares a query's rows with its SQL over the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata/sf0.001")


def connection(folder: Path = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return str([plain(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return "null" if isinstance(v, float) and math.isnan(v) else f"{v:.5f}".rstrip("0").rstrip(".")
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def assert_equal(spark, name: str, query, sql: str, con=None) -> None:
    mine, theirs = query(spark, str(DATA)).toPandas(), (con or connection()).sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns), name
    a, b = rows(mine), rows(theirs)
    assert a == b, f"{name}: {sorted(set(a) - set(b))[:3]} against {sorted(set(b) - set(a))[:3]}"
