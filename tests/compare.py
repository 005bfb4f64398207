"""Compares a Spark result with a DuckDB result, whatever the order of rows and columns."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):  # noqa: ANN001, ANN202
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, float, np.integer, np.floating)):
            return round(float(v), 6)
        return list(v) if isinstance(v, np.ndarray) else v

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
