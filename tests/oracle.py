"""Runs a query and its SQL on the same tables, and compares rows without their order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def sql_rows(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.execute(sql).df()


def normal(frame: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NA or (not isinstance(v, (list, tuple)) and pd.isna(v)):
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(value, row)) for row in frame.itertuples(index=False))
