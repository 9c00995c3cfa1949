"""Compares a query with its SQL in DuckDB on the same tables."""

import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return plain(v.item()) if hasattr(v, "item") else v


def rows(df):
    columns = sorted(df.columns)
    out = [tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)]
    return columns, sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))
