"""Comparing a Spark result with DuckDB's: same columns, same rows in any order, same values."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    duck = duckdb.connect()
    for name in TABLES:
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{sf}/{name}.parquet'")
    return duck


def plain(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted texts, columns by name; whole numbers and flags look alike whatever their types."""
    frame = frame[sorted(frame.columns)]

    def text(x) -> str:
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return "null"
        if isinstance(x, (bool,)) or type(x).__name__ == "bool_":
            return str(bool(x)).lower()
        if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f":
            return repr(round(float(x) + 0.0, 6) + 0.0)
        if isinstance(x, int) or hasattr(x, "dtype") and x.dtype.kind in "iu":
            return repr(float(x))
        return str(x)

    return sorted(tuple(text(x) for x in row) for row in frame.astype(object).itertuples(index=False))


def difference(found: pd.DataFrame, wanted: pd.DataFrame) -> str:
    """What differs first; empty if nothing does."""
    if sorted(found.columns) != sorted(wanted.columns):
        return f"columns {sorted(found.columns)} and {sorted(wanted.columns)}"
    a, b = plain(found), plain(wanted)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{sorted(found.columns)}: {len(a)} and {len(b)} rows; {len(only_a)} and {len(only_b)} differ, such as {only_a[:2]} and {only_b[:2]}"
