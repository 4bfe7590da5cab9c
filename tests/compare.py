"""Runs a catalog query next to its SQL equivalent and compares schemas and sorted values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"create view {name} as select * from '{path}'")
    return con


def _kind(value) -> str:
    return type(value).__name__


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(df, relation) -> str | None:
    """None if both give the same columns and rows, else a short description."""
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} against {sorted(relation.columns)}"
    ours = _rows(df.columns, df.collect())
    theirs = _rows(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            same = x == y and _kind(x) == _kind(y)
            if isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=1e-12):
                same = x == y
            if not same:
                return f"{a} against {b}"
    return None
