"""Column names that do not clash with those of a caller's table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front, such that no column of ``docs`` begins with it."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name = "_" + name
    return name
