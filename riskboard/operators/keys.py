"""Names, duplicates, subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scale import latest_by
from ..functions.text import trim_all


def roster_names(lines: DataFrame, column: str = "value") -> DataFrame:
    """Company names from text lines: trimmed, blanks dropped, each once."""
    return lines.select(trim_all(F.col(column)).alias("name")).filter("name != ''").distinct()


def union_names(a: DataFrame, b: DataFrame, column: str = "name") -> DataFrame:
    return a.select(column).union(b.select(column)).distinct()


def last_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every key."""
    rest = [c for c in df.columns if c != key]
    return latest_by(df, [key], order, rest)
