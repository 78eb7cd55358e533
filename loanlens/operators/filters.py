"""Row filters: NULL keys, inclusive ranges, group-size thresholds.

All are plain ``DataFrame.filter`` calls, so Catalyst pushes the simple ones
(``IS NOT NULL``, comparisons) into the parquet scan as ``PushedFilters``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_null(df: DataFrame, *cols: str) -> DataFrame:
    """Drop rows where any of ``cols`` is NULL."""
    if not cols:
        return df
    cond = None
    for c in cols:
        p = F.col(c).isNotNull()
        cond = p if cond is None else cond & p
    return df.filter(cond)


def in_range(col: str | Column, lo, hi, nulls: str = "drop") -> Column:
    """Inclusive-range predicate; ``nulls="keep"`` also accepts NULL."""
    c = F.col(col) if isinstance(col, str) else col
    pred = (c >= lo) & (c <= hi)
    if nulls == "keep":
        return c.isNull() | pred
    if nulls != "drop":
        raise ValueError("nulls must be 'drop' or 'keep'")
    return pred


def keep_range(df: DataFrame, col: str, lo, hi, nulls: str = "drop") -> DataFrame:
    """Keep rows with ``lo <= col <= hi``; NULL rows are dropped unless ``nulls="keep"``."""
    return df.filter(in_range(col, lo, hi, nulls))


def min_group(grouped: DataFrame, count_col: str, n: int) -> DataFrame:
    """HAVING ``count_col >= n`` on an already aggregated frame."""
    return grouped.filter(F.col(count_col) >= n)
