"""The engine's relational operators as DataFrame functions, each over one table's path or two.

They name what Spark's API expresses directly; Catalyst plans them together with what stands around.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns)


def where(df: DataFrame, condition: str | Column) -> DataFrame:
    """Rows for which ``condition`` is true; null is not true."""
    return df.where(condition)


def aggregate(df: DataFrame, keys: Sequence[str | Column], *measures: Column, having: str | Column | None = None) -> DataFrame:
    """Grouped or, without ``keys``, scalar aggregates. Keys without measures give their distinct values."""
    if keys and not measures:
        out = df.select(*keys).distinct()
    else:
        out = df.groupBy(*keys).agg(*measures) if keys else df.agg(*measures)
    return out if having is None else out.where(having)


def join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Catalyst and adaptive execution choose the strategy and split skewed keys."""
    return left.crossJoin(right) if how == "cross" else left.join(right, on, how)


def order(df: DataFrame, *keys: Column, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A global sort by all keys; with ``limit``, only the first rows are ever kept."""
    out = df.orderBy(*keys)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def ranked(df: DataFrame, partition: Sequence[str], by: Sequence[Column], **functions: str) -> DataFrame:
    """Adds row_number, rank or dense_rank columns: ``name="rank"``."""
    window = Window.partitionBy(*partition).orderBy(*by)
    return df.withColumns({name: getattr(F, f)().over(window) for name, f in functions.items()})
