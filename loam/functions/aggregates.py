"""Aggregates whose results don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(column: str | Column, scale: int = 2) -> Column:
    """A sum in decimals of ``scale`` places, as double; null over no values."""
    of = F.col(column) if isinstance(column, str) else column
    return F.sum(of.cast(f"decimal(18,{scale})")).cast("double")


def exact_avg(column: str | Column, scale: int = 2) -> Column:
    """The exact sum over the number of values."""
    of = F.col(column) if isinstance(column, str) else column
    return exact_sum(of, scale) / F.count(of)
