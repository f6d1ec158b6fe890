"""Trailing windows of each symbol in time order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("time")


def trailing(n: int) -> WindowSpec:
    return series().rowsBetween(-(n - 1), 0)


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(series())


def safe(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return x / F.nullif(y, F.lit(0.0))


def rolled(aggregate: Callable[[Column], Column], x: Column, n: int, least: int | None = None) -> Column:
    """An aggregate over the last n rows, null with fewer than ``least`` (n) values."""
    w = trailing(n)
    return F.when(F.count(x).over(w) >= (n if least is None else least), aggregate(x).over(w))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def zscore(x: Column, n: int, least: int = 20) -> Column:
    return safe(x - rolled(F.avg, x, n, least), rolled(F.stddev_samp, x, n, least))


def change(x: Column, n: int = 1) -> Column:
    """x / (x n rows ago) - 1."""
    return safe(x, lag(x, n)) - 1
