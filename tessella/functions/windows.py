"""Frame helpers with pandas' min_periods rules: NULL until a window is full."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def over_time(*keys: str, by: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def trailing(w: WindowSpec, n: int, lag: int = 0) -> WindowSpec:
    """The n rows that end ``lag`` rows before the current one."""
    return w.rowsBetween(-(n - 1) - lag, -lag)


def rolling(agg, col: Column | str, w: WindowSpec, n: int, min_periods: int | None = None, lag: int = 0) -> Column:
    """agg over n rows, NULL under min_periods (default n) non-null values."""
    frame = trailing(w, n, lag)
    return F.when(F.count(col).over(frame) >= (min_periods or n), agg(col).over(frame))


def median(col) -> Column:
    """Linear median that is allowed in a framed window."""
    return F.percentile(col, F.lit(0.5))


def average_rank(value: str, *keys: str) -> Column:
    """Mean rank of ties among the non-null values of a group; NULL for NULL."""
    ordered = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(ordered) + (ties - 1) / 2.0)


def known(col: str) -> Column:
    """NaN is missing."""
    return F.when(~F.isnan(col), F.col(col))
