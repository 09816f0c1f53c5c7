"""Ordered windows over one series of a panel.

A panel holds at most one row per series and calendar period, so a window
partition is bounded by the length of the calendar, however many raw rows a
series had before it was aggregated.  Row-level inputs are aggregated to the
panel grain first (map-side combined), or go through the block-wise operators
in ``operators.asof``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesloom.functions.expressions import as_col


def series_window(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    """``partitionBy(keys).orderBy(order)``; a window without keys is refused
    because it would pull the whole table into one task."""
    if not keys:
        raise ValueError("an ordered window needs at least one series key")
    return Window.partitionBy(*keys).orderBy(*order)


def rolling(
    col: str | Column,
    size: int,
    fn,
    w: WindowSpec,
    min_periods: int | None = None,
) -> Column:
    """Aggregate of the last ``size`` rows, NULL below ``min_periods`` values."""
    c = as_col(col)
    frame = w.rowsBetween(-(size - 1), 0)
    need = size if min_periods is None else min_periods
    return F.when(F.count(c).over(frame) >= need, fn(c).over(frame))


def filled_forward(col: str | Column, w: WindowSpec) -> Column:
    return F.last(as_col(col), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def position(w: WindowSpec) -> Column:
    """Zero-based row position inside the series."""
    return F.row_number().over(w) - 1


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distribute series for grouped Python work, which costs CPU rather than
    bytes: a fixed partition count keeps adaptive execution from merging the
    small partitions into one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
