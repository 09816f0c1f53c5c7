"""Seasonal decomposition of panel series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.windows import position, series_window


def seasonal_decompose(df: DataFrame, *, keys: Sequence[str], date: str, col: str, period: int = 12) -> DataFrame:
    """Additive parts: centred moving average, phase means centred to zero,
    remainder.  The trend is NULL where its window does not fit."""
    w = series_window(keys, date)
    half = period // 2
    x = F.col(col)
    if period % 2:
        inner = w.rowsBetween(-half, half)
        trend = F.when(F.count(x).over(inner) == period, F.sum(x).over(inner) / period)
    else:
        inner = w.rowsBetween(-(half - 1), half - 1)
        edges = F.lag(x, half).over(w) + F.lead(x, half).over(w)
        trend = F.when(F.count(x).over(inner) == period - 1, (F.sum(x).over(inner) + edges / 2) / period)
    parts = df.withColumns({"trend": trend, "_phase": F.pmod(position(w), F.lit(period))})
    by_phase = Window.partitionBy(*keys, "_phase")
    parts = parts.withColumns(
        {"_mean": F.avg(x - F.col("trend")).over(by_phase), "_first": F.row_number().over(by_phase.orderBy(date)) == 1}
    )
    level = F.avg(F.when(F.col("_first"), F.col("_mean"))).over(Window.partitionBy(*keys))
    out = parts.withColumn("seasonal", F.col("_mean") - level).drop("_phase", "_mean", "_first")
    return out.withColumn("resid", F.col(col) - F.col("trend") - F.col("seasonal"))
