"""As-of joins on row-level tables, safe for keys with very many rows.

A key is cut into time blocks.  Inside a block the candidates come from a
running window over the stacked rows of both sides; across blocks each block
passes on one summary row (its last and first right-hand value), so only one
row per block travels and no task holds more than one block of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.windows import series_window

_LEFT, _RIGHT = 1, 0


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_cols: Sequence[str],
    tie: str,
    direction: str = "nearest",
    block: str = "hour",
) -> DataFrame:
    """Every left row with the as-of matched ``right_cols``.

    ``backward`` takes the last right row at or before the left time,
    ``nearest`` the closer of that and the first one after it (the earlier on
    equal distance).  Of several right rows at one time the one with the
    largest ``tie`` (a unique column) counts.  ``block`` is any ``date_trunc``
    unit: choose it so that one block of the largest key fits a task.
    """
    if direction not in ("backward", "nearest"):
        raise ValueError(f"unknown direction {direction}")
    k = list(keys)
    payload = [c for c in left.columns if c not in k]
    match = F.struct(F.col(right_ts).alias("ts"), *[F.col(c).alias(c) for c in right_cols])

    lefts = left.select(
        *k,
        F.col(left_ts).alias("_ts"),
        F.lit(_LEFT).alias("_side"),
        F.struct(*payload).alias("_row"),
    )
    rights = right.select(
        *k, F.col(right_ts).alias("_ts"), F.lit(_RIGHT).alias("_side"), F.col(tie).alias("_tie"), match.alias("_match")
    )
    lefts = lefts.withColumn("_block", F.date_trunc(block, "_ts"))
    rights = rights.withColumn("_block", F.date_trunc(block, "_ts"))

    # One summary per key and block, combined before the shuffle.
    order = F.struct("_ts", "_tie")
    ends = rights.groupBy(*k, "_block").agg(
        F.max_by("_match", order).alias("_last"),
        F.min_by("_match", F.struct(F.col("_ts"), -F.col("_tie"))).alias("_first"),
    )
    seen = lefts.groupBy(*k, "_block").agg(F.count("*").alias("_n_left"))
    blocks = seen.join(ends, [*k, "_block"], "full")
    before = series_window(k, "_block").rowsBetween(Window.unboundedPreceding, -1)
    after = series_window(k, F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = {"_before": F.last("_last", ignorenulls=True).over(before)}
    if direction == "nearest":
        carry["_after"] = F.last("_first", ignorenulls=True).over(after)
    carried = blocks.withColumns(carry).filter(F.col("_n_left").isNotNull()).select(*k, "_block", *carry)

    stacked = lefts.unionByName(rights, allowMissingColumns=True)
    forward = series_window([*k, "_block"], "_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    mirror = Window.partitionBy(*k, "_block").orderBy(F.col("_ts").desc(), F.col("_side"), F.col("_tie"))
    found = {"_back": F.last("_match", ignorenulls=True).over(forward)}
    if direction == "nearest":
        found["_fwd"] = F.last("_match", ignorenulls=True).over(mirror.rowsBetween(Window.unboundedPreceding, 0))
    inside = stacked.withColumns(found).filter(F.col("_side") == _LEFT)

    joined = inside.join(carried, [*k, "_block"], "left")
    back = F.coalesce("_back", "_before")
    best = back if direction == "backward" else _nearer(back, F.coalesce("_fwd", "_after"))
    out = joined.withColumn("_best", best)
    return out.select(*k, "_row.*", F.col("_best.ts").alias(f"matched_{right_ts}"), *[F.col(f"_best.{c}").alias(c) for c in right_cols])


def _nearer(back: Column, fwd: Column) -> Column:
    """The closer match; the earlier one on equal distance."""
    back_gap = F.timestamp_diff("MICROSECOND", back.ts, F.col("_ts"))
    fwd_gap = F.timestamp_diff("MICROSECOND", F.col("_ts"), fwd.ts)
    return F.when(back.isNull(), fwd).when(fwd.isNull(), back).when(fwd_gap < back_gap, fwd).otherwise(back)


def last_known_at_period_end(df: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str], unit: str = "month") -> DataFrame:
    """Observation carried to the end of every period of a series: the last
    value of each period (pre-aggregated), then forward over the periods."""
    from seriesloom.operators.panel import densify, resample_last

    step = {"month": "1 month", "year": "1 year", "week": "7 day"}[unit]
    monthly = resample_last(df, keys=keys, date=date, cols=cols, unit=unit)
    dense = densify(monthly, keys=keys, date=date, step=step)
    w = series_window(keys, date).rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
