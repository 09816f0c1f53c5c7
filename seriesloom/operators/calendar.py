"""Calendar features, spines and forecast dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import calendar as cal
from seriesloom.functions.windows import position, series_window


def calendar_parts(df: DataFrame, date: str) -> DataFrame:
    """Year, quarter, month, day and weekday (Monday = 0)."""
    d = F.col(date).cast("date")
    return df.withColumns(
        {
            "year": F.year(d),
            "quarter": F.quarter(d),
            "month": F.month(d),
            "day_of_month": F.dayofmonth(d),
            "day_of_week": F.weekday(d),
        }
    )


def cyclical_parts(df: DataFrame, date: str) -> DataFrame:
    d = F.col(date).cast("date")
    return df.withColumns(
        {
            "month_sin": cal.wave(F.sin, F.month(d), 12),
            "month_cos": cal.wave(F.cos, F.month(d), 12),
            "quarter_sin": cal.wave(F.sin, F.quarter(d), 4),
            "quarter_cos": cal.wave(F.cos, F.quarter(d), 4),
        }
    )


def season_flags(
    df: DataFrame,
    date: str,
    *,
    holidays: Sequence[int] | None = cal.HOLIDAY_MONTHS,
    festival: tuple[Sequence[int], Sequence[int]] | None = (cal.FESTIVAL_MONTHS, cal.PRE_FESTIVAL_MONTHS),
    budget: tuple[Sequence[int], Sequence[int], Sequence[int]] | None = (
        cal.BUDGET_MONTHS,
        cal.PRE_BUDGET_MONTHS,
        cal.POST_BUDGET_MONTHS,
    ),
) -> DataFrame:
    """0/1 flags for calendar seasons; None leaves a group out."""
    groups: dict[str, Sequence[int]] = {}
    if holidays:
        groups["is_holiday_season"] = holidays
    if festival:
        groups["is_diwali_season"], groups["is_pre_diwali"] = festival
    if budget:
        groups["is_budget_month"], groups["is_pre_budget"], groups["is_post_budget"] = budget
    d = F.col(date).cast("date")
    return df.withColumns({name: cal.in_months(d, months) for name, months in groups.items()})


def seasonal_waves(df: DataFrame, *, keys: Sequence[str], date: str, periods: Sequence[int] = (4, 6, 12)) -> DataFrame:
    """Sine and cosine of the row position for every period."""
    out = df.withColumn("_pos", position(series_window(keys, date)))
    waves = {}
    for p in periods:
        waves[f"seasonal_sin_{p}"] = cal.wave(F.sin, "_pos", p)
        waves[f"seasonal_cos_{p}"] = cal.wave(F.cos, "_pos", p)
    return out.withColumns(waves).drop("_pos")


def calendar_spine(df: DataFrame, *, keys: Sequence[str], date: str, step: str = "1 month") -> DataFrame:
    """Every period from a key's first to its last date: ``(keys, date)``."""
    ends = df.groupBy(*keys).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    return ends.select(*keys, F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias(date))


def forecast_calendar(df: DataFrame, *, keys: Sequence[str], date: str, periods: int = 12) -> DataFrame:
    """``(keys, step, date)``: the month ends that follow a key's last date."""
    last = df.groupBy(*keys).agg(F.max(date).alias("_last"))
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return steps.select(*keys, "step", cal.month_end_after("_last", "step").alias(date))


# The separator shapes and the formats they stand for.
DATE_SHAPES: Mapping[str, str] = {
    "YYYY-MM-DD": r"^[^-]*-[^-]*-[^-]*$",
    "MM/DD/YYYY": r"^[^/]*/[^/]*/[^/]*$",
    "DD.MM.YYYY": r"^[^.]*\.[^.]*\.[^.]*$",
}


def detect_date_format(df: DataFrame, text: str, *, keys: Sequence[str]) -> DataFrame:
    """Most frequent separator shape of a text column per source, from counts
    over the whole column; ties go to the shape listed first."""
    counts = df.groupBy(*keys).agg(
        *[F.count_if(F.col(text).rlike(shape)).alias(name) for name, shape in DATE_SHAPES.items()],
        F.count(text).alias("n_values"),
    )
    best = F.greatest(*[F.col(f"`{n}`") for n in DATE_SHAPES])
    chosen = F.lit(None).cast("string")
    for name in reversed(list(DATE_SHAPES)):
        chosen = F.when((F.col(f"`{name}`") == best) & (best > 0), F.lit(name)).otherwise(chosen)
    return counts.select(*keys, chosen.alias("date_format"), best.alias("n_matching"), "n_values")
