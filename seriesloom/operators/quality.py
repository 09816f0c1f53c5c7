"""Data-quality reports; every table is scanned once or twice, never moved."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.expressions import attach_row, finite, numeric_columns, ratio
from seriesloom.functions.windows import series_window
from seriesloom.operators.features import pct_change, with_filled
from seriesloom.operators.outliers import moments_row


def _z_counts(df: DataFrame, cols: Sequence[str], z_limit: float) -> DataFrame:
    """One row: number of values of each column with |z| above the limit."""
    out = attach_row(df.select(*cols), moments_row(df, cols), "_m")
    far = [
        F.count_if(F.abs(finite(F.col(c).cast("double")) - F.col(f"_m.{c}.mean")) > F.col(f"_m.{c}.sd") * z_limit).alias(c)
        for c in cols
    ]
    return out.agg(*far)


def quality_report(sources: Mapping[str, DataFrame], *, dates: Mapping[str, str], z_limit: float = 3.0) -> DataFrame:
    """One row per source: size, missing cells, outliers (sample deviation)
    and whether it needs cleaning; percentages refer to all (numeric) cells."""

    def row(name: str, df: DataFrame) -> DataFrame:
        numeric = numeric_columns(df)
        missing = df.agg(
            F.count("*").alias("row_count"),
            *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in df.columns],
        )
        far = _z_counts(df, numeric, z_limit) if numeric else None
        out = attach_row(missing, far, "_far") if numeric else missing
        nulls = [F.col(f"_null_{c}") for c in df.columns]
        total = reduce(Column.__add__, nulls)
        outliers = reduce(Column.__add__, [F.col(f"_far.{c}") for c in numeric]) if numeric else F.lit(0).cast("long")
        counted = out.select(
            F.lit(name).alias("file_name"),
            "row_count",
            F.lit(len(df.columns)).cast("long").alias("column_count"),
            F.lit(dates.get(name)).alias("date_column"),
            reduce(Column.__add__, [(n > 0).cast("long") for n in nulls]).alias("missing_columns"),
            total.alias("missing_values"),
            F.round(F.coalesce(ratio(total * 100.0, F.col("row_count") * len(df.columns)), F.lit(0.0)), 2).alias("missing_pct"),
            outliers.alias("outlier_count"),
            F.round(F.coalesce(ratio(outliers * 100.0, F.col("row_count") * max(len(numeric), 1)), F.lit(0.0)), 2).alias("outlier_pct"),
        )
        return counted.withColumn("needs_cleaning", (F.col("missing_pct") > 0) | (F.col("outlier_pct") > 1))

    return reduce(DataFrame.unionByName, [row(n, df) for n, df in sources.items()])


def flagged_sources(report: DataFrame) -> list[str]:
    """Names of the sources that need cleaning (one row per source)."""
    return [r.file_name for r in report.filter("needs_cleaning").select("file_name").collect()]


def missingness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(metric, n_missing, pct_missing)`` for columns that miss values."""
    rows = [
        F.struct(
            F.lit(c).alias("metric"),
            F.count_if(F.col(c).isNull()).alias("n_missing"),
            ratio(F.count_if(F.col(c).isNull()) * 100.0, F.count("*")).alias("pct_missing"),
        )
        for c in (cols or df.columns)
    ]
    table = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return table.filter("n_missing > 0")


def outlier_summary(df: DataFrame, cols: Sequence[str], *, z_limit: float = 3.0) -> DataFrame:
    """``(metric, n_outliers, pct_outliers)`` of all rows."""
    counts = _z_counts(df, cols, z_limit)
    out = attach_row(df.agg(F.count("*").alias("n")), counts, "_far")
    rows = [
        F.struct(
            F.lit(c).alias("metric"),
            F.col(f"_far.{c}").alias("n_outliers"),
            ratio(F.col(f"_far.{c}") * 100.0, "n").alias("pct_outliers"),
        )
        for c in cols
    ]
    return out.select(F.inline(F.array(*rows)))


def jump_summary(df: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str], limit: float = 0.5) -> DataFrame:
    """Changes between neighbouring rows of a series larger than ``limit``."""
    w = series_window(keys, date)
    moves = with_filled(df, cols, w).withColumns({f"_p_{c}": F.abs(pct_change(c, 1, w)) for c in cols})
    rows = [
        F.struct(
            F.lit(c).alias("metric"),
            F.count_if(F.col(f"_p_{c}") > limit).alias("n_jumps"),
            F.max(f"_p_{c}").alias("largest"),
        )
        for c in cols
    ]
    return moves.groupBy(*keys).agg(F.array(*rows).alias("rows")).select(*keys, F.inline("rows"))


def coverage_gaps(df: DataFrame, *, keys: Sequence[str], date: str, factor: float = 2.0) -> DataFrame:
    """Start, end, duration, median step (days) and steps longer than
    ``factor`` times the median, per series."""
    days = df.select(*keys, F.col(date).cast("date").alias("_d"))
    steps = days.withColumn("_step", F.datediff("_d", F.lag("_d").over(series_window(keys, "_d"))))
    # one row for each step length of a series: no list of all steps
    counts = steps.groupBy(*keys, "_step").agg(F.count("_step").alias("_n"), F.min("_d").alias("_first"), F.max("_d").alias("_last"))
    up_to = series_window(keys, F.col("_step").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    counts = counts.withColumns({"_upto": F.sum("_n").over(up_to), "_all": F.sum("_n").over(whole)})

    def at(place: str) -> Column:
        return F.min(F.when(F.col("_upto") > F.expr(place), F.col("_step"))).over(whole)

    counts = counts.withColumn("median_step", (at("(_all - 1) div 2") + at("_all div 2")) / 2)
    return counts.groupBy(*keys).agg(
        F.min("_first").alias("start"),
        F.max("_last").alias("end"),
        F.datediff(F.max("_last"), F.min("_first")).alias("duration_days"),
        F.max("median_step").alias("median_step"),
        F.coalesce(F.sum(F.when(F.col("_step") > F.col("median_step") * factor, F.col("_n"))), F.lit(0)).alias("n_gaps"),
    )


def date_consistency(sources: Mapping[str, DataFrame], *, dates: Mapping[str, str], tolerance_days: int = 30) -> DataFrame:
    """Range of every source against the overall range."""
    ranges = [
        df.agg(F.min(dates[n]).cast("date").alias("start"), F.max(dates[n]).cast("date").alias("end")).select(
            F.lit(n).alias("source"), "start", "end"
        )
        for n, df in sources.items()
    ]
    table = reduce(DataFrame.unionByName, ranges)
    out = attach_row(table, table.agg(F.min("start").alias("lo"), F.max("end").alias("hi")), "_all")
    out = out.withColumns(
        {
            "starts_after_days": F.datediff("start", F.col("_all.lo")),
            "ends_before_days": F.datediff(F.col("_all.hi"), "end"),
        }
    ).drop("_all")
    late = (F.col("starts_after_days") > tolerance_days) | (F.col("ends_before_days") > tolerance_days)
    return out.withColumn("inconsistent", late)


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Number of rows that repeat an earlier one; counted per distinct row,
    so many copies of one row combine before the shuffle."""
    groups = df.groupBy(*(cols or df.columns)).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows")
    )
