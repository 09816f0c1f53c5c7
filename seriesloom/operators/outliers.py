"""Outlier treatment of row-level columns.

Means and deviations come from one aggregate that reaches the rows as a scalar
subquery, quartiles from the exact histogram passes; the table itself is
scanned once more and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.expressions import attach_row, finite
from seriesloom.operators.quantiles import quantiles

QUARTILES = (0.25, 0.75)


def moments_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: per column a struct with n, mean, both deviations and extremes."""

    def packed(c: str) -> Column:
        x = finite(F.col(c).cast("double"))
        return F.struct(
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("sd"),
            F.stddev_pop(x).alias("sd_pop"),
            F.min(x).alias("lo"),
            F.max(x).alias("hi"),
        ).alias(c)

    return df.agg(*[packed(c) for c in cols])


def _with_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return attach_row(df, moments_row(df, cols), "_m")


def clip(c: str | Column, lo: Column, hi: Column) -> Column:
    """Bound a value; NULL stays NULL (``least``/``greatest`` skip NULLs)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def clip_flagged_columns(
    df: DataFrame,
    cols: Sequence[str],
    *,
    methods: Sequence[str] = ("zscore", "iqr"),
    z_limit: float = 3.0,
    iqr_factor: float = 1.5,
    caps: tuple[float, float] = (0.01, 0.99),
) -> DataFrame:
    """Clip a *whole* column to its ``caps`` quantiles if any of its values is
    flagged by |z| (population deviation) or the quartile fences.

    A mask that grows towards both ends flags something exactly when it flags
    the minimum or the maximum, so no counting pass is needed.
    """
    probs = sorted({*caps, *(QUARTILES if "iqr" in methods else ())})
    bounds = quantiles(df, cols, probs)
    out = _with_moments(df, cols)

    def treated(c: str) -> Column:
        def m(field: str) -> Column:
            return F.col(f"_m.{c}.{field}")

        def q(p: float) -> Column:
            return F.lit(bounds[c][p]).cast("double")

        flagged = F.lit(False)
        if "zscore" in methods:
            reach = F.greatest(m("hi") - m("mean"), m("mean") - m("lo"))
            flagged = flagged | (reach > m("sd_pop") * z_limit)
        if "iqr" in methods:
            spread = (q(0.75) - q(0.25)) * iqr_factor
            flagged = flagged | (m("lo") < q(0.25) - spread) | (m("hi") > q(0.75) + spread)
        return F.when(F.coalesce(flagged, F.lit(False)), clip(c, q(caps[0]), q(caps[1]))).otherwise(F.col(c))

    return out.withColumns({c: treated(c) for c in cols}).drop("_m")


def winsorize(df: DataFrame, cols: Sequence[str], *, z_limit: float = 3.0) -> DataFrame:
    """Cap at mean +- ``z_limit`` sample deviations, limits computed first."""
    out = _with_moments(df, cols)

    def capped(c: str) -> Column:
        mean, sd = F.col(f"_m.{c}.mean"), F.col(f"_m.{c}.sd")
        return F.when(sd.isNull(), F.col(c)).otherwise(clip(c, mean - sd * z_limit, mean + sd * z_limit))

    return out.withColumns({c: capped(c) for c in cols}).drop("_m")


def _z(c: str) -> Column:
    return F.try_divide(F.abs(F.col(c) - F.col(f"_m.{c}.mean")), F.col(f"_m.{c}.sd"))


def remove_outliers(df: DataFrame, cols: Sequence[str], *, z_limit: float = 3.0) -> DataFrame:
    """Keep rows whose |z| is within the limit in every column; a row without
    a z-score (missing value, constant column) goes too."""
    out = _with_moments(df, cols)
    keep = F.lit(True)
    for c in cols:
        keep = keep & (_z(c) <= z_limit)
    return out.filter(keep).drop("_m")


def replace_outliers_by_median(df: DataFrame, cols: Sequence[str], *, z_limit: float = 3.0) -> DataFrame:
    medians = quantiles(df, cols, [0.5])
    out = _with_moments(df, cols)
    return out.withColumns(
        {c: F.when(_z(c) > z_limit, F.lit(medians[c][0.5])).otherwise(F.col(c)) for c in cols}
    ).drop("_m")


def flag_beyond(df: DataFrame, col: str, *, deviations: float = 2.0, flag: str = "is_extreme") -> DataFrame:
    """Flag values outside mean +- ``deviations`` sample deviations."""
    out = _with_moments(df, [col])
    return out.withColumn(flag, F.coalesce(_z(col) > deviations, F.lit(False))).drop("_m")


def clip_flagged_series(
    df: DataFrame,
    cols: Sequence[str],
    *,
    keys: Sequence[str],
    z_limit: float = 3.0,
    iqr_factor: float = 1.5,
    caps: tuple[float, float] = (0.01, 0.99),
) -> DataFrame:
    """``clip_flagged_columns`` series by series, for panels: the calendar
    bounds a series, so its statistics are a window over it."""
    whole = Window.partitionBy(*keys)
    probs = [caps[0], 0.25, 0.75, caps[1]]
    out = df
    for c in cols:
        x = F.col(c).cast("double")
        out = out.withColumns(
            {
                "_m": F.avg(x).over(whole),
                "_s": F.stddev_pop(x).over(whole),
                "_lo": F.min(x).over(whole),
                "_hi": F.max(x).over(whole),
                "_q": F.percentile(x, F.array(*[F.lit(p) for p in probs])).over(whole),
            }
        )
        low, q25, q75, high = (F.col("_q")[i] for i in range(4))
        spread = (q75 - q25) * iqr_factor
        reach = F.greatest(F.col("_hi") - F.col("_m"), F.col("_m") - F.col("_lo"))
        flagged = (reach > F.col("_s") * z_limit) | (F.col("_lo") < q25 - spread) | (F.col("_hi") > q75 + spread)
        out = out.withColumn(c, F.when(flagged, clip(c, low, high)).otherwise(F.col(c)))
    return out.drop("_m", "_s", "_lo", "_hi", "_q")
