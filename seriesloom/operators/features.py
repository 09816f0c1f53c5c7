"""Lag, rolling, change and trend features, and the three feature bundles.

Everything over one series uses the same window specification, so a whole
bundle plans as one exchange, one sort and one window operator.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesloom.functions.calendar import wave
from seriesloom.functions.expressions import ratio
from seriesloom.functions.windows import filled_forward, position, rolling, series_window

BUILTIN: Mapping[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "std_sample": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
}


def lag_exprs(cols: Sequence[str], lags: int | Sequence[int], w: WindowSpec) -> dict[str, Column]:
    steps = range(1, lags + 1) if isinstance(lags, int) else lags
    return {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in steps}


def lag_features(df: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str], lags: int | Sequence[int] = 3) -> DataFrame:
    """Previous rows by position; an int asks for lags 1..n."""
    return df.withColumns(lag_exprs(cols, lags, series_window(keys, date)))


def rolling_features(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    cols: Sequence[str],
    windows: Sequence[int] = (3, 6, 12),
    functions: Mapping[str, Callable | str] | Sequence[str] = ("mean", "std"),
    min_periods: int | None = None,
    pattern: str = "{col}_{fn}_{window}",
) -> DataFrame:
    """Rolling aggregates named ``{col}_{fn}_{window}``.

    ``functions`` holds built-in names (``std`` is the population deviation)
    or a mapping whose callables take a pandas Series and return a number;
    those run as grouped-aggregate pandas UDFs over the bounded frame.
    """
    if not isinstance(functions, Mapping):
        functions = {f: f for f in functions}
    w = series_window(keys, date)
    out = {}
    for c in cols:
        for size in windows:
            for name, fn in functions.items():
                agg = BUILTIN[fn] if isinstance(fn, str) else _pandas_aggregate(fn)
                out[pattern.format(col=c, fn=name, window=size)] = rolling(F.col(c).cast("double"), size, agg, w, min_periods)
    return df.withColumns(out)


def _pandas_aggregate(fn: Callable) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def apply(values: pd.Series) -> float:
        present = values.dropna()
        return float(fn(present)) if len(present) else None

    return apply


def with_filled(df: DataFrame, cols: Sequence[str], w: WindowSpec) -> DataFrame:
    """Add the forward-filled twins ``_f_{col}`` that ``pct_change`` compares."""
    return df.withColumns({f"_f_{c}": filled_forward(c, w) for c in cols})


def pct_change(c: str, k: int, w: WindowSpec) -> Column:
    """Relative change over ``k`` rows; needs ``with_filled``, zero base -> NULL."""
    return ratio(f"_f_{c}", F.lag(f"_f_{c}", k).over(w)) - 1


def change_features(df: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str], periods: Sequence[int] = (1, 12), scale: float = 1.0) -> DataFrame:
    """``{col}_pct_{k}``: gaps are forward-filled before the comparison and a
    zero base gives NULL."""
    w = series_window(keys, date)
    out = with_filled(df, cols, w).withColumns({f"{c}_pct_{k}": pct_change(c, k, w) * scale for c in cols for k in periods})
    return out.drop(*[f"_f_{c}" for c in cols])


def difference(df: DataFrame, *, keys: Sequence[str], date: str, col: str, lag: int = 1, name: str | None = None) -> DataFrame:
    w = series_window(keys, date)
    return df.withColumn(name or f"{col}_diff_{lag}", F.col(col) - F.lag(col, lag).over(w))


def difference_order(df: DataFrame, *, keys: Sequence[str], date: str, col: str, order: int = 1, seasonal: int | None = None, name: str = "diffed") -> DataFrame:
    """Optional seasonal difference, then ``order`` first differences."""
    out = df.withColumn(name, F.col(col))
    if seasonal:
        out = difference(out, keys=keys, date=date, col=name, lag=seasonal, name=name)
    for _ in range(order):
        out = difference(out, keys=keys, date=date, col=name, name=name)
    return out


def expanding_mean(df: DataFrame, *, keys: Sequence[str], date: str, cols: Sequence[str]) -> DataFrame:
    frame = series_window(keys, date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{c}_exp_mean": F.avg(c).over(frame) for c in cols})


def trend_features(df: DataFrame, *, keys: Sequence[str], date: str) -> DataFrame:
    out = df.withColumn("trend", position(series_window(keys, date)))
    return out.withColumn("trend_squared", F.col("trend").cast("long") * F.col("trend"))


def target_bundle(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    target: str,
    indicators: Sequence[str] = (),
    lags: Sequence[int] = (1, 3, 6, 12),
    windows: Sequence[int] = (3, 6, 12),
) -> DataFrame:
    """Target lags and partial-window statistics, indicator lags 1/3 and
    rolling 3, calendar parts and year-over-year change."""
    w = series_window(keys, date)
    d = F.col(date)
    out = lag_exprs([target], lags, w)
    for size in windows:
        out[f"{target}_rolling_mean_{size}"] = rolling(target, size, F.avg, w, 1)
        out[f"{target}_rolling_std_{size}"] = rolling(target, size, F.stddev_samp, w, 2)
    out |= lag_exprs(indicators, (1, 3), w)
    out |= {f"{c}_rolling_mean_3": rolling(c, 3, F.avg, w, 1) for c in indicators}
    out |= {
        "month_sin": wave(F.sin, F.month(d), 12),
        "month_cos": wave(F.cos, F.month(d), 12),
        "quarter": F.quarter(d),
        "year": F.year(d),
        f"{target}_yoy_change": pct_change(target, 12, w),
    }
    return with_filled(df, [target], w).withColumns(out).drop(f"_f_{target}")


def ensemble_bundle(df: DataFrame, *, keys: Sequence[str], date: str, target: str) -> DataFrame:
    """Lags 1-3, moving averages 3/6/12, changes, expanding mean and trend;
    rows without a full history are dropped."""
    w = series_window(keys, date)
    out = lag_exprs([target], 3, w)
    out |= {f"{target}_ma_{size}": rolling(target, size, F.avg, w) for size in (3, 6, 12)}
    trend = position(w)
    out |= {
        f"{target}_mom_change": pct_change(target, 1, w),
        f"{target}_abs_change": F.col(target) - F.lag(target).over(w),
        f"{target}_exp_mean": F.avg(target).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "trend": trend,
        "trend_squared": trend.cast("long") * trend,
    }
    full = with_filled(df, [target], w).withColumns(out).drop(f"_f_{target}")
    return full.na.drop("any", subset=list(out))


def macro_bundle(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    cols: Sequence[str],
    volatile: Sequence[str] | None = None,
    ratios: Mapping[str, tuple[str, str]] | None = None,
    sums: Mapping[str, tuple[str, str]] | None = None,
    scaled: Mapping[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """Lags, rolling means, volatility, changes, calendar and interactions of
    several indicators; rows without a full history are dropped."""
    w = series_window(keys, date)
    d = F.col(date)
    out = lag_exprs(cols, (1, 3, 6, 12), w)
    out |= {f"{c}_rolling_{n}": rolling(c, n, F.avg, w) for c in cols for n in (3, 6, 12)}
    out |= {f"{c}_volatility_{n}": rolling(c, n, F.stddev_samp, w) for c in (volatile or cols) for n in (3, 6, 12)}
    for c in cols:
        out[f"{c}_pct_change"] = pct_change(c, 1, w) * 100
        out[f"{c}_diff"] = F.col(c) - F.lag(c).over(w)
    out |= {
        "month": F.month(d),
        "quarter": F.quarter(d),
        "month_sin": wave(F.sin, F.month(d), 12),
        "month_cos": wave(F.cos, F.month(d), 12),
    }
    out |= {n: ratio(a, b) for n, (a, b) in (ratios or {}).items()}
    out |= {n: F.col(a) + F.col(b) for n, (a, b) in (sums or {}).items()}
    out |= {n: F.col(c) * k for n, (c, k) in (scaled or {}).items()}
    full = with_filled(df, cols, w).withColumns(out).drop(*[f"_f_{c}" for c in cols])
    return full.na.drop("any", subset=list(out))
