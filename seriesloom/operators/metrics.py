"""Forecast accuracy from long tables of ``(keys, y, yhat)``; one aggregate each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.distributions import normal_quantile, t_quantile
from seriesloom.functions.expressions import as_col, ratio
from seriesloom.functions.windows import series_window

T_TABLE_SIZE = 150


def metric_columns(y: str | Column = "y", yhat: str | Column = "yhat") -> dict[str, Column]:
    """MAE, MSE, RMSE, R2 (1 - SSE/SST, may be negative) and MAPE in percent
    over the non-zero actuals."""
    y, yhat = as_col(y), as_col(yhat)
    e = y - yhat
    mse = F.avg(e * e)
    known = F.when(e.isNotNull(), y)
    return {
        "mae": F.avg(F.abs(e)),
        "mse": mse,
        "rmse": F.sqrt(mse),
        "r2": 1 - ratio(mse, F.var_pop(known)),
        "mape": F.avg(F.when(y != 0, F.abs(ratio(e, y)))) * 100,
    }


def forecast_metrics(df: DataFrame, *, keys: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in metric_columns(y, yhat).items()])


def mase(test: DataFrame, train: DataFrame, *, keys: Sequence[str], date: str, model: Sequence[str] = (), y: str = "y", yhat: str = "yhat", season: int = 12) -> DataFrame:
    """Test MAE over the in-sample MAE of the seasonal naive forecast."""
    lagged = train.withColumn("_e", F.abs(F.col(y) - F.lag(y, season).over(series_window(keys, date))))
    scale = lagged.groupBy(*keys).agg(F.avg("_e").alias("scale"))
    errors = test.groupBy(*keys, *model).agg(F.avg(F.abs(F.col(y) - F.col(yhat))).alias("mae"))
    return errors.join(scale, list(keys)).select(*keys, *model, ratio("mae", "scale").alias("mase"))


def weighted_rmse(df: DataFrame, *, keys: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Weights ``1 / (|y| + 1)``; their mean cancels out."""
    weight = 1 / (F.abs(y) + 1)
    e = F.col(y) - F.col(yhat)
    return df.groupBy(*keys).agg(F.sqrt(ratio(F.sum(weight * e * e), F.sum(weight))).alias("weighted_rmse"))


def log_rmse_ratio(df: DataFrame, *, keys: Sequence[str], split: str, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """RMSE of ``log1p`` values on train and test rows and their ratio."""
    e = F.log1p(y) - F.log1p(yhat)

    def rmse(part: str) -> Column:
        return F.sqrt(F.avg(F.when(F.col(split) == part, e * e)))

    out = df.groupBy(*keys).agg(rmse("train").alias("train_log_rmse"), rmse("test").alias("test_log_rmse"))
    return out.withColumn("ratio", ratio("test_log_rmse", "train_log_rmse"))


@lru_cache(maxsize=8)
def _t_table(p: float) -> tuple[float, ...]:
    return tuple(t_quantile(p, d) for d in range(1, T_TABLE_SIZE + 1))


def t_critical(n: Column, confidence: float) -> Column:
    """Two-sided t critical value for ``n - 1`` degrees of freedom.

    Values for small samples are computed once on the driver; beyond, the
    Cornish-Fisher expansion around the normal quantile is accurate to 1e-10.
    """
    p = 0.5 + confidence / 2
    table = F.array(*[F.lit(t) for t in _t_table(p)])
    df = (n - 1).cast("double")
    z = normal_quantile(p)
    g1, g2 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    wide = F.lit(z) + g1 / df + g2 / (df * df) + g3 / F.pow(df, F.lit(3)) + g4 / F.pow(df, F.lit(4))
    small = F.try_element_at(table, df.cast("int"))
    return F.when(df < 1, F.lit(None)).when(df <= T_TABLE_SIZE, small).otherwise(wide)


def metric_intervals(df: DataFrame, *, keys: Sequence[str], y: str = "y", yhat: str = "yhat", confidence: float = 0.95) -> DataFrame:
    """t-based intervals of mean error, MAE and MSE; RMSE bounds are the roots
    of the (non-negative) MSE bounds."""
    e = F.col(y) - F.col(yhat)
    parts = {"error": e, "mae": F.abs(e), "mse": e * e}
    table = df.groupBy(*keys).agg(
        F.count(e).alias("n"),
        *[F.avg(x).alias(n_) for n_, x in parts.items()],
        *[F.stddev_samp(x).alias(f"_sd_{n_}") for n_, x in parts.items()],
    )
    reach = {n_: t_critical(F.col("n"), confidence) * F.col(f"_sd_{n_}") / F.sqrt("n") for n_ in parts}
    out = table.withColumns({f"{n_}_lower": F.col(n_) - r for n_, r in reach.items()} | {f"{n_}_upper": F.col(n_) + r for n_, r in reach.items()})
    out = out.withColumns(
        {
            "rmse": F.sqrt("mse"),
            "rmse_lower": F.sqrt(F.greatest(F.col("mse_lower"), F.lit(0.0))),
            "rmse_upper": F.sqrt("mse_upper"),
        }
    )
    return out.drop(*[f"_sd_{n_}" for n_ in parts])


def interval_coverage(df: DataFrame, *, keys: Sequence[str], y: str = "y", lower: str = "lower", upper: str = "upper") -> DataFrame:
    width = F.col(upper) - F.col(lower)
    inside = F.when(F.col(y).isNotNull() & width.isNotNull(), F.col(y).between(F.col(lower), F.col(upper)).cast("double"))
    return df.groupBy(*keys).agg(
        F.avg(inside).alias("coverage"), F.avg(width).alias("mean_width"), F.stddev_pop(width).alias("std_width")
    )


def test_set_profile(df: DataFrame, *, keys: Sequence[str], date: str, col: str) -> DataFrame:
    """Level and month-to-month growth of a hold-out stretch."""
    w = series_window(keys, date)
    growth = df.withColumn("_g", ratio(F.col(col), F.lag(col).over(w)) - 1)
    return growth.groupBy(*keys).agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean_value"),
        F.stddev_samp(col).alias("std_value"),
        F.avg("_g").alias("mean_growth"),
        F.stddev_samp("_g").alias("std_growth"),
        F.min("_g").alias("min_growth"),
        F.max("_g").alias("max_growth"),
    )


def forecast_wins(df: DataFrame, *, keys: Sequence[str], first: str, second: str, y: str = "y") -> DataFrame:
    """How often each of two forecasts is closer, by absolute, relative and
    ``1 / (|y| + 1)``-weighted squared error."""
    actual = F.col(y)
    e1, e2 = F.abs(actual - F.col(first)), F.abs(actual - F.col(second))
    weight = 1 / (F.abs(actual) + 1)
    scores = {
        "abs": (e1, e2),
        "pct": (ratio(e1, F.abs(actual)), ratio(e2, F.abs(actual))),
        "weighted": (weight * e1 * e1, weight * e2 * e2),
    }
    counts = []
    for name, (a, b) in scores.items():
        counts += [F.count_if(a < b).alias(f"{name}_first_wins"), F.count_if(b < a).alias(f"{name}_second_wins")]
    return df.groupBy(*keys).agg(*counts)


def top_models(metrics: DataFrame, *, keys: Sequence[str], model: str = "model", by: str = "rmse", k: int = 1) -> DataFrame:
    """The ``k`` best models of each key (one row per model and key)."""
    rank = F.row_number().over(series_window(keys, by, model))
    return metrics.withColumn("rank", rank).filter(F.col("rank") <= k)


def performance_band(metrics: DataFrame, *, keys: Sequence[str], r2: str = "r2") -> DataFrame:
    """Mean R2 below 0.3 is poor, below 0.7 moderate, else good."""
    table = metrics.groupBy(*keys).agg(F.avg(r2).alias("mean_r2"))
    return table.withColumn("band", F.when(F.col("mean_r2") < 0.3, "poor").when(F.col("mean_r2") < 0.7, "moderate").otherwise("good"))


def overfitting_class(df: DataFrame, *, keys: Sequence[str], split: str, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Train against test RMSE and R2 and the resulting class."""

    def part(name: str) -> dict[str, Column]:
        here = F.col(split) == name
        cols = metric_columns(F.when(here, F.col(y)), F.when(here, F.col(yhat)))
        return {f"{name}_rmse": cols["rmse"], f"{name}_r2": cols["r2"]}

    both = part("train") | part("test")
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in both.items()])
    rise = ratio(F.col("test_rmse") - F.col("train_rmse"), "train_rmse") * 100
    out = out.withColumns(
        {
            "rmse_diff": F.col("test_rmse") - F.col("train_rmse"),
            "rmse_pct_increase": rise,
            "r2_diff": F.col("train_r2") - F.col("test_r2"),
        }
    )
    severe = (F.col("rmse_pct_increase") > 20) | (F.col("r2_diff") > 0.2)
    moderate = (F.col("rmse_pct_increase") > 10) | (F.col("r2_diff") > 0.1)
    return out.withColumn("status", F.when(severe, "severe").when(moderate, "moderate").otherwise("none"))


def union_results(results: Mapping[str, DataFrame], name: str = "model") -> DataFrame:
    """Stack result tables with the name each came under."""
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(n)) for n, df in results.items()])


def forecast_flatness(df: DataFrame, *, keys: Sequence[str], col: str, min_sd: float = 0.1, min_range: float = 1.0) -> DataFrame:
    """Forecasts that hardly move."""
    table = df.groupBy(*keys).agg(F.stddev_samp(col).alias("std_value"), (F.max(col) - F.min(col)).alias("value_range"))
    flat = (F.col("std_value") < min_sd) | (F.col("value_range") < min_range)
    return table.withColumn("is_flat", F.coalesce(flat, F.lit(False)))
