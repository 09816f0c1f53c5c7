"""Walk-forward windows, refits and fold metrics, all windows in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.expressions import ratio
from seriesloom.functions.windows import position, series_window
from seriesloom.operators.metrics import metric_columns
from seriesloom.operators.stats import covariance, solve_centred


def chrono_split(df: DataFrame, *, keys: Sequence[str], date: str, test_size: float = 0.2) -> DataFrame:
    """Tag the first ``int(n (1 - test_size))`` rows of a series as train."""
    w = series_window(keys, date)
    n = F.count("*").over(Window.partitionBy(*keys))
    cut = F.floor(n * (1 - test_size) + 1e-9)
    return df.withColumn("split", F.when(position(w) < cut, "train").otherwise("test"))


def scale_on_train(df: DataFrame, *, keys: Sequence[str], cols: Sequence[str], method: str = "standard", split: str = "split") -> DataFrame:
    """Standard (population deviation) or min-max scaling, fit on train rows
    of each key, applied to all its rows."""
    on_train = {c: F.when(F.col(split) == "train", F.col(c)) for c in cols}
    if method == "standard":
        shift, size = F.avg, lambda x, w: F.stddev_pop(x).over(w)
    else:
        shift, size = F.min, lambda x, w: F.max(x).over(w) - F.min(x).over(w)
    whole = Window.partitionBy(*keys)
    joined = df.withColumns(
        {f"_a_{c}": shift(x).over(whole) for c, x in on_train.items()} | {f"_b_{c}": size(x, whole) for c, x in on_train.items()}
    )
    scaled = {
        c: ratio(F.col(c) - F.col(f"_a_{c}"), F.when(F.col(f"_b_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_b_{c}")))
        for c in cols
    }
    return joined.withColumns(scaled).drop(*[f"_{s}_{c}" for c in cols for s in "ab"])


@dataclass(frozen=True)
class Walk:
    """Train and test stretches of a series, as a function of its length.

    ``stretches(n)`` is an array of structs ``(window, train_rows, test_from,
    test_rows)``: train on the first ``train_rows`` rows, test on
    ``test_rows`` rows from position ``test_from``.
    """

    stretches: Callable[[Column], Column]


def _stretch(window, train_rows, test_from, test_rows) -> Column:
    parts = {"window": window, "train_rows": train_rows, "test_from": test_from, "test_rows": test_rows}
    return F.struct(*[c.cast("int").alias(n) for n, c in parts.items()])


def walk_forward(*, min_train: int = 24, window: int = 12, step: int = 3) -> Walk:
    """Expanding windows: the test stretch starts at ``min_train`` and moves
    on by ``step`` rows while ``window`` rows fit."""

    def stretches(n: Column) -> Column:
        last = n - window
        starts = F.when(last >= min_train, F.sequence(F.lit(min_train), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: _stretch((i - min_train) / step, i, i, F.lit(window)))

    return Walk(stretches)


def time_ordered_folds(folds: int = 5, *, test_rows: Callable[[Column], Column] | None = None) -> Walk:
    """``n // (folds + 1)`` test rows per fold (or ``test_rows(n)``),
    everything before as train."""

    def stretches(n: Column) -> Column:
        size = (test_rows(n) if test_rows else F.floor(n / (folds + 1))).cast("int")
        numbers = F.sequence(F.lit(0), F.lit(folds - 1))
        parts = F.transform(numbers, lambda f: _stretch(f, n - size * (folds - f), n - size * (folds - f), size))
        return F.filter(parts, lambda x: (x["train_rows"] > 0) & (size > 0))

    return Walk(stretches)


def ensemble_folds(folds: int = 5) -> Walk:
    """Folds of ``max(5, n // 20)`` test rows, as used for ensemble weights."""
    return time_ordered_folds(folds, test_rows=lambda n: F.greatest(F.lit(5), F.floor(n / 20)))


def _numbered(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    return df.withColumns(
        {"_pos": position(series_window(keys, date)), "_n": F.count("*").over(Window.partitionBy(*keys)).cast("int")}
    )


def _expand(numbered: DataFrame, walk: Walk, first: Callable[[Column], Column]) -> DataFrame:
    """Each row once per stretch that uses it: positions ``first(stretch)``
    up to the end of the test rows.  Works on the row alone, so no join and
    no shuffle is needed."""
    used = F.filter(
        walk.stretches(F.col("_n")),
        lambda x: (F.col("_pos") >= first(x)) & (F.col("_pos") < x["test_from"] + x["test_rows"]),
    )
    return numbered.withColumn("_w", F.explode(used)).select("*", "_w.*").drop("_w")


def backtest_windows(df: DataFrame, walk: Walk, *, keys: Sequence[str], date: str) -> DataFrame:
    """``(keys, window, test_from, train_start, train_end, test_start, test_end)``."""
    d = F.col(date).cast("date")
    rows = _expand(_numbered(df.select(*keys, d.alias(date)), keys, date), walk, lambda x: F.lit(0))
    train, test = F.col("_pos") < F.col("train_rows"), F.col("_pos") >= F.col("test_from")
    return rows.groupBy(*keys, "window", "test_from").agg(
        F.min(F.when(train, F.col(date))).alias("train_start"),
        F.max(F.when(train, F.col(date))).alias("train_end"),
        F.min(F.when(test, F.col(date))).alias("test_start"),
        F.max(F.when(test, F.col(date))).alias("test_end"),
    )


def backtest_split(df: DataFrame, walk: Walk, *, keys: Sequence[str], date: str) -> DataFrame:
    """Every row of every window with its ``split``."""
    rows = _expand(_numbered(df, keys, date), walk, lambda x: F.lit(0))
    rows = rows.withColumn("split", F.when(F.col("_pos") < F.col("train_rows"), "train").when(F.col("_pos") >= F.col("test_from"), "test"))
    return rows.filter(F.col("split").isNotNull()).select(*df.columns, "window", "split")


def backtest_naive(df: DataFrame, walk: Walk, *, keys: Sequence[str], date: str, target: str, season: int = 1) -> DataFrame:
    """The last value before the window, or with ``season`` the value at the
    same phase of the last season before it."""
    rows = _expand(_numbered(df.select(*keys, date, target), keys, date), walk, lambda x: x["train_rows"] - season)
    phase = F.pmod(F.col("_pos") - F.col("train_rows"), F.lit(season)).alias("_phase")
    rows = rows.select("*", phase)
    group = Window.partitionBy(*keys, "window", "_phase")
    known = F.max(F.when(F.col("_pos") < F.col("train_rows"), F.col(target))).over(group)
    rows = rows.withColumn("predicted_value", known).filter(F.col("_pos") >= F.col("test_from"))
    return rows.select(*keys, "window", date, F.col(target).alias("true_value"), "predicted_value")


def backtest_linear(df: DataFrame, walk: Walk, *, keys: Sequence[str], date: str, target: str, features: Sequence[str], alpha: float = 0.0) -> DataFrame:
    """Refit on every window without touching its train rows again.

    Running moments over the series give the moments of every train range at
    its last row, which is carried along with the test rows.  The running
    state holds k (k + 3) / 2 numbers, which suits up to about thirty
    features.  One shuffle by key serves all windows.
    """
    names = [*features, target]
    frame = series_window(keys, date).rowsBetween(Window.unboundedPreceding, 0)
    complete = F.lit(True)
    for c in names:
        complete = complete & F.col(c).isNotNull()
    masked = _numbered(df.select(*keys, date, *[F.col(c).cast("double").alias(c) for c in names]), keys, date)
    masked = masked.withColumns({f"_v_{c}": F.when(complete, F.col(c)) for c in names})
    held = [f"_v_{c}" for c in names]
    running = masked.withColumns(
        {
            "n": F.count(held[-1]).over(frame),
            "means": F.array(*[F.avg(c).over(frame) for c in held]),
            "covs": F.array(*[F.covar_pop(a, b).over(frame) for a, b in combinations_with_replacement(held, 2)]),
        }
    ).drop(*held)
    # The train range may end before the test rows begin; its last row is kept.
    rows = _expand(running, walk, lambda x: x["train_rows"] - 1)
    at_end = F.col("_pos") == F.col("train_rows") - 1
    rows = rows.filter(at_end | (F.col("_pos") >= F.col("test_from")))
    state = F.struct("n", "means", "covs")
    rows = rows.withColumn("_m", F.max_by(state, F.when(at_end, F.lit(1))).over(Window.partitionBy(*keys, "window")))
    test = rows.filter(F.col("_pos") >= F.col("test_from"))
    if len(features) == 1 and not alpha:
        slope = ratio(F.col("_m.covs")[1], F.col("_m.covs")[0])
        value = F.col("_m.means")[1] + slope * (F.col(features[0]) - F.col("_m.means")[0])
        predicted = test.withColumn("predicted_value", value)
    else:
        predicted = _solve_rows(test, keys, date, names, alpha)
    return predicted.select(*keys, "window", date, F.col(target).alias("true_value"), "predicted_value")


def _solve_rows(test: DataFrame, keys: Sequence[str], date: str, names: Sequence[str], alpha: float) -> DataFrame:
    """Predict test rows whose moments travel with them, batch by batch; rows
    of one window share their moments and are solved once."""
    size = len(names)

    def predict(batches):
        for pdf in batches:
            values = np.full(len(pdf), np.nan)
            solved: dict = {}
            for i, (n, m, c, x) in enumerate(zip(pdf["n"], pdf["means"], pdf["covs"], pdf[list(names[:-1])].to_numpy(float))):
                if not n or n < 2:
                    continue
                at = (n, *m)
                if at not in solved:
                    solved[at] = solve_centred(covariance(c, size), np.array(m, dtype=float), alpha / n)
                values[i] = solved[at][1] + x @ solved[at][0]
            yield pdf.drop(columns=["n", "means", "covs"]).assign(predicted_value=values)

    sent = test.select(*keys, "window", date, *names, "_m.n", "_m.means", "_m.covs")
    kept = [f for f in sent.schema.fields if f.name not in ("n", "means", "covs")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", predicted_value double"
    out = sent.mapInPandas(predict, schema)
    return out.withColumn("predicted_value", F.when(~F.isnan("predicted_value"), F.col("predicted_value")))


def backtest_records(predictions: DataFrame, *, keys: Sequence[str], log_target: bool = False) -> DataFrame:
    """Per-row errors on the original scale beside the metrics of the window."""
    back = F.exp if log_target else (lambda x: x)
    rows = predictions.withColumns(
        {"true_value_original": back(F.col("true_value")), "predicted_value_original": back(F.col("predicted_value"))}
    )
    e = F.col("true_value_original") - F.col("predicted_value_original")
    rows = rows.withColumns({"error": e, "squared_error": e * e, "absolute_error": F.abs(e)})
    whole = Window.partitionBy(*keys, "window")
    rows = rows.withColumns(
        {
            "window_mse": F.avg("squared_error").over(whole),
            "window_mae": F.avg("absolute_error").over(whole),
            "_var": F.var_pop(F.when(e.isNotNull(), F.col("true_value_original"))).over(whole),
        }
    )
    return rows.withColumns(
        {"window_rmse": F.sqrt("window_mse"), "window_r2": 1 - ratio("window_mse", "_var")}
    ).drop("_var")


def window_metrics(rows: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    cols = metric_columns("true_value_original", "predicted_value_original")
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()])


def backtest_metrics(rows: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Metrics over all windows of a key with the +-1.96 sd error band."""
    cols = metric_columns("true_value_original", "predicted_value_original")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *[c.alias(n) for n, c in cols.items()], F.stddev_samp("error").alias("error_std")
    )
    return out.withColumns({"band_lower": F.col("error_std") * -1.96, "band_upper": F.col("error_std") * 1.96})


def fold_summary(rows: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the fold metrics."""
    folds = window_metrics(rows, keys=[*keys, "window"])
    names = ("mae", "rmse", "r2")
    return folds.groupBy(*keys).agg(
        F.count("*").alias("folds"),
        *[F.avg(m).alias(f"{m}_mean") for m in names],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in names],
    )


def learning_curve(df: DataFrame, *, keys: Sequence[str], date: str, target: str, features: Sequence[str], sizes: int = 10, folds: int = 5) -> DataFrame:
    """Test RMSE of a linear fit for growing shares of every fold's train rows.

    Each share is a train range that ends earlier, so running moments serve
    all ``sizes * folds`` fits in one pass.
    """
    least = len(features) + 2
    steps = F.sequence(F.lit(1), F.lit(sizes))

    def shares(n: Column) -> Column:
        def of_fold(x: Column) -> Column:
            rows = lambda k: F.greatest(F.floor(x["train_rows"] * k / sizes), F.lit(least))
            return F.transform(steps, lambda k: _stretch(x["window"] * sizes + k, rows(k), x["test_from"], x["test_rows"]))

        grown = F.flatten(F.transform(time_ordered_folds(folds).stretches(n), of_fold))
        return F.filter(grown, lambda x: x["train_rows"] <= x["test_from"])

    fitted = backtest_linear(df, Walk(shares), keys=keys, date=date, target=target, features=features)
    rows = fitted.withColumns(
        {
            "fold": F.floor((F.col("window") - 1) / sizes).cast("int"),
            "size_step": (F.pmod(F.col("window") - 1, F.lit(sizes)) + 1).cast("int"),
        }
    )
    e = F.col("true_value") - F.col("predicted_value")
    per_fold = rows.groupBy(*keys, "size_step", "fold").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return per_fold.groupBy(*keys, "size_step").agg(F.avg("rmse").alias("test_rmse_mean"), F.stddev_pop("rmse").alias("test_rmse_std"))
