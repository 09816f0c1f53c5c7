"""Walk-forward tests that refit a scaler and a model on every window.

Each (series, window) is one grouped call, dealt to tasks by series and window: the fits
cost far more than the rows of a panel that are repeated for them.  The scaler and the
model only see the train rows of their window, so nothing of the test rows leaks.

A train row with a gap in the target or a feature is left out of the fit; any row with a
gap in a feature has no prediction, as have all rows of a window with fewer than two
complete train rows.  A feature that is constant over the train rows is scaled to 0.
Equal inputs give equal results: draws are seeded by ``seed`` and the window alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.windows import spread
from seriesloom.operators.backtest import Walk, _expand, _numbered
from seriesloom.operators.metrics import metric_columns

Predictor = Callable[[np.ndarray], np.ndarray]


def ridge(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, alpha: float = 0.0) -> Predictor:
    """Least squares with a penalty on the slopes, not on the intercept."""
    mid, level = x.mean(axis=0), y.mean()
    centred = x - mid
    slopes = np.linalg.lstsq(centred.T @ centred + alpha * np.eye(x.shape[1]), centred.T @ (y - level), rcond=None)[0]
    return lambda new: level + (new - mid) @ slopes


def _best_cut(x: np.ndarray, y: np.ndarray, columns: np.ndarray, min_leaf: int) -> tuple[float, int, float]:
    """(squared error saved, feature, limit) of the best split between two neighbouring values."""
    best, n = (0.0, -1, 0.0), len(y)
    for j in columns:
        order = np.argsort(x[:, j], kind="stable")
        value, left = x[order, j], np.cumsum(y[order])[:-1]
        size = np.arange(1, n)
        saved = left**2 / size + (y.sum() - left) ** 2 / (n - size) - y.sum() ** 2 / n
        saved[(value[1:] == value[:-1]) | (size < min_leaf) | (n - size < min_leaf)] = 0
        k = int(saved.argmax()) if n > 1 else 0
        if n > 1 and saved[k] > best[0] * (1 + 1e-12) + 1e-12:
            best = float(saved[k]), int(j), float((value[k] + value[k + 1]) / 2)
    return best


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, min_leaf: int, share: float) -> Predictor:
    """A regression tree; each split looks at a drawn share of the features."""
    width = max(1, round(share * x.shape[1]))
    saved, j, limit = _best_cut(x, y, rng.permutation(x.shape[1])[:width], min_leaf) if depth else (0.0, -1, 0.0)
    if not saved:
        level = y.mean()
        return lambda new: np.full(len(new), level)
    low = x[:, j] <= limit
    below, above = (_tree(x[side], y[side], rng, depth - 1, min_leaf, share) for side in (low, ~low))

    def predict(new: np.ndarray) -> np.ndarray:
        out, side = np.empty(len(new)), new[:, j] <= limit
        out[side], out[~side] = below(new[side]), above(new[~side])
        return out

    return predict


def forest(x, y, rng, trees: int = 50, depth: int = 6, min_leaf: int = 2, share: float = 1.0) -> Predictor:
    """Mean of trees, each grown on rows drawn with replacement."""
    grown = []
    for _ in range(trees):
        drawn = rng.integers(0, len(y), len(y))
        grown.append(_tree(x[drawn], y[drawn], rng, depth, min_leaf, share))
    return lambda new: np.mean([tree(new) for tree in grown], axis=0)


def boosted(x, y, rng, trees: int = 100, depth: int = 3, rate: float = 0.1, min_leaf: int = 1, share: float = 1.0) -> Predictor:
    """Trees grown in turn on what is left of the target."""
    level, rest, grown = y.mean(), y - y.mean(), []
    for _ in range(trees):
        grown.append(_tree(x, rest, rng, depth, min_leaf, share))
        rest = rest - rate * grown[-1](x)
    return lambda new: level + rate * np.sum([tree(new) for tree in grown], axis=0)


MODELS = {"ridge": ridge, "forest": forest, "boosted": boosted}


def scaled(train: np.ndarray) -> Predictor:
    """Centre and scale by the mean and population deviation of the train rows."""
    mid, spread = train.mean(axis=0), train.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    return lambda x: (x - mid) / spread


def backtest_refit(
    df: DataFrame, walk: Walk, *, keys: Sequence[str], date: str, target: str, features: Sequence[str], model: str = "ridge", scale: bool = True, seed: int = 42, **options
) -> DataFrame:
    """``(keys, window, split, date, true_value, predicted_value)`` of the train and the test rows of every window."""
    fit, names = MODELS[model], list(features)
    values = {c: F.col(c).cast("double").alias(c) for c in dict.fromkeys([*names, target])}
    rows = _expand(_numbered(df.select(*keys, date, *values.values()), keys, date), walk, lambda x: F.lit(0))
    train, test = F.col("_pos") < F.col("train_rows"), F.col("_pos") >= F.col("test_from")
    rows = rows.withColumn("split", F.when(train, "train").when(test, "test")).filter(F.col("split").isNotNull())
    sent = rows.select(*keys, "window", "split", F.col(date), F.col("_pos"), *values)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        x, y = pdf[names].to_numpy(float), pdf[target].to_numpy(float)
        whole = ~np.isnan(x).any(axis=1)
        known = whole & ~np.isnan(y) & (pdf["split"] == "train").to_numpy()
        predicted = np.full(len(pdf), np.nan)
        if known.sum() >= 2:
            change = scaled(x[known]) if scale else (lambda v: v)
            rng = np.random.default_rng([seed, int(pdf["window"].iloc[0])])
            predicted[whole] = fit(change(x[known]), y[known], rng, **options)(change(x[whole]))
        return pdf.drop(columns=["_pos", *names, target]).assign(true_value=y, predicted_value=predicted)

    kept = [f for f in sent.schema.fields if f.name not in ("_pos", *names, target)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", true_value double, predicted_value double"
    out = spread(sent, [*keys, "window"]).groupBy(*keys, "window").applyInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("true_value", "predicted_value")})


def split_metrics(rows: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Train and test metrics of every window side by side, and the rise of the error from train to test in percent."""

    def side(name: str) -> list[Column]:
        y, p = (F.when(F.col("split") == name, F.col(c)) for c in ("true_value", "predicted_value"))
        return [c.alias(f"{name}_{m}") for m, c in metric_columns(y, p).items() if m in ("mae", "rmse", "r2")]

    out = rows.groupBy(*keys, "window").agg(*side("train"), *side("test"))
    rise = F.when(F.col("train_rmse") > 0, (F.col("test_rmse") / F.col("train_rmse") - 1) * 100)
    return out.withColumn("rmse_rise_pct", rise)
