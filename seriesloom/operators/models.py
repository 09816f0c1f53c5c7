"""Model fits on panels with Spark ML, and per-series seasonal models."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import month_end_after, wave
from seriesloom.functions.windows import position, rolling, series_window, spread
from seriesloom.operators.features import lag_exprs
from seriesloom.session import held, settled

# The reduced-complexity presets.
FOREST = {"numTrees": 50, "maxDepth": 5, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt", "seed": 42}
BOOSTED = {"maxIter": 50, "stepSize": 0.05, "maxDepth": 3, "minInstancesPerNode": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "sqrt", "seed": 42}
PARTS, PART_ROWS = 8, 10_000
RIDGE_ALPHA, LASSO_ALPHA, ELASTIC_NET = 1.0, 0.1, (0.1, 0.5)


def design_frame(df: DataFrame, *, keys: Sequence[str], date: str, target: str, indicators: Sequence[str] = (), season: int = 12) -> tuple[DataFrame, list[str]]:
    """Features known before each date, and their names: the target and its
    transforms of the same date are left out, keys and dates are no features."""
    w = series_window(keys, date)
    out = df.withColumns(lag_exprs([target], (1, 2, 3, season), w) | lag_exprs(indicators, (1,), w))
    last = f"{target}_lag_1"
    made = {f"{target}_ma_{n}": rolling(last, n, F.avg, w) for n in (3, 6, 12)}
    made[f"{target}_volatility_6"] = rolling(last, 6, F.stddev_samp, w)
    made |= {"trend": position(w).cast("double"), "month_sin": wave(F.sin, F.month(date), 12), "month_cos": wave(F.cos, F.month(date), 12)}
    out = out.withColumns(made)
    names = [*lag_exprs([target], (1, 2, 3, season), w), *lag_exprs(indicators, (1,), w), *made]
    return out.na.drop("any", subset=names), names


def packed(df: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """``df`` settled, with the rows of a key in one partition and no more partitions than its rows need.

    A search runs a thousand jobs or more with a task for every partition of its frame, most of them empty where a
    small panel comes from a wide shuffle.  Bootstrap draws follow the partitions, so their number only depends on
    the rows, and on ``spark.sql.shuffle.partitions`` where that is smaller.
    """
    df = settled(df)
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(most, max(PARTS, df.count() // PART_ROWS)), *keys)


def _fit(estimator, train: DataFrame, features: Sequence[str]) -> PipelineModel:
    """Fit on a persisted narrow frame; an iterative fit reads it many times."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="features"), estimator]
    with held(train.select(*features, estimator.getLabelCol())) as frame:
        return Pipeline(stages=stages).fit(frame)


def fit_forest(train: DataFrame, features: Sequence[str], target: str, **params) -> PipelineModel:
    return _fit(RandomForestRegressor(labelCol=target, predictionCol="yhat", **{**FOREST, **params}), train, features)


def fit_boosted(train: DataFrame, features: Sequence[str], target: str, **params) -> PipelineModel:
    return _fit(GBTRegressor(labelCol=target, predictionCol="yhat", **{**BOOSTED, **params}), train, features)


def fit_lasso(train: DataFrame, features: Sequence[str], target: str, *, alpha: float = LASSO_ALPHA) -> PipelineModel:
    """Objective ``SSE / 2n + alpha |b|_1``."""
    lr = LinearRegression(labelCol=target, predictionCol="yhat", regParam=alpha, elasticNetParam=1.0, standardization=False)
    return _fit(lr, train, features)


def fit_elastic_net(train: DataFrame, features: Sequence[str], target: str, *, alpha: float = ELASTIC_NET[0], l1_ratio: float = ELASTIC_NET[1]) -> PipelineModel:
    """Objective ``SSE / 2n + alpha r |b|_1 + alpha (1-r) / 2 |b|_2^2``.

    Spark divides the squared term by the label's deviation, which the two
    parameters make up for.
    """
    sd = train.agg(F.stddev_samp(target)).first()[0] or 1.0
    one, two = alpha * l1_ratio, alpha * (1 - l1_ratio) * sd
    reg = one + two
    lr = LinearRegression(labelCol=target, predictionCol="yhat", regParam=reg, elasticNetParam=one / reg if reg else 0.0, standardization=False)
    return _fit(lr, train, features)


def score(model: PipelineModel, df: DataFrame, *, keep: Sequence[str], target: str) -> DataFrame:
    return model.transform(df).select(*keep, F.col(target).alias("y"), "yhat")


# ------------------------------------------------------------ search


def time_folds(df: DataFrame, *, date: str, folds: int) -> list[tuple]:
    """``(train_end, test_end)`` dates: equal stretches of the calendar,
    everything before as train.  Collects the distinct dates only."""
    dates = [row[0] for row in df.select(date).distinct().orderBy(date).collect()]
    size = len(dates) // (folds + 1)
    cuts = [len(dates) - size * (folds - i) for i in range(folds)]
    return [(dates[c - 1], dates[c + size - 1]) for c in cuts if size and c > 0]


def sample_parameters(space: Mapping[str, Sequence], n_iter: int, seed: int = 42) -> list[dict]:
    """Seeded random sample of a parameter grid without repetition."""
    rng, seen = random.Random(seed), []
    total = reduce(lambda a, v: a * len(v), space.values(), 1)
    while len(seen) < min(n_iter, total):
        drawn = {k: rng.choice(list(v)) for k, v in space.items()}
        if drawn not in seen:
            seen.append(drawn)
    return seen


def hyperparameter_search(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    *,
    date: str,
    family: str,
    space: Mapping[str, Sequence],
    n_iter: int = 50,
    folds: int = 5,
    parallelism: int = 4,
) -> DataFrame:
    """Mean and deviation of the fold MSE of every sampled setting, ranked.

    Folds are ordered in time.  The frame is held once for all fits; fits of
    different settings run side by side from a small thread pool.
    """
    fit = {"forest": fit_forest, "boosted": fit_boosted}[family]
    settings = sample_parameters(space, n_iter)
    with held(df.select(date, *features, target)) as frame:
        cuts = time_folds(frame, date=date, folds=folds)

        def mse(job: tuple[int, tuple]) -> tuple[int, float | None]:
            i, (train_end, test_end) = job
            model = fit(frame.filter(F.col(date) <= F.lit(train_end)), features, target, **settings[i])
            test = frame.filter((F.col(date) > F.lit(train_end)) & (F.col(date) <= F.lit(test_end)))
            return i, model.transform(test).agg(F.avg(F.pow(F.col(target) - F.col("yhat"), 2))).first()[0]

        with ThreadPoolExecutor(parallelism) as pool:
            scored = list(pool.map(mse, [(i, c) for i in range(len(settings)) for c in cuts]))
    rows = []
    for i, params in enumerate(settings):
        values = [v for j, v in scored if j == i and v is not None]
        rows.append((i, ", ".join(f"{k}={v}" for k, v in params.items()), float(np.mean(values)), float(np.std(values))))
    rows.sort(key=lambda x: x[2])
    ranked = [(rank + 1, *row) for rank, row in enumerate(rows)]
    return df.sparkSession.createDataFrame(ranked, "rank int, setting int, params string, mean_mse double, std_mse double")


def best_model(
    df: DataFrame, features: Sequence[str], target: str, *, date: str, family: str, space: Mapping[str, Sequence], n_iter: int = 50, **search
) -> tuple[PipelineModel, dict, DataFrame]:
    """The best setting of ``hyperparameter_search`` fitted on all rows, that setting, and the ranked table."""
    table = hyperparameter_search(df, features, target, date=date, family=family, space=space, n_iter=n_iter, **search)
    params = sample_parameters(space, n_iter)[table.filter("rank = 1").first().setting]
    return {"forest": fit_forest, "boosted": fit_boosted}[family](df, features, target, **params), params, table


def frozen_forecast(model: PipelineModel, df: DataFrame, features: Sequence[str], *, keys: Sequence[str], date: str, periods: int = 12) -> DataFrame:
    """Model forecast with every feature held at its last row."""
    packed = F.max_by(F.struct(*features), F.col(date)).alias("_f")
    last = df.groupBy(*keys).agg(packed, F.max(date).alias("_last"))
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    rows = steps.select(*keys, "step", month_end_after("_last", "step").alias(date), "_f.*")
    return model.transform(rows).select(*keys, "step", date, F.col("yhat").alias("forecast"))


# ------------------------------------------------------------ per-series models


def _difference(y: np.ndarray, lag: int) -> np.ndarray:
    return y[lag:] - y[:-lag]


def _lagged(x: np.ndarray, lags: Sequence[int], start: int) -> np.ndarray:
    return np.column_stack([x[start - k : len(x) - k] for k in lags]) if lags else np.empty((len(x) - start, 0))


STABLE_RADIUS = 0.99


def _radius(weights: np.ndarray, lags: Sequence[int]) -> float:
    """Largest inverse root of ``1 - sum w_k B^k``; below 1 means that all
    roots lie outside the unit circle."""
    if not lags:
        return 0.0
    poly = np.zeros(max(lags) + 1)
    poly[0] = 1.0
    poly[list(lags)] = -weights
    return float(np.abs(np.roots(poly)).max(initial=0.0))


def seasonal_arma(y: np.ndarray, order: tuple[int, int, int], seasonal: tuple[int, int, int], m: int) -> dict | None:
    """Two-stage least squares: residuals of a long autoregression stand in
    for the shocks, then AR and MA terms are one regression.  Explosive AR terms
    are shrunk to just inside the stationary region.  None when the series is
    too short."""
    (p, d, q), (sp, sd, sq) = order, seasonal
    steps = [m] * sd + [1] * d
    z = reduce(_difference, steps, y) if len(y) > sum(steps) else np.empty(0)
    ar = [*range(1, p + 1), *[m * i for i in range(1, sp + 1)]]
    ma = [*range(1, q + 1), *[m * i for i in range(1, sq + 1)]]
    long = min(max([*ar, *ma, 1]), max(len(z) // 4, 1))
    start = long + max([*ma, 0]) if ma else max([*ar, 0])
    start = max([start, *ar])
    k = len(ar) + len(ma) + 1
    if len(z) - start < k + 3:
        return None
    shocks = np.zeros(len(z))
    if ma:
        first = np.column_stack([np.ones(len(z) - long), _lagged(z, range(1, long + 1), long)])
        shocks[long:] = z[long:] - first @ np.linalg.lstsq(first, z[long:], rcond=None)[0]
    design = np.column_stack([np.ones(len(z) - start), _lagged(z, ar, start), _lagged(shocks, ma, start)])
    beta = np.linalg.lstsq(design, z[start:], rcond=None)[0]
    radius = _radius(beta[1 : len(ar) + 1], ar)
    if radius >= 1:
        # Pull explosive roots back, or the forecast grows without bound.
        beta[1 : len(ar) + 1] *= (STABLE_RADIUS / radius) ** np.array(ar)
        beta[0] = np.mean(z[start:] - design[:, 1:] @ beta[1:])
    residual = z[start:] - design @ beta
    n, sigma2 = len(residual), max(float(np.mean(residual**2)), 1e-300)
    fit = n * np.log(sigma2)
    shocks[start:] = residual
    return {"beta": beta, "ar": ar, "ma": ma, "z": z, "shocks": shocks, "steps": steps, "sigma2": sigma2, "stationary": radius < 1, "aic": fit + 2 * k, "bic": fit + np.log(n) * k}


def _extend(beta, ar, ma, z, shocks, h: int) -> np.ndarray:
    z, shocks = list(z), [*shocks, *[0.0] * h]
    for t in range(len(z), len(z) + h):
        terms = [1.0, *[z[t - k] for k in ar], *[shocks[t - k] for k in ma]]
        z.append(float(np.dot(beta, terms)))
    return np.array(z[-h:])


def _integrate(future: np.ndarray, y: np.ndarray, steps: Sequence[int]) -> np.ndarray:
    """Undo the differences in reverse order."""
    levels = [y]
    for lag in steps:
        levels.append(_difference(levels[-1], lag))
    for lag, base in zip(reversed(steps), reversed(levels[:-1])):
        path = list(base)
        for value in future:
            path.append(value + path[-lag])
        future = np.array(path[len(base) :])
    return future


def arma_forecast(y: np.ndarray, fit: Mapping, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Point forecast and standard error of every step."""
    ahead = _extend(fit["beta"], fit["ar"], fit["ma"], fit["z"], fit["shocks"], h)
    pad = max([*fit["ar"], *fit["ma"], 1])
    impulse = np.zeros(pad + 1)
    impulse[-1] = 1.0
    no_constant = np.concatenate([[0.0], fit["beta"][1:]])
    response = np.concatenate([[1.0], _extend(no_constant, fit["ar"], fit["ma"], impulse, impulse, h)])[:h]
    psi = _integrate(response, np.zeros(sum(fit["steps"]) + 1), fit["steps"])
    return _integrate(ahead, y, fit["steps"]), np.sqrt(fit["sigma2"] * np.cumsum(psi**2))


def on_calendar(pdf: pd.DataFrame, date: str, value: str, every: int = 1) -> tuple[np.ndarray, object]:
    """Values of one series on every period of ``every`` months from its first to its
    last observed one, and the last date.  A period with several rows takes its
    last one; gaps are filled on a straight line, so lag ``m`` is the same season."""
    seen = pdf[pdf[value].notna()].sort_values([date, value])
    if not len(seen):
        return np.zeros(0), None
    when = pd.to_datetime(seen[date])
    period = (when.dt.year * 12 + when.dt.month - 1).to_numpy() // every
    last = np.append(period[1:] != period[:-1], True)
    at = np.arange(period[0], period[-1] + 1)
    return np.interp(at, period[last], seen[value].to_numpy(float)[last]), seen[date].iloc[-1]


def panel_arima(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    value: str,
    order: tuple[int, int, int] = (1, 1, 1),
    seasonal: tuple[int, int, int] = (1, 1, 1),
    m: int = 12,
    periods: int = 12,
    log: bool = True,
    every: int = 1,
) -> DataFrame:
    """Seasonal ARIMA forecast with 95 % bounds, one model per series.

    A period is ``every`` months (3 for quarters) and a season ``m`` periods.
    Each grouped-map call holds one series of the panel (its calendar's
    length); Spark spreads the series over the executors.  Estimates are
    two-stage least squares, so they differ from exact likelihood by design.
    A series too short for the model gives one row without a forecast, whose
    ``reason`` says so; it is NULL on all other rows.
    """
    fields = [f for f in df.schema.fields if f.name in keys]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", step int, last date, forecast double, lower_95 double, upper_95 double, reason string"
    columns = [*names, "step", "last", "forecast", "lower_95", "upper_95", "reason"]

    def forecast(pdf: pd.DataFrame) -> pd.DataFrame:
        y, last = on_calendar(pdf, date, value, every)
        shift = max(-y.min(), 0.0) if log and len(y) else 0.0
        x = np.log1p(y + shift) if log else y
        fit = seasonal_arma(x, order, seasonal, m)
        if fit is None:
            none = dict.fromkeys(columns) | {k: pdf[k].iloc[0] for k in names} | {"reason": f"{len(y)} periods are too few"}
            return pd.DataFrame([none], columns=columns).astype({c: float for c in ("forecast", "lower_95", "upper_95")})
        mean, se = arma_forecast(x, fit, periods)
        bands = [mean, mean - 1.96 * se, mean + 1.96 * se]
        if log:
            bands = [np.expm1(b) - shift for b in bands]
        out = pd.DataFrame(dict(zip(("forecast", "lower_95", "upper_95"), bands)))
        out["step"], out["last"] = np.arange(1, periods + 1), last
        out["reason"] = None
        for k in names:
            out[k] = pdf[k].iloc[0]
        return out[columns]

    narrow = df.select(*names, F.col(date).cast("date").alias(date), F.col(value).cast("double").alias(value))
    made = spread(narrow, names).groupBy(*names).applyInPandas(forecast, schema)
    ahead = month_end_after("last", F.col("step") * every)
    return made.select(*names, "step", ahead.alias(date), "forecast", "lower_95", "upper_95", "reason")


def order_fits(y: np.ndarray, orders: Sequence[tuple[int, int, int]], seasonal: tuple[int, int, int], m: int) -> dict[tuple, dict]:
    """Two-stage fits of all orders over the same dates, so that their criteria compare.

    One long autoregression per ``d`` gives the shocks of all its orders.  The
    common sample starts where the order that looks back farthest can; orders are
    taken by how far they look back, and those that would leave fewer rows
    than parameters and three to any order taken before are not fitted.
    """
    sp, sd, sq = seasonal
    plans = {}
    for d in sorted({o[1] for o in orders}):
        steps = [m] * sd + [1] * d
        z = reduce(_difference, steps, y) if len(y) > sum(steps) else np.empty(0)
        lags = {o: ([*range(1, o[0] + 1), *[m * i for i in range(1, sp + 1)]], [*range(1, o[2] + 1), *[m * i for i in range(1, sq + 1)]]) for o in orders if o[1] == d}
        long = min(max([1, *[k for both in lags.values() for side in both for k in side]]), max(len(z) // 4, 1))
        for o, (ar, ma) in lags.items():
            start = max([*ar, long + max(ma) if ma else 0, 0])
            plans[o] = (sum(steps) + start, len(ar) + len(ma) + 1, z, ar, ma, long, sum(steps))
    taken, first, widest = [], 0, 0
    for o in sorted(plans, key=lambda o: (*plans[o][:2], o)):
        begin, k = max(first, plans[o][0]), max(widest, plans[o][1])
        if len(y) - begin >= k + 3:
            taken, first, widest = [*taken, o], begin, k
    shocks, out = {}, {}
    for o in taken:
        _, k, z, ar, ma, long, lost = plans[o]
        if ma and o[1] not in shocks:
            design = np.column_stack([np.ones(len(z) - long), _lagged(z, range(1, long + 1), long)])
            e = np.zeros(len(z))
            e[long:] = z[long:] - design @ np.linalg.lstsq(design, z[long:], rcond=None)[0]
            shocks[o[1]] = e
        start = first - lost
        design = np.column_stack([np.ones(len(z) - start), _lagged(z, ar, start), _lagged(shocks[o[1]] if ma else z, ma, start)])
        beta = np.linalg.lstsq(design, z[start:], rcond=None)[0]
        n, sigma2 = len(z) - start, max(float(np.mean((z[start:] - design @ beta) ** 2)), 1e-300)
        out[o] = {
            "n": n,
            "aic": n * np.log(sigma2) + 2 * k,
            "bic": n * np.log(sigma2) + np.log(n) * k,
            "stationary": _radius(beta[1 : len(ar) + 1], ar) < 1,
            "invertible": _radius(-beta[len(ar) + 1 :], ma) < 1,
        }
    return out


# The largest p, d and q of the order search.
LARGEST_ORDER = (3, 2, 3)


def all_orders(largest: tuple[int, int, int] = LARGEST_ORDER) -> list[tuple[int, int, int]]:
    return list(product(*[range(v + 1) for v in largest]))


def arima_grid(
    df: DataFrame,
    *,
    keys: Sequence[str],
    date: str,
    value: str,
    orders: Sequence[tuple[int, int, int]] | None = None,
    seasonal: tuple[int, int, int] = (0, 0, 0),
    m: int = 12,
    every: int = 1,
    criterion: str = "aic",
) -> DataFrame:
    """AIC and BIC of every order (``all_orders()`` by default) for every series.

    ``n`` rows are common to all orders of a series.  ``stationary`` and
    ``invertible`` tell whether the AR and MA roots as estimated lie outside the
    unit circle; the best order is the one with the smallest criterion among
    those where both do, the smallest (p, d, q) on a tie.  An order that a
    series is too short for has NULL in all of these.

    One grouped-map call holds a series once and fits all its orders, so no row
    is repeated.
    """
    tried = list(dict.fromkeys(tuple(o) for o in (all_orders() if orders is None else orders)))
    fields = [f for f in df.schema.fields if f.name in keys]
    names = [f.name for f in fields]
    measures = {"n": "long", "aic": "double", "bic": "double", "stationary": "boolean", "invertible": "boolean"}
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "p int, d int, q int", *[f"{c} {t}" for c, t in measures.items()]])

    def fit_all(pdf: pd.DataFrame) -> pd.DataFrame:
        y, _ = on_calendar(pdf, date, value, every)
        fits = order_fits(y, tried, seasonal, m)
        out = pd.DataFrame([{**dict(zip("pdq", o)), **dict.fromkeys(measures), **fits.get(o, {})} for o in tried])
        for k in names:
            out[k] = pdf[k].iloc[0]
        kinds = {"n": "Int64", "aic": "Float64", "bic": "Float64", "stationary": "boolean", "invertible": "boolean"}
        return out.astype(kinds)[[*names, *"pdq", *measures]]

    narrow = df.select(*names, F.col(date).cast("date").alias(date), F.col(value).cast("double").alias(value))
    fits = spread(narrow, names).groupBy(*names).applyInPandas(fit_all, schema)
    sound = F.coalesce(F.col("stationary") & F.col("invertible"), F.lit(False))
    ranked = series_window(names, sound.desc(), F.col(criterion).asc_nulls_last(), F.col("p"), F.col("d"), F.col("q"))
    return fits.withColumn("is_best", sound & (F.row_number().over(ranked) == 1))
