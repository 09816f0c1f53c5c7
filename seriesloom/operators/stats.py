"""Aggregates, correlations, sufficient statistics and diagnostic tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from seriesloom.functions.distributions import chi2_sf, normal_quantile
from seriesloom.functions.expressions import attach_row, finite, ratio
from seriesloom.functions.windows import series_window
from seriesloom.operators.projections import replace_infinite
from seriesloom.operators.quantiles import quantiles
from seriesloom.session import held

# Rows from which the pivots of the moments are taken; results do not depend on them.
PIVOT_ROWS = 101

# ------------------------------------------------------------ profiles


def seasonal_profile(df: DataFrame, *, keys: Sequence[str], date: str, col: str) -> DataFrame:
    """Month-of-year means with each key's peak and trough month."""
    monthly = df.groupBy(*keys, F.month(date).alias("month_of_year")).agg(F.avg(col).alias("mean_value"))
    whole = Window.partitionBy(*keys)
    high = F.struct("mean_value", -F.col("month_of_year"))
    low = F.struct("mean_value", "month_of_year")
    return monthly.withColumns(
        {
            "peak_month": F.max_by("month_of_year", high).over(whole),
            "trough_month": F.min_by("month_of_year", low).over(whole),
        }
    )


def seasonality_factors(df: DataFrame, *, keys: Sequence[str], date: str, col: str) -> DataFrame:
    """Month mean divided by the mean of the month means: ``(keys, month_of_year, factor)``."""
    monthly = df.groupBy(*keys, F.month(date).alias("month_of_year")).agg(F.avg(col).alias("mean_value"))
    level = F.avg("mean_value").over(Window.partitionBy(*keys))
    return monthly.select(*keys, "month_of_year", ratio(F.col("mean_value"), level).alias("factor"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes, exact quartiles and variation."""
    quartiles = quantiles(df, cols, (0.25, 0.5, 0.75))

    def row(c: str) -> Column:
        x = finite(F.col(c).cast("double"))
        q = quartiles[c]
        return F.struct(
            F.lit(c).alias("metric"),
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            *[F.lit(q[p]).cast("double").alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))],
            F.max(x).alias("max"),
            ratio(F.stddev_samp(x), F.avg(x)).alias("cv"),
        )

    return df.agg(F.array(*[row(c) for c in cols]).alias("rows")).select(F.inline("rows"))


def high_variability(df: DataFrame, cols: Sequence[str], *, limit: float = 1.0) -> DataFrame:
    """Columns whose |std / mean| exceeds ``limit`` (one aggregate)."""
    rows = [
        F.struct(F.lit(c).alias("metric"), F.abs(ratio(F.stddev_samp(c), F.avg(c))).alias("cv")) for c in cols
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).filter(F.col("cv") > limit)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(a, b, corr)`` for all ordered pairs, pairwise complete, one aggregate."""
    pairs = {(a, b): F.corr(a, b) for a, b in combinations(cols, 2)}

    def entry(a: str, b: str) -> Column:
        value = F.lit(1.0) if a == b else pairs.get((a, b), pairs.get((b, a)))
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value.alias("corr"))

    rows = F.array(*[entry(a, b) for a in cols for b in cols])
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def target_correlation(df: DataFrame, target: str, cols: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of every column with the target."""
    rows = [F.struct(F.lit(c).alias("metric"), F.corr(c, target).alias("corr")) for c in cols]
    table = df.groupBy(*keys).agg(F.array(*rows).alias("rows"))
    return table.select(*keys, F.inline("rows"))


def lag_correlation(df: DataFrame, *, keys: Sequence[str], date: str, target: str, driver: str, max_lag: int = 12) -> DataFrame:
    """Correlation of the target with the driver 0..max_lag rows earlier, and
    the lag where it is strongest (the smallest on a tie)."""
    w = series_window(keys, date)
    lagged = df.withColumns({f"_l{k}": F.lag(driver, k).over(w) for k in range(max_lag + 1)})
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.corr(target, f"_l{k}").alias("corr")) for k in range(max_lag + 1)])
    table = lagged.groupBy(*keys).agg(rows.alias("rows"))
    strength = F.transform("rows", lambda x: F.struct(F.abs(x["corr"]).alias("size"), -x["lag"]))
    table = table.withColumn("best_lag", -F.array_max(strength)["col2"])
    return table.select(*keys, "best_lag", F.inline("rows"))


# ------------------------------------------------------------ normal equations


def gram(df: DataFrame, xs: Sequence[str], y: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Raw sufficient statistics: n, sums, and all products of xs and y."""
    names = [*xs, y]
    complete = df.na.drop("any", subset=names)
    sums = [F.sum(c).alias(f"s_{c}") for c in names]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"g_{a}_{b}") for a, b in combinations_with_replacement(names, 2)]
    return complete.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *products)


def _moments(names: Sequence[str]) -> list[Column]:
    """Means and population covariances, accumulated stably in one pass."""
    means = F.array(*[F.avg(c) for c in names]).alias("means")
    covs = F.array(*[F.covar_pop(a, b) for a, b in combinations_with_replacement(names, 2)]).alias("covs")
    return [F.count("*").alias("n"), means, covs]


def _complete(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names], *[F.col(c).cast("double").alias(c) for c in names]).na.drop(
        "any", subset=list(names)
    )


def covariance(covs: Sequence[float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = covs
    return out + np.triu(out, 1).T


def solve_centred(cov: np.ndarray, means: np.ndarray, penalty: float = 0.0) -> tuple[np.ndarray, float, float]:
    """Slopes, intercept and residual variance of the last column on the
    others.  Columns are scaled to unit deviation before the (pseudo-)inverse;
    ``penalty`` is added to the unscaled diagonal (ridge, intercept free)."""
    k = len(means) - 1
    xx, xy = cov[:k, :k] + penalty * np.eye(k), cov[:k, k]
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    slopes = np.linalg.pinv(xx / np.outer(scale, scale), hermitian=True, rcond=1e-12) @ (xy / scale) / scale
    residual = cov[k, k] - 2 * slopes @ xy + slopes @ cov[:k, :k] @ slopes
    return slopes, float(means[k] - slopes @ means[:k]), float(max(residual, 0.0))


def column_moments(df: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariances over complete rows.

    Each row becomes one vector: its distances from a pivot and their products.
    A single aggregate takes the mean of these vectors, for any number of
    columns.  The result is the same for every pivot; one out of the column's
    middle keeps the digits.  Only the k + k (k + 1) / 2 means reach the driver.
    Without complete rows all moments are NaN.
    """
    complete, k = _complete(df.select(*names), names), len(names)
    near = np.array([tuple(r) for r in complete.take(PIVOT_ROWS)], dtype=float).reshape(-1, k)
    if not len(near):
        return 0, np.full(k, np.nan), np.full((k, k), np.nan)
    pivot = np.sort(near, axis=0)[len(near) // 2]
    away = complete.select(F.array(*[F.col(c) - F.lit(float(p)) for c, p in zip(names, pivot)]).alias("x"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.transform(F.slice("x", i + 1, F.lit(k)), lambda v: v * F.get("x", i)))
    vectors = away.select(array_to_vector(F.concat("x", F.flatten(rows))).alias("v"))
    found = vectors.select(Summarizer.metrics("count", "mean").summary(F.col("v")).alias("s")).first().s
    mean = found["mean"].toArray()
    return found["count"], pivot + mean[:k], covariance(mean[k:], k) - np.outer(mean[:k], mean[:k])


def ols(df: DataFrame, xs: Sequence[str], y: str, *, alpha: float = 0.0) -> dict:
    """Whole-table least squares (ridge with ``alpha``): the moments of all
    columns, then one small solve on the driver."""
    n, means, cov = column_moments(df, [*xs, y])
    slopes, intercept, residual = solve_centred(cov, means, alpha / n)
    r2 = 1 - residual / cov[-1, -1] if cov[-1, -1] > 0 else float("nan")
    return {"coef": dict(zip(xs, slopes.tolist())), "intercept": intercept, "r2": r2, "n": n, "mse": residual}


def ols_by(df: DataFrame, xs: Sequence[str], y: str, *, keys: Sequence[str], alpha: float = 0.0) -> DataFrame:
    """Least squares per key: moments are aggregated by Spark and the small
    systems are solved batch-wise, one row per key."""
    names = [*xs, y]
    moments = _complete(df.select(*keys, *names), names).groupBy(*keys).agg(*_moments(names))

    def solve(batches):
        for pdf in batches:
            out = pdf[list(keys)].copy()
            solved = [
                solve_centred(covariance(c, len(names)), np.array(m), alpha / n)
                for c, m, n in zip(pdf["covs"], pdf["means"], pdf["n"])
            ]
            for i, x in enumerate(xs):
                out[f"b_{x}"] = [s[0][i] for s in solved]
            out["intercept"] = [s[1] for s in solved]
            total = np.array([c[-1] for c in pdf["covs"]], dtype=float)
            residual = np.array([s[2] for s in solved], dtype=float)
            out["r2"] = np.where(total > 0, 1 - residual / np.where(total > 0, total, 1.0), np.nan)
            out["n"] = pdf["n"]
            yield out

    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema.fields[: len(keys)])
    slopes = ", ".join(f"`b_{x}` double" for x in xs)
    return moments.mapInPandas(solve, f"{key_schema}, {slopes}, intercept double, r2 double, n long")


def predict_linear(df: DataFrame, model: Mapping, name: str = "prediction") -> DataFrame:
    value = F.lit(model["intercept"])
    for c, b in model["coef"].items():
        value = value + F.col(c) * b
    return df.withColumn(name, value)


def two_factor_impact(df: DataFrame, *, keys: Sequence[str], target: str, factors: tuple[str, str]) -> DataFrame:
    """Standardised coefficients of two factors and their shares of the sum
    of absolute values, in closed form from three correlations."""
    a, b = factors
    rows = df.na.drop("any", subset=[target, a, b]).groupBy(*keys).agg(
        F.corr(target, a).alias("_ya"), F.corr(target, b).alias("_yb"), F.corr(a, b).alias("_ab")
    )
    rest = 1 - F.col("_ab") * F.col("_ab")
    out = rows.withColumns(
        {
            f"coef_{a}": ratio(F.col("_ya") - F.col("_ab") * F.col("_yb"), rest),
            f"coef_{b}": ratio(F.col("_yb") - F.col("_ab") * F.col("_ya"), rest),
        }
    ).drop("_ya", "_yb", "_ab")
    size = F.abs(f"coef_{a}") + F.abs(f"coef_{b}")
    return out.withColumns({f"importance_{f}": ratio(F.abs(f"coef_{f}"), size) for f in factors})


# ------------------------------------------------------------ diagnostics


def raw_gram_matrix(df: DataFrame, xs: Sequence[str]) -> np.ndarray:
    """Mean uncentred products of the features (bad cells take the mean)."""
    clean = replace_infinite(df.select(*[F.col(c).cast("double").alias(c) for c in xs]), xs)
    _, means, cov = column_moments(clean, xs)
    return cov + np.outer(means, means)


def vif_values(g: np.ndarray) -> list[float | None]:
    """``G_jj (G^-1)_jj`` of an uncentred Gram matrix; None if singular."""
    scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    unit = g / np.outer(scale, scale)
    if np.linalg.matrix_rank(unit, tol=1e-12, hermitian=True) < len(g):
        keep = [np.linalg.matrix_rank(np.delete(np.delete(unit, j, 0), j, 1), tol=1e-12) for j in range(len(g))]
        rank = np.linalg.matrix_rank(unit, tol=1e-12, hermitian=True)
        inv = np.linalg.pinv(unit, hermitian=True)
        return [float(unit[j, j] * inv[j, j]) if keep[j] < rank else None for j in range(len(g))]
    return np.diag(np.linalg.inv(unit)).tolist()


def vif(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Variance inflation per feature, without a constant; one data pass."""
    values = vif_values(raw_gram_matrix(df, xs))
    return df.sparkSession.createDataFrame(list(zip(xs, values)), "feature string, vif double")


def breusch_pagan(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """LM = n R2 of the squared residuals on the regressors; two data passes."""
    first = ols(df, xs, y)
    residual = predict_linear(_complete(df.select(*xs, y), [*xs, y]), first)
    squared = residual.withColumn("e2", F.pow(F.col(y) - F.col("prediction"), 2))
    second = ols(squared, xs, "e2")
    lm = second["n"] * second["r2"]
    p = chi2_sf(lm, len(xs))
    row = Row(n=second["n"], lm=float(lm), p_value=float(p), heteroskedastic=bool(p < 0.05))
    return df.sparkSession.createDataFrame([row], "n long, lm double, p_value double, heteroskedastic boolean")


def durbin_watson(df: DataFrame, *, keys: Sequence[str], date: str, residual: str) -> DataFrame:
    w = series_window(keys, date)
    step = F.pow(F.col(residual) - F.lag(residual).over(w), 2)
    table = df.withColumn("_step", step).groupBy(*keys).agg(
        ratio(F.sum("_step"), F.sum(F.pow(residual, F.lit(2)))).alias("dw")
    )
    label = F.when(F.col("dw") < 1.5, "positive").when(F.col("dw") > 2.5, "negative").otherwise("none")
    return table.withColumn("autocorrelation", label)


def acf(df: DataFrame, *, keys: Sequence[str], date: str, col: str, lags: int) -> DataFrame:
    """``(keys, n, lag, acf)`` for lags 0..``lags`` of the non-missing values."""
    present = df.select(*keys, date, F.col(col).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    whole = Window.partitionBy(*keys)
    centred = present.withColumn("_d", F.col("_x") - F.avg("_x").over(whole))
    w = series_window(keys, date)
    lagged = centred.withColumns({f"_d{k}": F.lag("_d", k).over(w) for k in range(lags + 1)})
    base = F.sum(F.col("_d") * F.col("_d"))
    values = [
        F.struct(F.lit(k).alias("lag"), ratio(F.sum(F.col("_d") * F.col(f"_d{k}")), base).alias("acf"))
        for k in range(lags + 1)
    ]
    table = lagged.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*values).alias("rows"))
    return table.select(*keys, "n", F.inline("rows"))


def pacf(df: DataFrame, *, keys: Sequence[str], date: str, col: str, lags: int) -> DataFrame:
    """Partial autocorrelation by Durbin-Levinson from each key's ACF array."""

    def levinson(batches):
        for pdf in batches:
            rows = []
            for rho in pdf["rho"]:
                rho = np.asarray(rho, dtype=float)
                phi, out, err = np.zeros(0), [1.0], 1.0
                for k in range(1, len(rho)):
                    last = (rho[k] - phi @ rho[k - 1 : 0 : -1]) / err if err > 1e-14 else 0.0
                    phi = np.append(phi - last * phi[::-1], last)
                    err *= 1 - last * last
                    out.append(last)
                rows.append(out)
            yield pdf[list(keys)].assign(pacf=rows)

    table = acf(df, keys=keys, date=date, col=col, lags=lags).filter(F.col("acf").isNotNull())
    arrays = table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "acf")))["acf"].alias("rho"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrays.schema.fields[: len(keys)])
    solved = arrays.mapInPandas(levinson, f"{fields}, pacf array<double>")
    return solved.select(*keys, F.posexplode("pacf").alias("lag", "pacf"))


def chi2_tail(value: str | Column, df: str | Column) -> Column:
    """Upper tail of the chi-square distribution; NULL for a missing value."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else chi2_sf(float(v), int(d)) for v, d in zip(x, k)], dtype="float64")

    return tail(value, df)


def ljung_box(df: DataFrame, *, keys: Sequence[str], date: str, col: str, lags: Sequence[int] = (1, 10), level: float = 0.05) -> DataFrame:
    """``Q = n (n+2) sum r_k^2 / (n-k)`` for each horizon in ``lags``, its chi-square
    tail (one row per key and horizon passes through Python) and the decision."""
    table = acf(df, keys=keys, date=date, col=col, lags=max(lags)).filter("lag > 0 AND n > lag")
    term = F.pow("acf", F.lit(2)) / (F.col("n") - F.col("lag"))
    q = [
        F.struct(
            F.lit(h).alias("horizon"),
            (F.max("n") * (F.max("n") + 2) * F.sum(F.when(F.col("lag") <= h, term))).alias("q"),
        )
        for h in lags
    ]
    rows = table.groupBy(*keys).agg(F.array(*q).alias("rows")).select(*keys, F.inline("rows"))
    return rows.withColumn("p_value", chi2_tail("q", "horizon")).withColumn("correlated", F.col("p_value") < level)


def jarque_bera(df: DataFrame, *, keys: Sequence[str], col: str) -> DataFrame:
    """``n/6 (S^2 + K^2/4)`` with population skewness and excess kurtosis;
    the chi-square(2) tail is ``exp(-JB/2)``."""
    table = df.filter(F.col(col).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.skewness(col).alias("skew"), F.kurtosis(col).alias("kurt")
    )
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return table.withColumn("jb", jb).withColumn("p_value", F.exp(-F.col("jb") / 2))


# MacKinnon (2010) response surface for a test with a constant,
# one variable: critical value = b0 + b1/T + b2/T^2 + b3/T^3.
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def adf(df: DataFrame, *, keys: Sequence[str], date: str, col: str, max_lag: int = 4) -> DataFrame:
    """Augmented Dickey-Fuller with a constant, lag order by AIC.

    The regression variables are built by one window; their moments are one
    aggregate per key for each order, over the same rows (those complete at
    ``max_lag``), and the small systems are solved batch-wise.
    """
    w = series_window(keys, date)
    steps = df.select(*keys, date, F.col(col).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    steps = steps.withColumn("dx", F.col("_x") - F.lag("_x").over(w)).withColumn("x1", F.lag("_x").over(w))
    steps = steps.withColumns({f"d{k}": F.lag("dx", k).over(w) for k in range(1, max_lag + 1)})
    names = ["x1", *[f"d{k}" for k in range(1, max_lag + 1)], "dx"]
    moments = _complete(steps.select(*keys, *names), names).groupBy(*keys).agg(*_moments(names))

    def test(batches):
        for pdf in batches:
            rows = []
            for covs, means, n in zip(pdf["covs"], pdf["means"], pdf["n"]):
                cov, best = covariance(covs, len(names)), None
                for p in range(max_lag + 1):
                    at = [*range(p + 1), len(names) - 1]
                    sub = cov[np.ix_(at, at)]
                    k = p + 2
                    if n <= k or sub[0, 0] <= 0:
                        continue
                    slopes, _, residual = solve_centred(sub, np.array(means)[at])
                    inv = np.linalg.pinv(sub[:-1, :-1], hermitian=True)
                    se = np.sqrt(max(residual * n / (n - k) * inv[0, 0] / n, 0.0))
                    if residual <= 0 or se == 0:
                        continue
                    aic = n * np.log(residual) + 2 * k
                    if best is None or aic < best[0]:
                        best = (aic, slopes[0] / se, p)
                stat, used = (best[1], best[2]) if best else (np.nan, -1)
                b = ADF_CRITICAL["5%"]
                crit = sum(c / n**i for i, c in enumerate(b)) if n else np.nan
                rows.append((stat, used, int(n), crit, bool(stat < crit)))
            out = pd.DataFrame(rows, columns=["statistic", "used_lag", "n", "critical_5pct", "stationary"])
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), out], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema.fields[: len(keys)])
    return moments.mapInPandas(test, f"{fields}, statistic double, used_lag int, n long, critical_5pct double, stationary boolean")


def residual_histogram(df: DataFrame, residual: str, *, bins: int = 20) -> DataFrame:
    """Equal-width histogram between the extremes: ``(bin, n, lo, hi)``."""
    x = F.col(residual)
    out = attach_row(df.select(residual).filter(x.isNotNull()), df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")), "_e")
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    number = F.least(F.floor(F.coalesce(ratio(x - F.col("_e.lo"), width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    table = out.withColumn("bin", number).withColumn("_w", width)
    return table.groupBy("bin").agg(
        F.count("*").alias("n"),
        (F.max("_e.lo") + F.col("bin") * F.max("_w")).alias("lo"),
        (F.max("_e.lo") + (F.col("bin") + 1) * F.max("_w")).alias("hi"),
    )


def normal_quantile_pairs(df: DataFrame, residual: str, *, points: int = 19) -> DataFrame:
    """Sample quantiles beside those of the normal distribution."""
    probs = [(i + 1) / (points + 1) for i in range(points)]
    with held(df.select(residual)) as frame:
        sample = quantiles(frame, [residual], probs)[residual]
    rows = [(p, normal_quantile(p), sample[p]) for p in probs]
    return df.sparkSession.createDataFrame(rows, "p double, theoretical double, sample double")
