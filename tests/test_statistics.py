"""Statistics, selection, models and forecasts against direct computation."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.distributions import chi2_sf, normal_quantile, t_quantile
from seriesloom.operators import backtest as bt
from seriesloom.operators import ensemble as en
from seriesloom.operators import metrics as me
from seriesloom.operators import models as ml
from seriesloom.operators import outliers, quality
from seriesloom.operators import projections as pj
from seriesloom.operators import scenario as sc
from seriesloom.operators import selection as sel
from seriesloom.operators import stats as st
from seriesloom.operators.quantiles import quantiles

K = {"keys": ["key"], "date": "date"}


def frame(spark, **cols):
    pdf = pd.DataFrame(cols)
    return spark.createDataFrame(pdf)


def test_distributions():
    assert t_quantile(0.975, 2) == pytest.approx(4.302652729911275)
    assert t_quantile(0.975, 30) == pytest.approx(2.0422724563012373)
    assert t_quantile(0.025, 5) == pytest.approx(-2.5705818366147395)
    assert normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)


def test_t_critical_expansion_continues_the_table(spark):
    n = [2, 3, 151, 152, 500, 100000]
    got = [r.t for r in frame(spark, n=n).select("n", me.t_critical(F.col("n"), 0.95).alias("t")).orderBy("n").collect()]
    np.testing.assert_allclose(got, [t_quantile(0.975, v - 1) for v in n], rtol=1e-9)


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "one", "signed"])
def test_quantiles_match_numpy(spark, kind):
    rng = np.random.default_rng(5)
    x = {
        "normal": rng.normal(1e6, 3, 3000),
        "heavy": np.exp(rng.normal(0, 6, 3000)),
        "ties": rng.integers(0, 4, 3000).astype(float),
        "one": np.array([7.0]),
        "signed": np.concatenate([-np.exp(rng.normal(0, 4, 999)), [0.0], np.exp(rng.normal(0, 4, 1000))]),
    }[kind]
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles(frame(spark, x=x).repartition(7), ["x"], probs)["x"]
    np.testing.assert_allclose([got[p] for p in probs], np.quantile(x, probs), rtol=1e-12)


def test_quantiles_skip_missing_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (8.0, None), (float("nan"), None)], "a double, b double")
    got = quantiles(df, ["a", "b"], [0.25, 0.5])
    assert got == {"a": {0.25: 1.75, 0.5: 3.0}, "b": {0.25: None, 0.5: None}}


def test_clip_changes_the_whole_column_once_flagged(spark):
    calm = frame(spark, x=np.arange(100.0))
    assert outliers.clip_flagged_columns(calm, ["x"]).agg(F.max("x")).first()[0] == 99.0
    x = np.concatenate([np.arange(100.0), [1000.0]])
    out = outliers.clip_flagged_columns(frame(spark, x=x), ["x"]).toPandas()["x"]
    lo, hi = np.quantile(x, [0.01, 0.99])
    np.testing.assert_allclose(np.sort(out), np.sort(np.clip(x, lo, hi)))


def test_series_clip_equals_column_clip(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=60), [50.0]])
    one = outliers.clip_flagged_columns(frame(spark, x=x), ["x"]).toPandas()["x"]
    by = outliers.clip_flagged_series(frame(spark, x=x).withColumn("key", F.lit("a")), ["x"], keys=["key"]).toPandas()["x"]
    np.testing.assert_allclose(np.sort(one), np.sort(by))


def test_log_domain(spark):
    df = frame(spark, x=[1.0, 0.0], y=[1.0, 2.0])
    out = pj.transform_columns(df, {"x": "log", "y": "log"}).orderBy("x").collect()
    assert [r.log_x for r in out] == [0.0, 1.0]
    assert [r.log_y for r in out] == pytest.approx([math.log(2), 0.0])
    up = pj.transform_columns(df, {"x": "log1p"}).orderBy("x").collect()
    assert [r.log1p_x for r in up] == pytest.approx([0.0, 0.6931], abs=1e-4)


def test_boxcox_finds_the_log(spark):
    x = np.exp(np.random.default_rng(4).normal(size=4000))
    best = pj.boxcox_grid(frame(spark, x=x), "x").orderBy(F.desc("llf")).first()
    assert abs(best.lam) < 0.06


def test_infinite_and_missing_take_the_mean(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("inf"),), (None,)], "x double")
    assert sorted(r.x for r in pj.replace_infinite(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_column_drops(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0)], "a double, b double, c double")
    assert pj.drop_empty_columns(df).columns == ["a", "c"]
    assert pj.drop_near_constant(df, ["a", "c"]).columns == ["a", "b"]


def test_quality_report(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (1.0, None), (1.0, "z")], "v double, t string")
    row = quality.quality_report({"s": df}, dates={}).first()
    assert (row.row_count, row.column_count, row.missing_columns, row.missing_values, row.missing_pct) == (4, 2, 2, 2, 25.0)
    assert row.needs_cleaning and row.outlier_count == 0
    assert quality.flagged_sources(quality.quality_report({"s": df}, dates={})) == ["s"]


def test_ols_wide_and_narrow_agree(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(3, 2, (500, 8))
    y = x @ np.arange(1, 9) + 5 + rng.normal(size=500)
    df = frame(spark, y=y, **{f"x{i}": x[:, i] for i in range(8)})
    names = [f"x{i}" for i in range(8)]
    for k, alpha in ((3, 0.0), (8, 0.0), (8, 10.0)):
        got = st.ols(df, names[:k], "y", alpha=alpha)
        xc, yc = x[:, :k] - x[:, :k].mean(0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(k), xc.T @ yc)
        np.testing.assert_allclose(list(got["coef"].values()), want, rtol=1e-8)
        assert got["intercept"] == pytest.approx(y.mean() - x[:, :k].mean(0) @ want)


def test_vif_and_singular(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(1, 1, 300), rng.normal(2, 1, 300)
    df = frame(spark, a=a, b=b, c=a + 0.1 * rng.normal(size=300), d=2 * b)
    got = {r.feature: r.vif for r in st.vif(df, ["a", "b", "c"]).collect()}
    others = np.column_stack([b, df.toPandas()["c"]])
    fit = others @ np.linalg.lstsq(others, a, rcond=None)[0]
    assert got["a"] == pytest.approx(1 / (((a - fit) ** 2).sum() / (a**2).sum()))
    assert {r.feature: r.vif for r in st.vif(df, ["b", "d"]).collect()} == {"b": None, "d": None}
    kept = sel.select_by_vif(df, ["a", "b", "c", "d"], threshold=10)
    assert len({"b", "d"} & set(kept)) == 1 and len({"a", "c"} & set(kept)) == 1


def test_lasso_and_elastic_net_meet_their_optimality_conditions(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.5 * rng.normal(size=400)
    df = frame(spark, y=y, a=x[:, 0], b=x[:, 1], c=x[:, 2])
    xc, yc = x - x.mean(0), y - y.mean()
    for l1, l2, model in (
        (0.1, 0.0, ml.fit_lasso(df, ["a", "b", "c"], "y", alpha=0.1)),
        (0.1, 0.1, ml.fit_elastic_net(df, ["a", "b", "c"], "y", alpha=0.2, l1_ratio=0.5)),
    ):
        w = model.stages[-1].coefficients.toArray()
        slope = xc.T @ (yc - xc @ w) / len(y) - l2 * w
        live = np.abs(w) > 1e-6
        np.testing.assert_allclose(slope[live], l1 * np.sign(w[live]), atol=2e-3)
        assert (np.abs(slope[~live]) <= l1 + 2e-3).all()


def test_pca_matches_eigenvalues(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    df = frame(spark, **{f"x{i}": x[:, i] for i in range(4)})
    _, table = sel.pca(df, [f"x{i}" for i in range(4)])
    got = [r.explained for r in table.filter("feature = 'x0'").orderBy("component").collect()]
    eig = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    np.testing.assert_allclose(got, eig / eig.sum(), rtol=1e-8)
    kept = table.filter("kept").agg(F.max("component")).first()[0]
    assert kept == int(np.searchsorted(np.cumsum(eig / eig.sum()), 0.95)) + 1


def test_reduced_columns_match_the_projection(spark):
    rng = np.random.default_rng(24)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 8)) + 0.01 * rng.normal(size=(200, 8))
    x[:, 7] = 5.0
    names = [f"x{i}" for i in range(8)]
    df = frame(spark, id=range(200), **{c: x[:, i] for i, c in enumerate(names)})
    df = df.withColumn("x2", F.when(F.col("id") != 7, F.col("x2")))
    got = sel.pca_reduced(df, names).orderBy("id").toPandas()
    held = np.delete(np.arange(200), 7)
    z = (x[held, :7] - x[held, :7].mean(axis=0)) / x[held, :7].std(axis=0)
    values, vectors = np.linalg.eigh(z.T @ z / len(held))
    share = np.cumsum(values[::-1]) / values.sum()
    k = int(np.searchsorted(share, 0.95)) + 1
    assert list(got.columns) == ["id", *[f"PC{i + 1}" for i in range(k)], "gaps"]
    for i in range(k):
        v = vectors[:, -1 - i]
        np.testing.assert_allclose(got[f"PC{i + 1}"].to_numpy()[held], z @ v * np.sign(v[np.argmax(np.abs(v))]), atol=1e-6)
    assert got["gaps"].tolist() == [int(i == 7) for i in range(200)] and np.isnan(got["PC1"][7])
    none = sel.pca_reduced(spark.createDataFrame([(1, None, 2.0)], "id int, a double, b double"), ["a", "b"]).first()
    assert none.PC1 is None and none.gaps == 1


def test_selection_keeps_the_signal(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 5))
    df = frame(spark, y=5 * x[:, 2] + 3 * x[:, 4] + 0.1 * rng.normal(size=400), **{f"x{i}": x[:, i] for i in range(5)})
    names = [f"x{i}" for i in range(5)]
    assert set(sel.rfe_ridge(df, names, "y", keep=2)) == {"x2", "x4"}
    assert set(sel.rfe_forest(df, names, "y", keep=2, numTrees=10)) == {"x2", "x4"}
    assert set(sel.select_features(df, names, "y", keep=2, numTrees=10)) == {"x2", "x4"}
    model = ml.fit_forest(df, names, "y", numTrees=10)
    top = sel.importance_table(df, sel.importance_of(model, names), top=2).collect()
    assert {r.feature for r in top} == {"x2", "x4"}


def test_priority_is_uncapped():
    names = ["z", "y_lag_1", "y_ma_3", "trend", "q"]
    scores = {"z": 0.9, "y_lag_1": 0.0, "y_ma_3": 0.0, "trend": 0.0, "q": 0.5}
    assert sel.select_with_priority(names, scores, max_features=2) == ["y_lag_1", "y_ma_3", "trend"]
    assert sel.select_with_priority(names, scores, max_features=4)[-1] == "z"


def test_pacf_of_an_ar1(series):
    rng = np.random.default_rng(12)
    x = [0.0]
    for _ in range(400):
        x.append(0.7 * x[-1] + rng.normal())
    df = series({"a": x})
    r = {row.lag: row.acf for row in st.acf(df, **K, col="value", lags=3).collect()}
    got = {row.lag: row.pacf for row in st.pacf(df, **K, col="value", lags=3).collect()}
    toeplitz = np.array([[1, r[1]], [r[1], 1]])
    assert got[1] == pytest.approx(r[1])
    assert got[2] == pytest.approx(np.linalg.solve(toeplitz, [r[1], r[2]])[1])
    assert abs(got[3]) < 0.15


def test_adf_tells_a_walk_from_noise(series):
    rng = np.random.default_rng(13)
    noise = rng.normal(size=200)
    df = series({"walk": np.cumsum(noise), "noise": noise, "flat": [1.0] * 60})
    got = {r.key: r for r in st.adf(df, **K, col="value", max_lag=2).collect()}
    assert not got["walk"].stationary and got["noise"].stationary and not got["flat"].stationary
    x = pd.Series(noise)
    d = pd.DataFrame({"x1": x.shift(), "d1": x.diff().shift(), "d2": x.diff().shift(2), "dx": x.diff()}).dropna()
    used = got["noise"].used_lag
    design = np.column_stack([np.ones(len(d)), d[["x1", "d1", "d2"][: used + 1]]])
    beta, *_ = np.linalg.lstsq(design, d["dx"], rcond=None)
    s2 = ((d["dx"] - design @ beta) ** 2).sum() / (len(d) - design.shape[1])
    assert got["noise"].statistic == pytest.approx(beta[1] / math.sqrt(s2 * np.linalg.inv(design.T @ design)[1, 1]), rel=1e-6)


def test_windows_and_folds(series):
    df = series({"a": range(36)})
    win = bt.backtest_windows(df, bt.walk_forward(min_train=24, window=6, step=3), **K).orderBy("window").collect()
    assert [w.test_from for w in win] == [24, 27, 30]
    assert bt.backtest_windows(series({"a": range(10)}), bt.walk_forward(), **K).count() == 0
    folds = bt.backtest_windows(series({"a": range(12)}), bt.time_ordered_folds(5), **K).orderBy("window").collect()
    assert [(f.test_start.month - 1, f.test_end.month - 1) for f in folds] == [(2, 3), (4, 5), (6, 7), (8, 9), (10, 11)]


@pytest.mark.parametrize("features", [["l1"], ["l1", "l2"]])
def test_prefix_refits_equal_direct_fits(series, features):
    x = 1000 + np.cumsum(np.random.default_rng(14).normal(size=60))
    df = series({"a": x})
    from seriesloom.functions.windows import series_window

    w = series_window(["key"], "date")
    lagged = df.withColumns({"l1": F.lag("value", 1).over(w), "l2": F.lag("value", 2).over(w)})
    walk = bt.walk_forward(min_train=24, window=6, step=10)
    win = bt.backtest_windows(lagged, walk, **K)
    got = bt.backtest_linear(lagged, walk, **K, target="value", features=features).toPandas()
    pdf = lagged.orderBy("date").toPandas()
    for row in win.collect():
        train = pdf[: row.test_from].dropna(subset=["value", *features])
        design = np.column_stack([np.ones(len(train)), train[features]])
        beta, *_ = np.linalg.lstsq(design, train["value"], rcond=None)
        test = pdf[row.test_from : row.test_from + 6]
        want = beta[0] + test[features].to_numpy() @ beta[1:]
        part = got[got["window"] == row.window].sort_values("date")
        np.testing.assert_allclose(part["predicted_value"], want, rtol=1e-6)


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("m", 0.0, 1.0), ("m", 2.0, 1.0)], "model string, y double, yhat double")
    row = me.forecast_metrics(df, keys=["model"]).first()
    assert (row.mae, row.mse, row.r2, row.mape) == (1.0, 1.0, 0.0, 50.0)
    zero = spark.createDataFrame([("m", 0.0, 1.0)], df.schema)
    assert me.forecast_metrics(zero, keys=["model"]).first().mape is None


def test_weights(spark):
    m = spark.createDataFrame([("k", "a", 1.0, -1.0), ("k", "b", 3.0, -2.0)], "key string, model string, mse double, r2 double")
    for weigh in (en.weights_inverse_mse, en.weights_r2):
        got = {r.model: r.weight for r in weigh(m, keys=["key"]).collect()}
        assert got == pytest.approx({"a": 0.75, "b": 0.25})
    stored = spark.createDataFrame([("k", "a", 0.6), ("k", "old", 0.4)], "key string, model string, weight double")
    used = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "c")], "key string, model string")
    got = {r.model: r.weight for r in en.merge_weights(stored, used, keys=["key"]).collect()}
    assert got == pytest.approx({"a": 0.6, "b": 0.2, "c": 0.2})


def test_scenarios(spark):
    given = {"baseline": sc.PREDEFINED["baseline"], "up": {**sc.PREDEFINED["baseline"], "gdp_growth": [6.8]}, "recession": {**sc.PREDEFINED["baseline"], "gdp_growth": [-1.0], "gold_price_yoy": [18.0]}}
    table = sc.define_scenarios(spark, given, periods=2)
    factor = {(r.scenario, r.period): r.factor for r in sc.impact_factors(table).collect()}
    assert factor["baseline", 1] == 1.0
    assert factor["up", 0] == pytest.approx(1.008)
    assert factor["recession", 0] == pytest.approx((1 - 6.8 * 0.8 / 100) * 1.0075)


def test_growth_forecast_compounds(series):
    df = series({"short": [100, 110, 121], "one": [50]})
    out = sc.growth_forecast(df, **K, col="value", periods=2).orderBy("key", "period").collect()
    assert [(r.key, round(r.forecast, 6)) for r in out] == [("one", 51.0), ("one", 52.02), ("short", 133.1), ("short", 146.41)]
    assert out[0].date == dt.date(2020, 2, 29) and out[0].lower_bound == pytest.approx(51 * 0.95)


def test_growth_forecast_matches_a_loop(series):
    x = [100 + 3 * i + 10 * math.sin(i) for i in range(30)]
    got = [r.forecast for r in sc.growth_forecast(series({"a": x}), **K, col="value").orderBy("period").collect()]
    means = {m: np.mean([v for i, v in enumerate(x) if i % 12 == m]) for m in range(12)}
    level = np.mean(list(means.values()))
    g, last, want = (x[-1] / x[-13]) ** (1 / 12) - 1, x[-1], []
    for i in range(12):
        last = last * (1 + g) * means[(30 + i) % 12] / level
        want.append(last)
    np.testing.assert_allclose(got, want, rtol=1e-10)


def test_panel_arima_follows_a_season(series):
    season = [5, -3, 1, 0, 2, -5, 4, -4, 3, -3, 1, -1]
    x = [200 + 0.5 * i + season[i % 12] for i in range(84)]
    rng = np.random.default_rng(15)
    df = series({"a": [v + 0.01 * rng.normal() for v in x], "tiny": [1, 2, 3]})
    rows = ml.panel_arima(df, **K, value="value", periods=6, log=False).orderBy("step").collect()
    out = [r for r in rows if r.reason is None]
    assert {r.key for r in out} == {"a"}
    assert [(r.key, r.step, r.date, r.forecast, r.reason) for r in rows if r.reason] == [("tiny", None, None, None, "3 periods are too few")]
    np.testing.assert_allclose([r.forecast for r in out], [200 + 0.5 * i + season[i % 12] for i in range(84, 90)], atol=0.3)
    width = [r.upper_95 - r.lower_95 for r in out]
    assert all(b >= a for a, b in zip(width, width[1:])) and out[0].date == dt.date(2027, 1, 31)


def test_arima_grid_prefers_the_difference(series):
    walk = np.cumsum(np.random.default_rng(16).normal(1, 1, 150))
    out = ml.arima_grid(series({"a": walk}), **K, value="value", orders=[(0, 0, 0), (0, 1, 0)])
    best = out.filter("is_best").collect()
    assert len(best) == 1 and best[0].d == 1


def test_quarters_stay_quarters(spark):
    rows = [("a", dt.date(2010 + i // 4, 3 * (i % 4) + 1, 1), 140.0 + i % 3 if i % 4 == 3 else 100.0 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, date date, value double")
    out = ml.panel_arima(df, **K, value="value", m=4, every=3, periods=8).orderBy("step").collect()
    assert [r.date.month for r in out] == [1, 4, 7, 10] * 2 and out[0].date.year == 2025
    assert all((r.forecast > 130) == (r.date.month == 10) for r in out)


def test_orders_share_one_sample_and_the_best_is_sound(series):
    rng = np.random.default_rng(21)
    e = rng.normal(size=301)
    df = series({"ma": e[1:] + 0.6 * e[:-1], "short": list(rng.normal(size=14)), "one": [1.0], "none": [None, None]})
    rows = ml.arima_grid(df, **K, value="value").collect()
    assert len(rows) == 4 * 48
    for key in ("ma", "short"):
        fitted = [r for r in rows if r.key == key and r.n is not None]
        assert len({r.n for r in fitted}) == 1 and fitted
        best = [r for r in fitted if r.is_best]
        sound = [r for r in fitted if r.stationary and r.invertible]
        assert len(best) == 1 and best[0].aic == min(r.aic for r in sound)
    assert all(r.n is not None for r in rows if r.key == "ma")
    (best,) = [r for r in rows if r.key == "ma" and r.is_best]
    assert best.d == 0 and best.q >= 1
    assert any(r.invertible is False for r in rows if r.key == "ma" and r.d == 2) or any(r.stationary is False for r in rows)
    assert not any(r.is_best or r.aic is not None for r in rows if r.key in ("one", "none"))


def test_autoregressions_equal_direct_fits(series):
    y = np.cumsum(np.random.default_rng(22).normal(size=80))
    fits = ml.order_fits(y, [(p, d, 0) for p in range(4) for d in range(3)], (0, 0, 0), 12)
    for (p, d, _), fit in fits.items():
        z = np.diff(y, d)
        x = np.column_stack([np.ones(75), *[z[5 - d - k : len(z) - k] for k in range(1, p + 1)]])
        e = z[5 - d :] - x @ np.linalg.lstsq(x, z[5 - d :], rcond=None)[0]
        assert fit["n"] == 75 and fit["aic"] == pytest.approx(75 * np.log(np.mean(e**2)) + 2 * (p + 1))


def test_boxcox_column(spark):
    x = np.exp(np.random.default_rng(23).normal(2, 0.4, 4000))
    out = pj.boxcox_columns(frame(spark, x=x, cube=x**3, bad=x - 5.0, same=np.full(4000, 2.0)), ["x", "cube", "bad", "same"]).toPandas()
    lam, cube = out["boxcox_lambda_x"].iloc[0], out["boxcox_lambda_cube"].iloc[0]
    assert abs(lam) < 0.1 and abs(cube - lam / 3) < 0.001
    np.testing.assert_allclose(out["boxcox_x"], (out["x"] ** lam - 1) / lam if lam else np.log(out["x"]))
    assert out["boxcox_lambda_bad"].isna().all() and (out["boxcox_bad"] == out["bad"]).all()
    assert out["boxcox_same"].nunique() == 1
    empty = pj.boxcox_columns(spark.createDataFrame([(None,)], "x double"), ["x"]).first()
    assert empty.boxcox_x is None and empty.boxcox_lambda_x is None
    assert pj.boxcox_grid(spark.createDataFrame([], "x double"), "x").count() == 0


def test_search_folds_are_ordered_in_time(series):
    df = series({"a": range(24), "b": range(24)})
    cuts = ml.time_folds(df, date="date", folds=3)
    assert [(a.month, b.month) for a, b in cuts] == [(6, 12), (12, 6), (6, 12)]
    assert ml.sample_parameters({"a": [1, 2], "b": [1, 2]}, 10) == ml.sample_parameters({"a": [1, 2], "b": [1, 2]}, 10)


def test_design_has_no_leak(series):
    frame_, names = ml.design_frame(series({"a": [float(i * i) for i in range(40)]}), **K, target="value")
    assert "value" not in names and not {"key", "date"} & set(names)
    last = frame_.orderBy(F.desc("date")).first()
    assert last["value_ma_3"] == pytest.approx(np.mean([38**2, 37**2, 36**2]))


def test_explosive_terms_are_pulled_back(series):
    x = [1.3**i for i in range(40)]
    fit = ml.seasonal_arma(np.array(x), (1, 0, 0), (0, 0, 0), 12)
    assert not fit["stationary"] and abs(fit["beta"][1]) <= 0.99
    assert ml.seasonal_arma(np.sin(np.arange(60.0)) + 0.1 * np.arange(60) % 3, (1, 0, 0), (0, 0, 0), 12)["stationary"]
    out = ml.panel_arima(series({"a": x}), **K, value="value", order=(1, 0, 0), seasonal=(0, 0, 0), periods=200, log=False)
    assert all(math.isfinite(r.forecast) for r in out.collect())


def test_ensemble_folds_hold_at_least_five_rows(series):
    folds = bt.backtest_windows(series({"a": range(40)}), bt.ensemble_folds(5), **K).orderBy("window").collect()
    assert [f.test_from for f in folds] == [15, 20, 25, 30, 35]


def test_vif_stops_at_the_threshold_or_the_count(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    free = [tuple(map(float, r)) for r in rng.normal(size=(200, 3))]
    names = ["a", "b", "c"]
    assert sel.select_by_vif(spark.createDataFrame(free, names), names, threshold=10, max_features=2) == names
    base = rng.normal(size=200)
    tied = [tuple(float(x + 0.01 * e) for e in rng.normal(size=4)) for x in base]
    four = ["a", "b", "c", "d"]
    assert len(sel.select_by_vif(spark.createDataFrame(tied, four), four, threshold=10, max_features=3)) == 3


def test_seasonal_forecast_keeps_its_months_over_gaps(spark):
    import datetime as dt

    from seriesloom.operators.models import panel_arima

    gone = {7, 20, 33, 50}
    rows = [("a", dt.date(2015 + i // 12, i % 12 + 1, 1), None if i in gone else 150.0 if i % 12 == 11 else 100.0 + i % 3) for i in range(72)]
    out = panel_arima(spark.createDataFrame(rows, "k string, d date, v double"), keys=["k"], date="d", value="v").collect()
    best = max(out, key=lambda r: r.forecast)
    assert best.d.month == 12 and all(r.forecast < 125 for r in out if r is not best)


def test_coverage_gaps_against_plain_lists(spark):
    import datetime as dt
    import statistics

    from seriesloom.operators.quality import coverage_gaps

    rng = __import__("random").Random(9)
    series = {k: sorted({dt.date(2020, 1, 1) + dt.timedelta(rng.randint(0, 400)) for _ in range(n)}) for k, n in (("a", 90), ("b", 7), ("c", 2), ("d", 1))}
    rows = [(k, d) for k, days in series.items() for d in days] + [("b", series["b"][0])]
    series["b"] = sorted([*series["b"], series["b"][0]])
    got = {r.key: r for r in coverage_gaps(spark.createDataFrame(rows, "key string, day date"), keys=["key"], date="day").collect()}
    for k, days in series.items():
        steps = [(b - a).days for a, b in zip(days, days[1:])]  # noqa: B905
        middle = statistics.median(steps) if steps else None
        want = (days[0], days[-1], (days[-1] - days[0]).days, middle, sum(s > 2 * middle for s in steps))
        assert (got[k].start, got[k].end, got[k].duration_days, got[k].median_step, got[k].n_gaps) == want
    plan = coverage_gaps(spark.createDataFrame(rows, "key string, day date"), keys=["key"], date="day")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


@pytest.mark.parametrize("k", [1, 3, 40])
def test_moments_of_any_width(spark, k):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(500, k)) @ rng.normal(size=(k, k)) + 1e6 * np.arange(1, k + 1)
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(k)]))
    holes = df.withColumn("c0", F.when(F.col("c0") > 0, F.col("c0"))).unionByName(df.limit(3).withColumn("c0", F.lit(None).cast("double")))
    n, means, cov = st.column_moments(holes, df.columns)
    assert n == 500
    np.testing.assert_allclose(means, x.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(cov, np.cov(x.T, bias=True).reshape(k, k), rtol=1e-8, atol=1e-8)
    n, means, cov = st.column_moments(df.limit(0), df.columns)
    assert n == 0 and np.isnan(means).all() and np.isnan(cov).all()
    _, _, flat = st.column_moments(df.withColumn("c0", F.lit(0.1)), df.columns)
    assert flat[0, 0] == 0


def test_best_model_is_refitted_on_all_rows(spark):
    n = 80
    df = frame(spark, date=[dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)], x=[float(i % 8) for i in range(n)], y=[float((i % 8) ** 2) for i in range(n)])
    model, params, table = ml.best_model(df, ["x"], "y", date="date", family="forest", space={"numTrees": [5], "maxDepth": [1, 4]}, n_iter=2, folds=2)
    assert params == {"numTrees": 5, "maxDepth": 4} and table.count() == 2
    assert ml.score(model, df, keep=["date"], target="y").filter("abs(y - yhat) > 8").count() == 0


def test_ljung_box_decides(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=300)
    walk = [e[0]]
    for v in e[1:]:
        walk.append(0.6 * walk[-1] + v)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(300)]
    df = frame(spark, key=["noise"] * 300 + ["walk"] * 300, date=days * 2, value=[*e, *walk])
    out = {(r.key, r.horizon): r for r in st.ljung_box(df, **K, col="value").collect()}
    assert out["walk", 1].correlated and out["walk", 10].correlated and not out["noise", 1].correlated
    assert out["noise", 10].p_value == pytest.approx(chi2_sf(out["noise", 10].q, 10))


def test_frame_of_a_search_has_few_partitions(spark, monkeypatch):
    rows = [(f"k{i % 25}", i) for i in range(400)] + [(None, 1), (None, 1)]
    df = spark.createDataFrame(rows, "key string, x int")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        small = ml.packed(df, keys=["key"])
        monkeypatch.setattr(ml, "PART_ROWS", 10)
        large = ml.packed(df, keys=["key"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert small.rdd.getNumPartitions() == 8 and large.rdd.getNumPartitions() == 40
    for out in (small, large):
        assert sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)
        assert out.select("key", F.spark_partition_id().alias("p")).distinct().count() == 26
