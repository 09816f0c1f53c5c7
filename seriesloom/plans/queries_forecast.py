"""Metrics, back-tests, ensembles, forecasts and scenarios.

The compared models are the naive, the seasonal-naive and the moving-average
forecast of the nation panel, so every row has an SQL counterpart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.distributions import t_quantile
from seriesloom.functions.expressions import melt, round_columns
from seriesloom.functions.windows import rolling, series_window
from seriesloom.operators import backtest as bt
from seriesloom.operators import ensemble as en
from seriesloom.operators import metrics as me
from seriesloom.operators import refit
from seriesloom.operators import scenario as sc
from seriesloom.operators import stats as st
from seriesloom.operators.features import lag_features
from seriesloom.plans.registry import query, r
from seriesloom.plans.tables import P1_SQL, nation_panel

NATION = {"keys": ["n_name"], "date": "month"}
MODELS = ("naive", "snaive", "ma3")
BY_MODEL = ["n_name", "model"]


def _revenue(spark, sf):
    return nation_panel(spark, sf).select("n_name", "month", "revenue")


def _split_panel(spark, sf):
    return bt.chrono_split(_revenue(spark, sf), **NATION, test_size=0.2)


def _forecasts_wide(spark, sf):
    w = series_window(["n_name"], "month")
    panel = _split_panel(spark, sf).withColumn("_mean", rolling("revenue", 3, F.avg, w))
    made = panel.select(
        "n_name",
        "month",
        "split",
        F.col("revenue").alias("y"),
        F.lag("revenue", 1).over(w).alias("naive"),
        F.lag("revenue", 12).over(w).alias("snaive"),
        F.lag("_mean", 1).over(w).alias("ma3"),
    )
    return made.na.drop("any", subset=list(MODELS))


def _forecasts(spark, sf):
    """``(n_name, month, split, y, model, yhat)``."""
    return melt(_forecasts_wide(spark, sf), ["n_name", "month", "split", "y"], list(MODELS), "model", "yhat")


_SPLIT_SQL = """sp AS (SELECT n_name, month, revenue, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY n_name) AS n,
    CASE WHEN row_number() OVER w - 1 < floor(count(*) OVER (PARTITION BY n_name) * 0.8::DOUBLE + 1e-9) THEN 'train' ELSE 'test' END AS split
    FROM p1 WINDOW w AS (PARTITION BY n_name ORDER BY month))"""
_FW = f"""{P1_SQL}, {_SPLIT_SQL}, fw AS (SELECT * FROM (SELECT n_name, month, split, revenue AS y, lag(revenue, 1) OVER w AS naive, lag(revenue, 12) OVER w AS snaive,
    CASE WHEN count(revenue) OVER t = 3 THEN avg(revenue) OVER t END AS ma3 FROM sp
    WINDOW w AS (PARTITION BY n_name ORDER BY month), t AS (PARTITION BY n_name ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE snaive IS NOT NULL AND ma3 IS NOT NULL)"""
_FL = f"""{_FW}, fl AS ({' UNION ALL '.join(f"SELECT n_name, month, split, y, '{m}' AS model, {m} AS yhat FROM fw" for m in MODELS)})"""


def _metrics_sql(y: str = "y", p: str = "yhat", where: str = "TRUE") -> dict[str, str]:
    f = f"FILTER (WHERE {where})"
    mse = f"avg(({y} - {p}) * ({y} - {p})) {f}"
    return {
        "mae": f"avg(abs({y} - {p})) {f}",
        "mse": mse,
        "rmse": f"sqrt({mse})",
        "r2": f"1 - {mse} / NULLIF(var_pop({y}) {f}, 0)",
        "mape": f"avg(CASE WHEN {y} <> 0 THEN abs(({y} - {p}) / {y}) END) {f} * 100",
    }


_DIGITS = {"mae": 3, "mse": 0, "rmse": 3, "r2": 6, "mape": 5}
_M = _metrics_sql()
_METRICS = ", ".join(f"{r(_M[m], d)} AS {m}" for m, d in _DIGITS.items())


def _round_metrics(df):
    for name, digits in _DIGITS.items():
        named = [c for c in df.columns if c == name or c.endswith(f"_{name}")]
        df = round_columns(df, digits, *named) if named else df
    return df


# ---------------------------------------------------------------- split and scaling


@query("chrono_split", f"WITH {P1_SQL}, {_SPLIT_SQL} SELECT n_name, month, revenue, split FROM sp")
def _chrono_split(spark, sf):
    return _split_panel(spark, sf)


@query(
    "standard_scale",
    f"""WITH {P1_SQL}, {_SPLIT_SQL}, s AS (SELECT n_name, avg(revenue) AS a, stddev_pop(revenue) AS b FROM sp WHERE split = 'train' GROUP BY 1)
        SELECT n_name, month, split, {r('(revenue - a) / b', 6)} AS revenue FROM sp JOIN s USING (n_name)""",
)
def _standard_scale(spark, sf):
    return round_columns(bt.scale_on_train(_split_panel(spark, sf), keys=["n_name"], cols=["revenue"]), 6)


@query(
    "minmax_scale",
    f"""WITH {P1_SQL}, {_SPLIT_SQL}, s AS (SELECT n_name, min(revenue) AS a, max(revenue) - min(revenue) AS b FROM sp WHERE split = 'train' GROUP BY 1)
        SELECT n_name, month, split, {r('(revenue - a) / b', 6)} AS revenue FROM sp JOIN s USING (n_name)""",
)
def _minmax_scale(spark, sf):
    return round_columns(bt.scale_on_train(_split_panel(spark, sf), keys=["n_name"], cols=["revenue"], method="minmax"), 6)


# ---------------------------------------------------------------- metrics


@query("forecast_metrics", f"WITH {_FL} SELECT n_name, model, {_METRICS} FROM fl GROUP BY 1, 2")
def _forecast_metrics(spark, sf):
    return _round_metrics(me.forecast_metrics(_forecasts(spark, sf), keys=BY_MODEL))


@query(
    "mase",
    f"""WITH {_FL}, s AS (SELECT n_name, avg(abs(d)) AS scale FROM (SELECT n_name, revenue - lag(revenue, 12) OVER (PARTITION BY n_name ORDER BY month) AS d FROM sp WHERE split = 'train') GROUP BY 1)
        SELECT n_name, model, {r('avg(abs(y - yhat)) / max(scale)', 6)} AS mase FROM fl JOIN s USING (n_name) WHERE split = 'test' GROUP BY 1, 2""",
)
def _mase(spark, sf):
    test = _forecasts(spark, sf).filter("split = 'test'")
    train = _split_panel(spark, sf).filter("split = 'train'").withColumnRenamed("revenue", "y")
    return round_columns(me.mase(test, train, **NATION, model=["model"]), 6)


@query(
    "weighted_rmse",
    f"WITH {_FL} SELECT n_name, model, {r('sqrt(sum((y - yhat) * (y - yhat) / (abs(y) + 1)) / sum(1 / (abs(y) + 1)))', 3)} AS weighted_rmse FROM fl GROUP BY 1, 2",
)
def _weighted_rmse(spark, sf):
    return round_columns(me.weighted_rmse(_forecasts(spark, sf), keys=BY_MODEL), 3)


@query(
    "log_rmse_ratio",
    f"""WITH {_FL}, l AS (SELECT n_name, model, split, pow(ln(1 + y) - ln(1 + yhat), 2) AS e2 FROM fl),
        m AS (SELECT n_name, model, sqrt(avg(e2) FILTER (WHERE split = 'train')) AS a, sqrt(avg(e2) FILTER (WHERE split = 'test')) AS b FROM l GROUP BY 1, 2)
        SELECT n_name, model, {r('a', 6)} AS train_log_rmse, {r('b', 6)} AS test_log_rmse, {r('b / NULLIF(a, 0)', 6)} AS ratio FROM m""",
)
def _log_rmse_ratio(spark, sf):
    return round_columns(me.log_rmse_ratio(_forecasts(spark, sf), keys=BY_MODEL, split="split"), 6)


_T_VALUES = ", ".join(f"({d + 1}, {t_quantile(0.975, d)!r})" for d in range(1, 101))


@query(
    "metric_ci",
    f"""WITH {_FL}, t(n, t) AS (VALUES {_T_VALUES}),
        m AS (SELECT n_name, model, count(*) AS n, avg(y - yhat) AS error, avg(abs(y - yhat)) AS mae, avg(pow(y - yhat, 2)) AS mse,
              stddev_samp(y - yhat) AS se, stddev_samp(abs(y - yhat)) AS sa, stddev_samp(pow(y - yhat, 2)) AS ss FROM fl GROUP BY 1, 2),
        c AS (SELECT m.*, t.t::DOUBLE / sqrt(m.n) AS f FROM m JOIN t USING (n))
        SELECT n_name, model, n, {r('error', 3)} AS error, {r('error - f * se', 2)} AS error_lower, {r('error + f * se', 2)} AS error_upper,
          {r('mae', 3)} AS mae, {r('mae - f * sa', 2)} AS mae_lower, {r('mae + f * sa', 2)} AS mae_upper, {r('sqrt(mse)', 3)} AS rmse,
          {r('sqrt(greatest(mse - f * ss, 0))', 2)} AS rmse_lower, {r('sqrt(mse + f * ss)', 2)} AS rmse_upper FROM c""",
)
def _metric_ci(spark, sf):
    out = me.metric_intervals(_forecasts(spark, sf), keys=BY_MODEL).drop("mse", "mse_lower", "mse_upper")
    out = round_columns(out, 2, *[f"{m}_{s}" for m in ("error", "mae", "rmse") for s in ("lower", "upper")])
    return round_columns(out, 3, "error", "mae", "rmse")


@query(
    "test_set_profile",
    f"""WITH {P1_SQL}, {_SPLIT_SQL}, g AS (SELECT n_name, revenue, revenue / NULLIF(lag(revenue) OVER (PARTITION BY n_name ORDER BY month), 0) - 1 AS g FROM sp WHERE split = 'test')
        SELECT n_name, count(revenue) AS n, {r('avg(revenue)', 3)} AS mean_value, {r('stddev_samp(revenue)', 3)} AS std_value, {r('avg(g)', 6)} AS mean_growth,
          {r('stddev_samp(g)', 6)} AS std_growth, {r('min(g)', 6)} AS min_growth, {r('max(g)', 6)} AS max_growth FROM g GROUP BY 1""",
)
def _test_set_profile(spark, sf):
    test = _split_panel(spark, sf).filter("split = 'test'")
    out = me.test_set_profile(test, **NATION, col="revenue")
    return round_columns(round_columns(out, 3, "mean_value", "std_value"), 6, "mean_growth", "std_growth", "min_growth", "max_growth")


def _wins_sql(name: str, a: str, b: str) -> str:
    return f"count(*) FILTER (WHERE {a} < {b}) AS {name}_first_wins, count(*) FILTER (WHERE {b} < {a}) AS {name}_second_wins"


@query(
    "forecast_wins",
    f"""WITH {_FW}, e AS (SELECT n_name, y, abs(y - naive) AS a, abs(y - snaive) AS b FROM fw)
        SELECT n_name, {_wins_sql('abs', 'a', 'b')}, {_wins_sql('pct', 'a / NULLIF(abs(y), 0)', 'b / NULLIF(abs(y), 0)')},
          {_wins_sql('weighted', 'a * a / (abs(y) + 1)', 'b * b / (abs(y) + 1)')} FROM e GROUP BY 1""",
)
def _forecast_wins(spark, sf):
    return me.forecast_wins(_forecasts_wide(spark, sf), keys=["n_name"], first="naive", second="snaive")


_RANKED = f"""{_FL}, m AS (SELECT n_name, model, {_M['rmse']} AS rmse, {_M['mae']} AS mae FROM fl WHERE split = 'test' GROUP BY 1, 2),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY n_name ORDER BY rmse, model) AS INT) AS rank FROM m)"""


def _test_metrics(spark, sf):
    test = _forecasts(spark, sf).filter("split = 'test'")
    return me.forecast_metrics(test, keys=BY_MODEL)


@query("best_model", f"WITH {_RANKED} SELECT n_name, model, {r('rmse', 3)} AS rmse FROM k WHERE rank = 1")
def _best_model(spark, sf):
    best = me.top_models(_test_metrics(spark, sf), keys=["n_name"], k=1)
    return round_columns(best.select("n_name", "model", "rmse"), 3)


@query("topk_models", f"WITH {_RANKED} SELECT n_name, model, rank, {r('rmse', 3)} AS rmse, {r('mae', 3)} AS mae FROM k WHERE rank <= 2")
def _topk_models(spark, sf):
    best = me.top_models(_test_metrics(spark, sf), keys=["n_name"], k=2)
    return round_columns(best.select("n_name", "model", "rank", "rmse", "mae"), 3)


@query("union_results", f"WITH {_FL} SELECT n_name, month, y, yhat, model FROM fl WHERE model IN ('naive', 'ma3')")
def _union_results(spark, sf):
    wide = _forecasts_wide(spark, sf)
    return me.union_results({m: wide.select("n_name", "month", "y", F.col(m).alias("yhat")) for m in ("naive", "ma3")})


@query(
    "performance_band",
    f"""WITH {_FL}, m AS (SELECT n_name, model, {_M['r2']} AS r2 FROM fl GROUP BY 1, 2), b AS (SELECT model, avg(r2) AS mean_r2 FROM m GROUP BY 1)
        SELECT model, {r('mean_r2', 6)} AS mean_r2, CASE WHEN mean_r2 < 0.3 THEN 'poor' WHEN mean_r2 < 0.7 THEN 'moderate' ELSE 'good' END AS band FROM b""",
)
def _performance_band(spark, sf):
    scores = me.forecast_metrics(_forecasts(spark, sf), keys=BY_MODEL)
    return round_columns(me.performance_band(scores, keys=["model"]), 6)


_TRAIN, _TEST = _metrics_sql(where="split = 'train'"), _metrics_sql(where="split = 'test'")


@query(
    "overfitting_class",
    f"""WITH {_FL}, m AS (SELECT n_name, model, {_TRAIN['rmse']} AS a, {_TEST['rmse']} AS b, {_TRAIN['r2']} AS c, {_TEST['r2']} AS d FROM fl GROUP BY 1, 2)
        SELECT n_name, model, {r('a', 3)} AS train_rmse, {r('b', 3)} AS test_rmse, {r('c', 6)} AS train_r2, {r('d', 6)} AS test_r2, {r('b - a', 3)} AS rmse_diff,
          {r('(b - a) / a * 100', 5)} AS rmse_pct_increase, {r('c - d', 6)} AS r2_diff,
          CASE WHEN (b - a) / a * 100 > 20 OR c - d > 0.2 THEN 'severe' WHEN (b - a) / a * 100 > 10 OR c - d > 0.1 THEN 'moderate' ELSE 'none' END AS status FROM m""",
)
def _overfitting_class(spark, sf):
    out = me.overfitting_class(_forecasts(spark, sf), keys=BY_MODEL, split="split")
    out = round_columns(out, 3, "train_rmse", "test_rmse", "rmse_diff")
    return round_columns(round_columns(out, 6, "train_r2", "test_r2", "r2_diff"), 5, "rmse_pct_increase")


# ---------------------------------------------------------------- back-tests

_POS_SQL = """d AS (SELECT n_name, month, revenue, lag(revenue, 12) OVER w AS revenue_lag_12, row_number() OVER w - 1 AS pos,
    count(*) OVER (PARTITION BY n_name) AS n FROM p1 WINDOW w AS (PARTITION BY n_name ORDER BY month))"""
_WIN_SQL = f"""{P1_SQL}, {_POS_SQL}, st AS (SELECT n_name, unnest(range(24, n - 12 + 1, 3)) AS i, 12 AS size FROM (SELECT DISTINCT n_name, n FROM d)),
    win AS (SELECT n_name, CAST((i - 24) / 3 AS INT) AS "window", CAST(i AS INT) AS i, size FROM st)"""
_FOLD_SQL = f"""{P1_SQL}, {_POS_SQL}, st AS (SELECT n_name, n, CAST(floor(n / 6) AS BIGINT) AS size, unnest(range(0, 5)) AS f FROM (SELECT DISTINCT n_name, n FROM d)),
    win AS (SELECT n_name, CAST(f AS INT) AS "window", CAST(n - size * (5 - f) AS INT) AS i, size FROM st)"""
_TEST_SQL = """te AS (SELECT win.n_name, win."window", win.i, d.month, d.pos, d.revenue, d.revenue_lag_12 FROM win JOIN d ON d.n_name = win.n_name AND d.pos BETWEEN i AND i + size - 1)"""


WALK = bt.walk_forward(min_train=24, window=12, step=3)


@query(
    "backtest_windows",
    f"""WITH {_WIN_SQL} SELECT w.n_name, w."window", i AS test_from, a.month AS train_start, b.month AS train_end, c.month AS test_start, e.month AS test_end
        FROM win w JOIN d a ON a.n_name = w.n_name AND a.pos = 0 JOIN d b ON b.n_name = w.n_name AND b.pos = i - 1
        JOIN d c ON c.n_name = w.n_name AND c.pos = i JOIN d e ON e.n_name = w.n_name AND e.pos = i + 11""",
)
def _backtest_windows(spark, sf):
    return bt.backtest_windows(_revenue(spark, sf), WALK, **NATION)


@query(
    "backtest_split",
    f"""WITH {_WIN_SQL} SELECT w.n_name, w."window", d.month, d.revenue, CASE WHEN pos < i THEN 'train' ELSE 'test' END AS split
        FROM win w JOIN d ON d.n_name = w.n_name AND pos <= i + 11""",
)
def _backtest_split(spark, sf):
    return bt.backtest_split(_revenue(spark, sf), WALK, **NATION)


_NAIVE_SQL = f"""{_WIN_SQL}, {_TEST_SQL}, pr AS (SELECT te.n_name, te."window", te.month, te.revenue AS true_value, d.revenue AS predicted_value
    FROM te JOIN d ON d.n_name = te.n_name AND d.pos = te.pos - (floor((te.pos - te.i) / 12) + 1) * 12)"""


@query(
    "backtest_naive",
    f"""WITH {_NAIVE_SQL}, m AS (SELECT n_name, "window", avg(pow(true_value - predicted_value, 2)) AS mse, avg(abs(true_value - predicted_value)) AS mae, var_pop(true_value) AS v FROM pr GROUP BY 1, 2)
        SELECT n_name, "window", month, true_value, predicted_value, true_value AS true_value_original, predicted_value AS predicted_value_original,
          true_value - predicted_value AS error, pow(true_value - predicted_value, 2) AS squared_error, abs(true_value - predicted_value) AS absolute_error,
          {r('mse', 0)} AS window_mse, {r('sqrt(mse)', 3)} AS window_rmse, {r('mae', 3)} AS window_mae, {r('1 - mse / NULLIF(v, 0)', 6)} AS window_r2
        FROM pr JOIN m USING (n_name, "window")""",
)
def _backtest_naive(spark, sf):
    panel = _revenue(spark, sf)
    made = bt.backtest_naive(panel, WALK, **NATION, target="revenue", season=12)
    return _round_metrics(bt.backtest_records(made, keys=["n_name"]))


def _lagged(spark, sf):
    return lag_features(_revenue(spark, sf), **NATION, cols=["revenue"], lags=[12])


_LINEAR_SQL = """run AS (SELECT n_name, pos + 1 AS i, regr_slope(revenue, revenue_lag_12) OVER w AS b, regr_intercept(revenue, revenue_lag_12) OVER w AS a
    FROM d WINDOW w AS (PARTITION BY n_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    pr AS (SELECT te.n_name, te."window", te.month, te.revenue AS true_value, a + b * te.revenue_lag_12 AS predicted_value FROM te JOIN run USING (n_name, i))"""


@query(
    "backtest_linear",
    f"""WITH {_WIN_SQL}, {_TEST_SQL}, {_LINEAR_SQL} SELECT n_name, "window", month, true_value, {r('predicted_value', 1)} AS predicted_value FROM pr""",
)
def _backtest_linear(spark, sf):
    made = bt.backtest_linear(_lagged(spark, sf), WALK, **NATION, target="revenue", features=["revenue_lag_12"])
    return round_columns(made, 1, "predicted_value")


_PRM = _metrics_sql("true_value", "predicted_value")


@query(
    "backtest_metrics",
    f"""WITH {_NAIVE_SQL} SELECT n_name, count(*) AS n, {', '.join(f'{r(_PRM[m], d)} AS {m}' for m, d in _DIGITS.items())},
          {r('stddev_samp(true_value - predicted_value)', 3)} AS error_std, {r('stddev_samp(true_value - predicted_value) * -1.96', 3)} AS band_lower,
          {r('stddev_samp(true_value - predicted_value) * 1.96', 3)} AS band_upper FROM pr GROUP BY 1""",
)
def _backtest_metrics(spark, sf):
    made = bt.backtest_naive(_revenue(spark, sf), WALK, **NATION, target="revenue", season=12)
    out = bt.backtest_metrics(bt.backtest_records(made, keys=["n_name"]), keys=["n_name"])
    return round_columns(_round_metrics(out), 3, "error_std", "band_lower", "band_upper")


@query(
    "ts_cv",
    f"""WITH {_FOLD_SQL}, {_TEST_SQL}, {_LINEAR_SQL}, f AS (SELECT n_name, "window", {_PRM['mae']} AS mae, {_PRM['rmse']} AS rmse, {_PRM['r2']} AS r2 FROM pr GROUP BY 1, 2)
        SELECT n_name, count(*) AS folds, {', '.join(f"{r(f'{fn}({m})', d)} AS {m}_{n}" for m, d in (('mae', 2), ('rmse', 2), ('r2', 5)) for fn, n in (('avg', 'mean'), ('stddev_pop', 'std')))} FROM f GROUP BY 1""",
)
def _ts_cv(spark, sf):
    panel = _lagged(spark, sf)
    made = bt.backtest_linear(panel, bt.time_ordered_folds(5), **NATION, target="revenue", features=["revenue_lag_12"])
    out = bt.fold_summary(bt.backtest_records(made, keys=["n_name"]), keys=["n_name"])
    out = round_columns(out, 5, "r2_mean", "r2_std")
    return round_columns(out, 2, "mae_mean", "mae_std", "rmse_mean", "rmse_std")


_CURVE_SQL = f"""{P1_SQL}, {_POS_SQL}, fo AS (SELECT n_name, f, n - CAST(floor(n / 6) AS BIGINT) * (5 - f) AS i, CAST(floor(n / 6) AS BIGINT) AS size
      FROM (SELECT DISTINCT n_name, n FROM d), range(0, 5) t(f)),
    sh AS (SELECT fo.*, k, greatest(CAST(floor(i * k / 10) AS BIGINT), 3) AS train_rows FROM fo, range(1, 11) t(k)),
    run AS (SELECT n_name, pos + 1 AS train_rows, regr_slope(revenue, revenue_lag_12) OVER w AS b, regr_intercept(revenue, revenue_lag_12) OVER w AS a
      FROM d WINDOW w AS (PARTITION BY n_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    pr AS (SELECT sh.n_name, sh.f, sh.k, d.revenue - (run.a + run.b * d.revenue_lag_12) AS e FROM sh JOIN run USING (n_name, train_rows)
      JOIN d ON d.n_name = sh.n_name AND d.pos BETWEEN sh.i AND sh.i + sh.size - 1),
    pf AS (SELECT n_name, k, f, sqrt(avg(e * e)) AS rmse FROM pr GROUP BY ALL)"""


@query(
    "learning_curve",
    f"""WITH {_CURVE_SQL} SELECT n_name, CAST(k AS INT) AS size_step, {r('avg(rmse)', 1)} AS test_rmse_mean, {r('stddev_pop(rmse)', 1)} AS test_rmse_std FROM pf GROUP BY 1, 2""",
)
def _learning_curve(spark, sf):
    out = bt.learning_curve(_lagged(spark, sf), **NATION, target="revenue", features=["revenue_lag_12"])
    return round_columns(out, 1)


@query("learning_curve_two_features")
def _learning_curve_two_features(spark, sf):
    panel = lag_features(_revenue(spark, sf), **NATION, cols=["revenue"], lags=[1, 12])
    out = bt.learning_curve(panel, **NATION, target="revenue", features=["revenue_lag_1", "revenue_lag_12"])
    return round_columns(out, 1)


# ------------------------------------------------- refits with a scaler a window

_REFIT_SQL = f"""{_WIN_SQL}, {_TEST_SQL},
    tr AS (SELECT win.n_name, win."window", d.month, d.revenue, d.revenue_lag_12 AS x FROM win JOIN d ON d.n_name = win.n_name AND d.pos < i),
    st2 AS (SELECT n_name, "window", count(*) AS m, avg(x) AS mid, stddev_pop(x) AS sd, avg(revenue) AS level, covar_pop(x, revenue) AS cov
      FROM tr WHERE x IS NOT NULL AND revenue IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
    al AS (SELECT n_name, "window", 'train' AS split, month, revenue, x FROM tr
      UNION ALL SELECT n_name, "window", 'test', month, revenue, revenue_lag_12 FROM te),
    pr AS (SELECT n_name, "window", split, month, revenue AS true_value,
        level + CASE WHEN sd > 0 THEN (x - mid) / sd * (m * cov / sd) / (m + 2.0) ELSE x * 0 END AS predicted_value
      FROM al LEFT JOIN st2 USING (n_name, "window"))"""


def _refits(spark, sf, **options):
    return refit.backtest_refit(_lagged(spark, sf), WALK, **NATION, target="revenue", features=["revenue_lag_12"], **options)


@query(
    "backtest_refit_ridge",
    f"""WITH {_REFIT_SQL} SELECT n_name, "window", split, month, true_value, {r('predicted_value', 1)} AS predicted_value FROM pr""",
)
def _backtest_refit_ridge(spark, sf):
    return round_columns(_refits(spark, sf, alpha=2.0), 1, "predicted_value")


def _side_sql(name: str) -> str:
    error, y = "true_value - predicted_value", "true_value"
    only = f"FILTER (WHERE split = '{name}')"
    known = f"FILTER (WHERE split = '{name}' AND predicted_value IS NOT NULL)"
    mse = f"avg(({error}) * ({error})) {only}"
    r2 = f"1 - CASE WHEN var_pop({y}) {known} <> 0 THEN {mse} / (var_pop({y}) {known}) END"
    return f"{r(f'avg(abs({error})) {only}', 1)} AS {name}_mae, {r(f'sqrt({mse})', 1)} AS {name}_rmse, {r(r2, 5)} AS {name}_r2"


@query(
    "refit_split_metrics",
    f"""WITH {_REFIT_SQL} SELECT n_name, "window", {_side_sql('train')}, {_side_sql('test')} FROM pr GROUP BY ALL""",
)
def _refit_split_metrics(spark, sf):
    out = refit.split_metrics(_refits(spark, sf, alpha=2.0), keys=["n_name"]).drop("rmse_rise_pct")
    out = round_columns(out, 5, "train_r2", "test_r2")
    return round_columns(out, 1, "train_mae", "train_rmse", "test_mae", "test_rmse")


@query("backtest_refit_forest")
def _backtest_refit_forest(spark, sf):
    panel = lag_features(_revenue(spark, sf), **NATION, cols=["revenue"], lags=[1, 12])
    return refit.backtest_refit(panel, WALK, **NATION, target="revenue", features=["revenue_lag_1", "revenue_lag_12"], model="forest")


# ---------------------------------------------------------------- regression


@query(
    "linear_regression",
    f"""WITH {P1_SQL} SELECT n_name, count(*) AS n, {r('regr_slope(revenue, qty)', 4)} AS b_qty, {r('regr_intercept(revenue, qty)', 1)} AS intercept,
          {r('pow(corr(revenue, qty), 2)', 6)} AS r2 FROM p1 GROUP BY 1""",
)
def _linear_regression(spark, sf):
    out = st.ols_by(nation_panel(spark, sf), ["qty"], "revenue", keys=["n_name"])
    return round_columns(round_columns(round_columns(out, 4, "b_qty"), 1, "intercept"), 6, "r2")


_IMPACT = "(ya - ab * yb) / (1 - ab * ab) AS ca, (yb - ab * ya) / (1 - ab * ab) AS cb"


@query(
    "commodity_impact",
    f"""WITH {P1_SQL}, c AS (SELECT n_name, corr(revenue, qty) AS ya, corr(revenue, avg_disc) AS yb, corr(qty, avg_disc) AS ab FROM p1 GROUP BY 1), k AS (SELECT n_name, {_IMPACT} FROM c)
        SELECT n_name, {r('ca', 6)} AS coef_qty, {r('cb', 6)} AS coef_avg_disc, {r('abs(ca) / (abs(ca) + abs(cb))', 6)} AS importance_qty,
          {r('abs(cb) / (abs(ca) + abs(cb))', 6)} AS importance_avg_disc FROM k""",
)
def _commodity_impact(spark, sf):
    out = st.two_factor_impact(nation_panel(spark, sf), keys=["n_name"], target="revenue", factors=("qty", "avg_disc"))
    return round_columns(out, 6)


# ---------------------------------------------------------------- ensembles

_TRAIN_M = f"""{_FL}, tm AS (SELECT n_name, model, {_M['mse']} AS mse, {_M['r2']} AS r2 FROM fl WHERE split = 'train' GROUP BY 1, 2),
    wi AS (SELECT n_name, model, (1 / mse) / sum(1 / mse) OVER (PARTITION BY n_name) AS weight FROM tm),
    wr0 AS (SELECT n_name, model, CASE WHEN max(r2) OVER (PARTITION BY n_name) < 0 THEN 1 / mse ELSE greatest(r2, 0) + 0.001::DOUBLE END AS raw FROM tm),
    wr AS (SELECT n_name, model, raw / sum(raw) OVER (PARTITION BY n_name) AS weight FROM wr0)"""


def _train_metrics(spark, sf):
    return me.forecast_metrics(_forecasts(spark, sf).filter("split = 'train'"), keys=BY_MODEL)


@query("weights_inverse_mse", f"WITH {_TRAIN_M} SELECT n_name, model, {r('weight', 6)} AS weight FROM wi")
def _weights_inverse_mse(spark, sf):
    return round_columns(en.weights_inverse_mse(_train_metrics(spark, sf), keys=["n_name"]), 6)


@query("weights_r2", f"WITH {_TRAIN_M} SELECT n_name, model, {r('weight', 6)} AS weight FROM wr")
def _weights_r2(spark, sf):
    return round_columns(en.weights_r2(_train_metrics(spark, sf), keys=["n_name"]), 6)


_T2 = repr(t_quantile(0.975, 2))
_EN_SQL = f"""{_TRAIN_M}, ep AS (SELECT n_name, month, max(y) AS y, sum(yhat * weight) / sum(weight) AS prediction, stddev_pop(yhat) AS std, count(*) AS n_models
    FROM fl JOIN wi USING (n_name, model) WHERE split = 'test' GROUP BY 1, 2)"""


def _ensemble(spark, sf):
    weights = en.weights_inverse_mse(_train_metrics(spark, sf), keys=["n_name"])
    test = _forecasts(spark, sf).filter("split = 'test'")
    return en.ensemble_predict(test, weights, keys=["n_name"], row=["month", "y"])


@query(
    "ensemble_predict",
    f"""WITH {_EN_SQL} SELECT n_name, month, y, {r('prediction', 2)} AS prediction, {r('std', 2)} AS std, n_models,
          {r(f'prediction - std * {_T2}', 2)} AS lower, {r(f'prediction + std * {_T2}', 2)} AS upper FROM ep""",
)
def _ensemble_predict(spark, sf):
    return round_columns(_ensemble(spark, sf), 2, "prediction", "std", "lower", "upper")


@query("ensemble_mean", f"WITH {_FL} SELECT n_name, month, {r('avg(yhat)', 2)} AS prediction FROM fl GROUP BY 1, 2")
def _ensemble_mean(spark, sf):
    return round_columns(en.ensemble_mean(_forecasts(spark, sf), keys=["n_name"], row=["month"]), 2)


@query(
    "interval_coverage",
    f"""WITH {_EN_SQL}, b AS (SELECT n_name, y, prediction - std * {_T2} AS lo, prediction + std * {_T2} AS hi FROM ep)
        SELECT n_name, {r('avg(CAST(y BETWEEN lo AND hi AS DOUBLE))', 6)} AS coverage, {r('avg(hi - lo)', 2)} AS mean_width, {r('stddev_pop(hi - lo)', 2)} AS std_width FROM b GROUP BY 1""",
)
def _interval_coverage(spark, sf):
    out = me.interval_coverage(_ensemble(spark, sf), keys=["n_name"])
    return round_columns(round_columns(out, 6, "coverage"), 2, "mean_width", "std_width")


_NOW, _STORED = _metrics_sql("y", "p"), _metrics_sql("y", "p0")


@query(
    "ensemble_evaluate",
    f"""WITH {_TRAIN_M}, sc AS (SELECT n_name, model, greatest({_M['r2']}, 0) + 0.01::DOUBLE AS raw FROM fl WHERE split = 'test' GROUP BY 1, 2),
        w AS (SELECT sc.n_name, sc.model, CASE WHEN sum(raw) OVER (PARTITION BY sc.n_name) < 0.1 THEN weight ELSE raw / sum(raw) OVER (PARTITION BY sc.n_name) END AS w, weight AS w0
              FROM sc JOIN wr ON sc.n_name = wr.n_name AND sc.model = wr.model),
        c AS (SELECT n_name, month, max(y) AS y, sum(yhat * w) / sum(w) AS p, sum(yhat * w0) / sum(w0) AS p0, stddev_pop(yhat) * {_T2} AS reach
              FROM fl JOIN w USING (n_name, model) WHERE split = 'test' GROUP BY 1, 2)
        SELECT n_name, {r(_NOW['mae'], 2)} AS mae, {r(_NOW['rmse'], 2)} AS rmse, {r(_NOW['r2'], 6)} AS r2, {r('avg(CAST(abs(y - p) <= reach AS DOUBLE))', 6)} AS coverage,
          {r('avg(reach * 2)', 2)} AS mean_width, {r(_STORED['rmse'], 2)} AS stored_rmse, {r(_STORED['r2'], 6)} AS stored_r2 FROM c GROUP BY 1""",
)
def _ensemble_evaluate(spark, sf):
    stored = en.weights_r2(_train_metrics(spark, sf), keys=["n_name"])
    test = _forecasts(spark, sf).filter("split = 'test'")
    out = en.ensemble_evaluate(test, stored, keys=["n_name"], row=["month"])
    out = round_columns(out, 2, "mae", "rmse", "mean_width", "stored_rmse")
    return round_columns(out, 6, "r2", "coverage", "stored_r2")


@query(
    "merge_weights",
    f"""WITH {_TRAIN_M}, u AS (SELECT n_name, model, CASE WHEN model = 'ma3' THEN NULL ELSE weight END AS weight FROM wi),
        s AS (SELECT n_name, model, coalesce(weight, greatest(1 - sum(weight) OVER (PARTITION BY n_name), 0) / count(*) FILTER (WHERE weight IS NULL) OVER (PARTITION BY n_name)) AS raw FROM u)
        SELECT n_name, model, {r('raw / sum(raw) OVER (PARTITION BY n_name)', 6)} AS weight FROM s""",
)
def _merge_weights(spark, sf):
    weights = en.weights_inverse_mse(_train_metrics(spark, sf), keys=["n_name"])
    stored = weights.filter("model <> 'ma3'")
    return round_columns(en.merge_weights(stored, weights.select("n_name", "model"), keys=["n_name"]), 6)


# ---------------------------------------------------------------- forecasts and scenarios

_FC_SQL = f"""{P1_SQL}, o AS (SELECT n_name, month, revenue, row_number() OVER (PARTITION BY n_name ORDER BY month) - 1 AS pos, count(*) OVER (PARTITION BY n_name) AS n FROM p1),
    e AS (SELECT n_name, max(n) AS n, max(month) AS last_month, least(12, max(n) - 1) AS p, arg_max(revenue, month) AS last_value,
          max(CASE WHEN pos = greatest(n - 13, 0) THEN revenue END) AS first_value FROM o GROUP BY 1),
    g AS (SELECT *, CASE WHEN p > 0 AND first_value > 0 THEN pow(last_value / first_value, 1.0::DOUBLE / p) - 1 ELSE 0.02 END AS g FROM e),
    mm AS (SELECT n_name, month(month) AS m, avg(revenue) AS mean FROM p1 GROUP BY 1, 2),
    fa AS (SELECT n_name, m, mean / avg(mean) OVER (PARTITION BY n_name) AS s FROM mm),
    stp AS (SELECT g.*, i - 1 AS period, last_day(CAST(last_month + to_months(CAST(i AS INT)) AS DATE)) AS date FROM g, range(1, 13) t(i)),
    fs AS (SELECT stp.*, CASE WHEN n >= 13 THEN coalesce(s, 1) ELSE 1 END AS s FROM stp LEFT JOIN fa ON fa.n_name = stp.n_name AND fa.m = month(stp.date)),
    fc AS (SELECT n_name, CAST(period AS INT) AS period, date, last_value * pow(1 + g, period + 1) * product(s) OVER (PARTITION BY n_name ORDER BY period) AS forecast FROM fs)"""


def _baseline(spark, sf):
    return sc.growth_forecast(_revenue(spark, sf), **NATION, col="revenue").withColumnRenamed("month", "date")


@query(
    "forecast_seasonal",
    f"""WITH {_FC_SQL} SELECT n_name, period, date, {r('forecast', 2)} AS forecast, {r('forecast * (1 - (0.05::DOUBLE + period * 0.01::DOUBLE))', 2)} AS lower_bound,
          {r('forecast * (1 + (0.05::DOUBLE + period * 0.01::DOUBLE))', 2)} AS upper_bound FROM fc""",
)
def _forecast_seasonal(spark, sf):
    return round_columns(_baseline(spark, sf), 2)


@query("forecast_flatness", f"WITH {_FC_SQL}, f AS (SELECT n_name, stddev_samp(forecast) AS s, max(forecast) - min(forecast) AS w FROM fc GROUP BY 1) SELECT n_name, {r('s', 2)} AS std_value, {r('w', 2)} AS value_range, s < 0.1 OR w < 1 AS is_flat FROM f")
def _forecast_flatness(spark, sf):
    return round_columns(me.forecast_flatness(_baseline(spark, sf), keys=["n_name"], col="forecast"), 2)


def _scenario_values(periods: int) -> str:
    rows = []
    for name, given in sc.PREDEFINED.items():
        for i in range(periods):
            values = [given[p][min(i, len(given[p]) - 1)] for p in sc.PARAMETERS]
            rows.append(f"('{name}', {i}, {', '.join(f'{v}::DOUBLE' for v in values)})")
    return f"scn(scenario, period, {', '.join(sc.PARAMETERS)}) AS (VALUES {', '.join(rows)})"


_FACTOR = " * ".join(
    f"(1 + ({p} - {sc.PREDEFINED['baseline'][p][0]}::DOUBLE) * "
    + (f"CASE WHEN scenario = 'recession' AND gdp_growth < 0 THEN {w * 0.5}::DOUBLE ELSE {w}::DOUBLE END" if p == "gold_price_yoy" else f"{w}::DOUBLE")
    + " / 100)"
    for p, w in sc.IMPACT_WEIGHTS.items()
)
_RUN_SQL = f"""{_FC_SQL}, {_scenario_values(12)}, fx AS (SELECT *, CASE WHEN scenario = 'baseline' THEN 1.0::DOUBLE ELSE {_FACTOR} END AS factor FROM scn),
    run AS (SELECT n_name, scenario, fx.period, date, {', '.join(sc.PARAMETERS)}, factor, forecast, forecast * factor AS predicted_value FROM fc JOIN fx USING (period))"""


def _scenarios(spark, periods=12):
    return sc.define_scenarios(spark, sc.PREDEFINED, periods=periods)


def _run(spark, sf):
    return sc.run_scenarios(_baseline(spark, sf), _scenarios(spark))


_CUSTOM = {
    "short_list": {"gdp_growth": [6.0, 6.5], "inflation": [4.0]},
    "long_list": {"gdp_growth": [5.0, 4.0, 3.0, 2.0, 1.0, 0.0, -1.0, -2.0], "oil_price_yoy": [1.0, 2.0, 3.0]},
}


def _custom_values() -> str:
    rows = []
    for name, given in _CUSTOM.items():
        for i in range(6):
            vals = [f"{given[p][min(i, len(given[p]) - 1)]}::DOUBLE" if p in given else "NULL::DOUBLE" for p in sc.PARAMETERS]
            rows.append(f"('{name}', {i}, {', '.join(vals)})")
    return f"scn(scenario, period, {', '.join(sc.PARAMETERS)}) AS (VALUES {', '.join(rows)})"


@query(
    "define_scenarios",
    f"WITH {_FC_SQL}, {_custom_values()} SELECT n_name, date, scenario, CAST(period AS INT) AS period, {', '.join(sc.PARAMETERS)} FROM fc JOIN scn USING (period)",
)
def _define_scenarios(spark, sf):
    table = sc.define_scenarios(spark, _CUSTOM, periods=6)
    return _baseline(spark, sf).select("n_name", "date", "period").join(table, "period")


@query("scenario_table", f"WITH {_FC_SQL}, {_scenario_values(12)} SELECT n_name, date, scenario, CAST(period AS INT) AS period, {', '.join(sc.PARAMETERS)} FROM fc JOIN scn USING (period)")
def _scenario_table(spark, sf):
    return _baseline(spark, sf).select("n_name", "date", "period").join(_scenarios(spark), "period")


@query("scenario_impact", f"WITH {_RUN_SQL} SELECT n_name, scenario, CAST(period AS INT) AS period, {r('factor', 8)} AS factor, {r('predicted_value', 2)} AS predicted_value FROM run")
def _scenario_impact(spark, sf):
    out = _run(spark, sf).select("n_name", "scenario", "period", "factor", "predicted_value")
    return round_columns(round_columns(out, 8, "factor"), 2, "predicted_value")


@query("scenario_run", f"WITH {_RUN_SQL} SELECT n_name, date, {', '.join(sc.PARAMETERS)}, {r('predicted_value', 2)} AS predicted_value, scenario FROM run")
def _scenario_run(spark, sf):
    out = _run(spark, sf).select("n_name", "date", *sc.PARAMETERS, "predicted_value", "scenario")
    return round_columns(out, 2, "predicted_value")


@query(
    "scenario_compare",
    f"WITH {_RUN_SQL} SELECT n_name, date, {', '.join(r(f'''max(CASE WHEN scenario = '{s}' THEN predicted_value END)''', 2) + f' AS {s}' for s in sc.PREDEFINED)} FROM run GROUP BY 1, 2",
)
def _scenario_compare(spark, sf):
    return round_columns(sc.compare_scenarios(_run(spark, sf), keys=["n_name"], date="date", names=list(sc.PREDEFINED)), 2)


_SUMMARY_SQL = f"""{_RUN_SQL}, su AS (SELECT n_name, scenario, avg(predicted_value) AS a, max(predicted_value) AS b, min(predicted_value) AS c, arg_max(predicted_value, date) AS e FROM run GROUP BY 1, 2),
    sd AS (SELECT *, round((e - max(CASE WHEN scenario = 'baseline' THEN e END) OVER (PARTITION BY n_name)) / max(CASE WHEN scenario = 'baseline' THEN e END) OVER (PARTITION BY n_name) * 100, 2) + 0.0 AS diff FROM su)"""


@query(
    "scenario_summary",
    f"WITH {_SUMMARY_SQL} SELECT n_name, scenario, {r('a', 2)} AS avg_value, {r('b', 2)} AS max_value, {r('c', 2)} AS min_value, {r('e', 2)} AS end_value, diff AS pct_diff_from_baseline FROM sd",
)
def _scenario_summary(spark, sf):
    out = sc.scenario_summary(_run(spark, sf), keys=["n_name"], date="date")
    return round_columns(out, 2, "avg_value", "max_value", "min_value", "end_value")


@query(
    "scenario_sanity",
    f"""WITH {_SUMMARY_SQL} SELECT n_name, scenario, {r('e', 2)} AS end_value, diff AS pct_diff_from_baseline,
          (scenario = 'high_growth' AND diff < 0) OR (scenario = 'recession' AND diff > 0) AS suspicious FROM sd""",
)
def _scenario_sanity(spark, sf):
    out = sc.scenario_sanity(sc.scenario_summary(_run(spark, sf), keys=["n_name"], date="date"))
    return round_columns(out.select("n_name", "scenario", "end_value", "pct_diff_from_baseline", "suspicious"), 2, "end_value")


_LENDING = ("interest_rate_lending", "lending_rate_lending", "lending_rate_3m_avg_lending", "lending_rate_6m_avg_lending")
_PRICES = [(m, c) for m in ("oil", "gold") for c in (f"{m}_price", f"{m}_price_{m}", *[f"{m}_price_{d}d_avg_{m}" for d in (30, 90, 180)])]


@query(
    "scenario_features",
    f"""WITH {P1_SQL}, {_scenario_values(18)}, x AS (SELECT *, product(1 + oil_price_yoy / 100) OVER w AS oil, product(1 + gold_price_yoy / 100) OVER w AS gold FROM scn
          WINDOW w AS (PARTITION BY scenario, period % 12 ORDER BY period)),
        l AS (SELECT n_name, max(month) AS last_month, arg_max(revenue / NULLIF(qty, 0), month) AS gold_price, arg_max(qty, month) AS qty FROM p1 GROUP BY 1),
        y AS (SELECT l.*, x.*, last_day(CAST(last_month + to_months(CAST(period + 1 AS INT)) AS DATE)) AS date FROM l, x)
        SELECT n_name, scenario, CAST(period AS INT) AS period, date, {', '.join(sc.PARAMETERS)}, qty, CAST(month(date) AS INT) AS month,
          {r('sin(2 * pi() * month(date) / 12)', 6)} AS month_sin, {r('cos(2 * pi() * month(date) / 12)', 6)} AS month_cos, CAST(quarter(date) AS INT) AS quarter,
          CAST(year(date) AS INT) AS year, interest_rate AS interest_rate_repo, {', '.join(f'interest_rate + 2 AS {c}' for c in _LENDING)},
          {', '.join(r('80 * oil' if m == 'oil' else 'gold_price * gold', 4) + f' AS {c}' for m, c in _PRICES)},
          {', '.join(f'{v}::DOUBLE AS {c}' for c, v in sc.SCENARIO_CONSTANTS.items())} FROM y""",
)
def _scenario_features(spark, sf):
    panel = nation_panel(spark, sf)
    last = panel.groupBy("n_name").agg(
        F.max("month").alias("last_month"),
        F.max_by(F.try_divide("revenue", "qty"), "month").alias("gold_price"),
        F.max_by("qty", "month").alias("qty"),
    )
    out = sc.scenario_features(_scenarios(spark, 18), last, keys=["n_name"], last_date="last_month", carry=["qty"])
    out = round_columns(out, 6, "month_sin", "month_cos")
    return round_columns(out, 4, *[c for _, c in _PRICES])
