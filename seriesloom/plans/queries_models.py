"""Spark ML fits, per-series models and feature selection on the nation panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.expressions import round_columns
from seriesloom.operators import backtest as bt
from seriesloom.operators import models as ml
from seriesloom.operators import selection as sel
from seriesloom.operators import stats as st
from seriesloom.operators.scenario import model_bounds
from seriesloom.plans.registry import query, r
from seriesloom.plans.tables import P1_SQL, nation_panel, table
from seriesloom.session import settled

NATION = {"keys": ["n_name"], "date": "month"}
KEEP = ["n_name", "month", "split"]


def _design(spark, sf, scaled: bool = False, packed: bool = False):
    """Split design frame of the panel; ``scaled`` standardises on train rows, ``packed`` is for fits of many jobs."""
    panel = nation_panel(spark, sf)
    if packed:
        panel = ml.packed(panel, keys=["n_name"])
    frame, names = ml.design_frame(panel, **NATION, target="revenue", indicators=["qty", "avg_disc"])
    frame = bt.chrono_split(frame, **NATION)
    if scaled:
        frame = bt.scale_on_train(frame, keys=["n_name"], cols=[*names, "revenue"])
    return frame, names


def _train(frame):
    return frame.filter("split = 'train'")


def _scored(spark, sf, fit, scaled=False):
    frame, names = _design(spark, sf, scaled)
    model = fit(_train(frame), names, "revenue")
    return round_columns(ml.score(model, frame, keep=KEEP, target="revenue"), 4)


@query("ridge")
def _ridge(spark, sf):
    frame, names = _design(spark, sf, scaled=True)
    model = st.ols(_train(frame), names, "revenue", alpha=ml.RIDGE_ALPHA)
    out = st.predict_linear(frame, model, "yhat").select(*KEEP, F.col("revenue").alias("y"), "yhat")
    return round_columns(out, 4)


@query("lasso")
def _lasso(spark, sf):
    return _scored(spark, sf, ml.fit_lasso, scaled=True)


@query("elastic_net")
def _elastic_net(spark, sf):
    return _scored(spark, sf, ml.fit_elastic_net, scaled=True)


@query("random_forest")
def _random_forest(spark, sf):
    return _scored(spark, sf, ml.fit_forest)


@query("gbt")
def _gbt(spark, sf):
    return _scored(spark, sf, ml.fit_boosted)


FOREST_SPACE = {"numTrees": [20, 40], "maxDepth": [3, 5, 7], "minInstancesPerNode": [1, 5, 10]}


@query("hyperparam_search")
def _hyperparam_search(spark, sf):
    frame, names = _design(spark, sf, packed=True)
    return ml.hyperparameter_search(_train(frame), names, "revenue", date="month", family="forest", space=FOREST_SPACE, parallelism=8)


@query("hyperparam_best")
def _hyperparam_best(spark, sf):
    """Forecasts of the best setting, found and fitted on the train rows."""
    frame, names = _design(spark, sf, packed=True)
    frame = settled(frame)
    model, _, _ = ml.best_model(_train(frame), names, "revenue", date="month", family="forest", space=FOREST_SPACE, parallelism=8)
    return round_columns(ml.score(model, frame, keep=KEEP, target="revenue"), 4)


@query("forecast_frozen")
def _forecast_frozen(spark, sf):
    frame, names = _design(spark, sf)
    model = ml.fit_forest(frame, names, "revenue")
    return round_columns(model_bounds(ml.frozen_forecast(model, frame, names, **NATION), "forecast"), 4)


@query("panel_arima")
def _panel_arima(spark, sf):
    panel = nation_panel(spark, sf).select("n_name", "month", "revenue")
    parts = [
        ml.panel_arima(panel, **NATION, value="revenue", log=log).withColumn("variant", F.lit(name))
        for name, log in (("log1p", True), ("raw", False))
    ]
    return round_columns(reduce(DataFrame.unionByName, parts), 2)


@query("arima_grid")
def _arima_grid(spark, sf):
    panel = nation_panel(spark, sf).select("n_name", "month", F.log1p("revenue").alias("x"))
    return round_columns(ml.arima_grid(panel, **NATION, value="x"), 4)


def _det(rows: list[list[str]]) -> str:
    """SQL of a small determinant, by its first row."""
    if not rows:
        return "1.0"
    terms = [f"{'-' if j % 2 else '+'} {cell} * ({_det([r[:j] + r[j + 1 :] for r in rows[1:]])})" for j, cell in enumerate(rows[0])]
    return " ".join(terms)


def _cov(i: int, j: int) -> str:
    return f"c{min(i, j)}{max(i, j)}"


def _autoregression(p: int) -> str:
    """SQL of an autoregression of ``p`` lags from covariances: residual variance and
    whether all reflection coefficients lie inside the unit circle."""
    lags = range(1, p + 1)
    xx = [[_cov(i, j) for j in lags] for i in lags]
    whole = [[_cov(i, j) for j in range(p + 1)] for i in range(p + 1)]
    a = [f"(({_det([[_cov(0, i) if j == k else _cov(i, j) for j in lags] for i in lags])}) / ({_det(xx)}))" for k in lags]
    inside = []
    while a:
        last = a[-1]
        inside.append(f"abs({last}) < 1")
        a = [f"(({a[i]} + {last} * {a[-2 - i]}) / (1 - {last} * {last}))" for i in range(len(a) - 1)]
    return f"SELECT n_name, d, n, {p} AS p, ({_det(whole)}) / ({_det(xx)}) AS v, {' AND '.join(inside) or 'true'} AS stationary FROM m"


_COVS = ", ".join(f"covar_pop({'z' if not i else f'l{i}'}, {'z' if not j else f'l{j}'}) AS c{i}{j}" for i in range(4) for j in range(i, 4))


@query(
    "arima_orders_ar",
    f"""WITH {P1_SQL}, s AS (SELECT n_name, month, ln(1 + revenue) AS x FROM p1),
        g AS (SELECT n_name, CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM s GROUP BY 1),
        i AS (SELECT n_name, x, row_number() OVER (PARTITION BY n_name ORDER BY month) AS i FROM g LEFT JOIN s USING (n_name, month)),
        e AS (SELECT n_name, i, x, last_value(x IGNORE NULLS) OVER b AS px, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi,
                     first_value(x IGNORE NULLS) OVER f AS nx, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni FROM i
              WINDOW b AS (PARTITION BY n_name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY n_name ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        d0 AS (SELECT n_name, i, coalesce(x, px + (nx - px) * (i - pi) / (ni - pi)) AS z FROM e),
        d1 AS (SELECT n_name, i, z - lag(z) OVER (PARTITION BY n_name ORDER BY i) AS z FROM d0),
        d2 AS (SELECT n_name, i, z - lag(z) OVER (PARTITION BY n_name ORDER BY i) AS z FROM d1),
        u AS (SELECT 0 AS d, * FROM d0 UNION ALL SELECT 1, * FROM d1 UNION ALL SELECT 2, * FROM d2),
        w AS (SELECT d, n_name, i, z, lag(z, 1) OVER o AS l1, lag(z, 2) OVER o AS l2, lag(z, 3) OVER o AS l3 FROM u WINDOW o AS (PARTITION BY d, n_name ORDER BY i)),
        m AS (SELECT n_name, d, count(*) AS n, {_COVS} FROM w WHERE i > 5 GROUP BY 1, 2),
        v AS ({' UNION ALL '.join(_autoregression(p) for p in range(4))}),
        k AS (SELECT *, n * ln(v) + 2 * (p + 1) AS aic, n * ln(v) + ln(n) * (p + 1) AS bic FROM v)
        SELECT n_name, p, d, 0 AS q, n, {r('aic', 4)} AS aic, {r('bic', 4)} AS bic, stationary, true AS invertible,
               stationary AND row_number() OVER (PARTITION BY n_name ORDER BY stationary DESC, aic, p, d) = 1 AS is_best FROM k""",
)
def _arima_orders_ar(spark, sf):
    panel = nation_panel(spark, sf).select("n_name", "month", F.log1p("revenue").alias("x"))
    orders = [o for o in ml.all_orders() if o[2] == 0]
    return round_columns(ml.arima_grid(panel, **NATION, value="x", orders=orders), 4)


# ---------------------------------------------------------------- selection


def _chosen(spark, names, chosen):
    rows = [(f, f in chosen) for f in names]
    return spark.createDataFrame(rows, "feature string, selected boolean")


@query("vif_selection")
def _vif_selection(spark, sf):
    frame, names = _design(spark, sf)
    return _chosen(spark, names, sel.select_by_vif(frame, names, threshold=10.0))


@query("rfe_forest")
def _rfe_forest(spark, sf):
    frame, names = _design(spark, sf)
    return _chosen(spark, names, sel.rfe_forest(frame, names, "revenue", step=2))


@query("rfe_ridge")
def _rfe_ridge(spark, sf):
    frame, names = _design(spark, sf)
    return _chosen(spark, names, sel.rfe_ridge(frame, names, "revenue", keep=6))


@query("pca_reduce")
def _pca_reduce(spark, sf):
    frame, names = _design(spark, sf)
    return round_columns(sel.pca(frame, names)[1], 6)


@query(
    "pca_reduced_two",
    f"""WITH m AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my, stddev_pop(l_extendedprice) AS sy,
                      corr(l_quantity, l_extendedprice) AS c FROM lineitem),
        z AS (SELECT l_orderkey, l_linenumber, (l_quantity - mx) / sx AS x, sign(c) * (l_extendedprice - my) / sy AS y FROM lineitem, m)
        SELECT l_orderkey, l_linenumber, {r('(x + y) / sqrt(2)', 5)} AS PC1, {r('(x - y) / sqrt(2)', 5)} AS PC2, 0 AS gaps FROM z""",
)
def _pca_reduced_two(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return round_columns(sel.pca_reduced(lines, ["l_quantity", "l_extendedprice"], variance=1.0), 5)


@query("pca_reduced")
def _pca_reduced(spark, sf):
    frame, names = _design(spark, sf)
    return round_columns(sel.pca_reduced(frame.select("n_name", "month", *names), names), 4)


@query("importance_selection")
def _importance_selection(spark, sf):
    frame, names = _design(spark, sf)
    return _chosen(spark, names, sel.select_by_importance(frame, names, "revenue"))


@query("priority_selection")
def _priority_selection(spark, sf):
    frame, names = _design(spark, sf)
    importance = sel.forest_importance(frame, names, "revenue")
    return _chosen(spark, names, sel.select_with_priority(names, importance, max_features=10))


@query("feature_selection")
def _feature_selection(spark, sf):
    frame, names = _design(spark, sf)
    chosen = sel.select_features(frame, names, "revenue", keep=5)
    return round_columns(frame.select("n_name", "month", *chosen, "revenue"), 4)


@query("feature_importance")
def _feature_importance(spark, sf):
    frame, names = _design(spark, sf)
    return round_columns(sel.importance_table(frame, sel.forest_importance(frame, names, "revenue"), top=10), 6)
