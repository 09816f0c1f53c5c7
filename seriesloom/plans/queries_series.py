"""Window features over the panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.expressions import round_columns
from seriesloom.operators import features as ft
from seriesloom.plans.registry import query, r
from seriesloom.plans.tables import P1_SQL, P2_DENSE_SQL, nation_panel, user_days_dense

NATION = {"keys": ["n_name"], "date": "month"}
_W = "OVER (PARTITION BY n_name ORDER BY month)"


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY n_name ORDER BY month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _roll(fn: str, col: str, n: int, need: int | None = None) -> str:
    return f"CASE WHEN count({col}) {_frame(n)} >= {need or n} THEN {fn}({col}) {_frame(n)} END"


def _lag(col: str, k: int) -> str:
    return f"lag({col}, {k}) {_W}"


def _panel(spark, sf, *cols):
    return nation_panel(spark, sf).select("n_name", "month", *cols)


def _select(*items: str) -> str:
    return f"WITH {P1_SQL} SELECT n_name, month, {', '.join(items)} FROM p1"


@query("lag_features", _select("revenue", "qty", *[f"{_lag(c, k)} AS {c}_lag_{k}" for c in ("revenue", "qty") for k in (1, 2, 3)]))
def _lag_features(spark, sf):
    return ft.lag_features(_panel(spark, sf, "revenue", "qty"), **NATION, cols=["revenue", "qty"], lags=3)


@query(
    "rolling_features",
    _select(
        *[f"{r(_roll('avg', 'revenue', n), 4)} AS revenue_mean_{n}" for n in (3, 6, 12)],
        *[f"{r(_roll('stddev_pop', 'revenue', n), 4)} AS revenue_std_{n}" for n in (3, 6, 12)],
    ),
)
def _rolling_features(spark, sf):
    return round_columns(ft.rolling_features(_panel(spark, sf, "revenue"), **NATION, cols=["revenue"]).drop("revenue"), 4)


@query("rolling_custom", _select(f"{r(_roll('max', 'revenue', 3) + ' - ' + _roll('min', 'revenue', 3), 4)} AS revenue_range_3"))
def _rolling_custom(spark, sf):
    made = ft.rolling_features(
        _panel(spark, sf, "revenue"), **NATION, cols=["revenue"], windows=[3], functions={"range": lambda s: s.max() - s.min()}
    )
    return round_columns(made.drop("revenue"), 4)


@query("rolling_mean", _select(*[f"{r(_roll('avg', c, n), 4)} AS {c}_{n}m_avg" for c in ("revenue", "qty") for n in (3, 6, 12, 30)]))
def _rolling_mean(spark, sf):
    made = ft.rolling_features(
        _panel(spark, sf, "revenue", "qty"), **NATION, cols=["revenue", "qty"], windows=[3, 6, 12, 30], functions=["mean"], pattern="{col}_{window}m_avg"
    )
    return round_columns(made.drop("revenue", "qty"), 4)


@query("rolling_std", _select(*[f"{r(_roll('stddev_samp', 'qty', n), 4)} AS qty_volatility_{n}" for n in (3, 6, 12)]))
def _rolling_std(spark, sf):
    made = ft.rolling_features(
        _panel(spark, sf, "qty"), **NATION, cols=["qty"], functions=["std_sample"], pattern="{col}_volatility_{window}"
    )
    return round_columns(made.drop("qty"), 4)


@query(
    "rolling_partial",
    f"""WITH {P2_DENSE_SQL} SELECT user_id, day, {r('CASE WHEN count(value_sum) OVER w >= 1 THEN avg(value_sum) OVER w END', 6)} AS value_sum_mean_3
        FROM p2d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def _rolling_partial(spark, sf):
    made = ft.rolling_features(
        user_days_dense(spark, sf), keys=["user_id"], date="day", cols=["value_sum"], windows=[3], functions=["mean"], min_periods=1
    )
    return round_columns(made.drop("value_sum"), 6)


@query("expanding_mean", _select(f"{r(f'avg(revenue) {_W}', 3)} AS revenue_exp_mean"))
def _expanding_mean(spark, sf):
    return round_columns(ft.expanding_mean(_panel(spark, sf, "revenue"), **NATION, cols=["revenue"]).drop("revenue"), 3)


@query(
    "pct_change",
    f"""WITH {P2_DENSE_SQL}, f AS (SELECT user_id, day, last_value(value_sum IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM p2d)
        SELECT user_id, day, {r('x / NULLIF(lag(x, 1) OVER w, 0) - 1', 6)} AS value_sum_pct_1, {r('x / NULLIF(lag(x, 12) OVER w, 0) - 1', 6)} AS value_sum_pct_12
        FROM f WINDOW w AS (PARTITION BY user_id ORDER BY day)""",
)
def _pct_change(spark, sf):
    made = ft.change_features(user_days_dense(spark, sf), keys=["user_id"], date="day", cols=["value_sum"])
    return round_columns(made.drop("value_sum"), 6)


@query(
    "difference",
    _select(
        f"revenue - {_lag('revenue', 1)} AS revenue_diff_1",
        f"revenue - {_lag('revenue', 12)} AS revenue_diff_12",
        f"revenue - {_lag('revenue', 12)} - ({_lag('revenue', 1)} - {_lag('revenue', 13)}) AS diffed",
    ),
)
def _difference(spark, sf):
    df = _panel(spark, sf, "revenue")
    for k in (1, 12):
        df = ft.difference(df, **NATION, col="revenue", lag=k)
    return ft.difference_order(df, **NATION, col="revenue", order=1, seasonal=12).drop("revenue")


@query(
    "trend_features",
    f"""WITH {P1_SQL}, t AS (SELECT n_name, month, CAST(row_number() {_W} - 1 AS INT) AS trend FROM p1)
        SELECT n_name, month, trend, CAST(trend AS BIGINT) * trend AS trend_squared FROM t""",
)
def _trend_features(spark, sf):
    return ft.trend_features(_panel(spark, sf), **NATION)


_CYC = [f"{r('sin(2 * pi() * month(month) / 12)', 6)} AS month_sin", f"{r('cos(2 * pi() * month(month) / 12)', 6)} AS month_cos"]


@query(
    "ts_feature_bundle",
    _select(
        *[f"{_lag('revenue', k)} AS revenue_lag_{k}" for k in (1, 3, 6, 12)],
        *[f"{r(_roll('avg', 'revenue', n, 1), 3)} AS revenue_rolling_mean_{n}" for n in (3, 6, 12)],
        *[f"{r(_roll('stddev_samp', 'revenue', n, 2), 3)} AS revenue_rolling_std_{n}" for n in (3, 6, 12)],
        *[f"{_lag('qty', k)} AS qty_lag_{k}" for k in (1, 3)],
        f"{r(_roll('avg', 'qty', 3, 1), 3)} AS qty_rolling_mean_3",
        *_CYC,
        "CAST(quarter(month) AS INT) AS quarter",
        "CAST(year(month) AS INT) AS year",
        f"{r('revenue / NULLIF(' + _lag('revenue', 12) + ', 0) - 1', 6)} AS revenue_yoy_change",
    ),
)
def _ts_feature_bundle(spark, sf):
    made = ft.target_bundle(_panel(spark, sf, "revenue", "qty"), **NATION, target="revenue", indicators=["qty"]).drop("revenue", "qty")
    made = round_columns(made, 6, "month_sin", "month_cos", "revenue_yoy_change")
    return round_columns(made, 3, *[c for c in made.columns if "_rolling_" in c])


@query(
    "ensemble_feature_bundle",
    f"""WITH {P1_SQL}, b AS (SELECT n_name, month, revenue, {', '.join(f"{_lag('revenue', k)} AS revenue_lag_{k}" for k in (1, 2, 3))},
        {', '.join(f"{r(_roll('avg', 'revenue', n), 3)} AS revenue_ma_{n}" for n in (3, 6, 12))},
        {r('revenue / NULLIF(' + _lag('revenue', 1) + ', 0) - 1', 6)} AS revenue_mom_change, revenue - {_lag('revenue', 1)} AS revenue_abs_change,
        {r(f'avg(revenue) {_W}', 3)} AS revenue_exp_mean, CAST(row_number() {_W} - 1 AS INT) AS trend,
        CAST((row_number() {_W} - 1) * (row_number() {_W} - 1) AS BIGINT) AS trend_squared FROM p1)
        SELECT * FROM b WHERE revenue_ma_12 IS NOT NULL AND revenue_mom_change IS NOT NULL""",
)
def _ensemble_feature_bundle(spark, sf):
    made = ft.ensemble_bundle(_panel(spark, sf, "revenue"), **NATION, target="revenue")
    made = round_columns(made, 6, "revenue_mom_change")
    return round_columns(made, 3, "revenue_exp_mean", *[f"revenue_ma_{n}" for n in (3, 6, 12)])


_MACRO = ("revenue", "qty", "avg_disc")
_MACRO_ITEMS = (
    [f"{_lag(c, k)} AS {c}_lag_{k}" for c in _MACRO for k in (1, 3, 6, 12)]
    + [f"{r(_roll('avg', c, n), 3)} AS {c}_rolling_{n}" for c in _MACRO for n in (3, 6, 12)]
    + [f"{r(_roll('stddev_samp', c, n), 3)} AS {c}_volatility_{n}" for c in ("revenue", "qty") for n in (3, 6, 12)]
    + [f"{r(f'({c} / NULLIF({_lag(c, 1)}, 0) - 1) * 100', 4)} AS {c}_pct_change" for c in _MACRO]
    + [f"{r(f'{c} - {_lag(c, 1)}', 6)} AS {c}_diff" for c in _MACRO]
    + ["CAST(month(month) AS INT) AS month_of_year", "CAST(quarter(month) AS INT) AS quarter", *_CYC]
    + [f"{r('revenue / NULLIF(qty, 0)', 4)} AS unit_revenue", "revenue + qty AS volume_sum", "qty * 10 AS qty_scaled"]
)


@query(
    "macro_feature_bundle",
    f"""WITH {P1_SQL}, b AS (SELECT n_name, month, revenue, qty, avg_disc, {', '.join(_MACRO_ITEMS)} FROM p1)
        SELECT * FROM b WHERE avg_disc_rolling_12 IS NOT NULL AND avg_disc_lag_12 IS NOT NULL
          AND revenue_pct_change IS NOT NULL AND qty_pct_change IS NOT NULL AND avg_disc_pct_change IS NOT NULL AND unit_revenue IS NOT NULL""",
)
def _macro_feature_bundle(spark, sf):
    # ``month`` is the feature's name in the bundle, so the date moves aside.
    df = _panel(spark, sf, *_MACRO).withColumnRenamed("month", "date")
    made = ft.macro_bundle(
        df,
        keys=["n_name"],
        date="date",
        cols=_MACRO,
        volatile=["revenue", "qty"],
        ratios={"unit_revenue": ("revenue", "qty")},
        sums={"volume_sum": ("revenue", "qty")},
        scaled={"qty_scaled": ("qty", 10.0)},
    )
    made = made.withColumnRenamed("month", "month_of_year").withColumnRenamed("date", "month")
    made = round_columns(made, 3, *[c for c in made.columns if "_rolling_" in c or "_volatility_" in c])
    made = round_columns(made, 4, "unit_revenue", *[f"{c}_pct_change" for c in _MACRO])
    return round_columns(made, 6, "month_sin", "month_cos", *[f"{c}_diff" for c in _MACRO])
