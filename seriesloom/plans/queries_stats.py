"""Aggregations, data quality and diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seriesloom.functions.expressions import round_columns
from seriesloom.operators import quality as dq
from seriesloom.operators import series as sr
from seriesloom.operators import stats as st
from seriesloom.operators.features import lag_features, rolling_features
from seriesloom.plans.registry import query, r
from seriesloom.plans.tables import (
    EVENT_TYPES,
    P1_SQL,
    P2_DENSE_SQL,
    P2_SQL,
    P2_WIDE_SQL,
    nation_panel,
    table,
    user_days,
    user_days_dense,
    user_days_wide,
)

NATION = {"keys": ["n_name"], "date": "month"}
MONEY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# ---------------------------------------------------------------- aggregations

_MONTHLY = "m AS (SELECT n_name, CAST(month(month) AS INT) AS month_of_year, avg(revenue) AS mean_value FROM p1 GROUP BY 1, 2)"


@query(
    "seasonal_profile",
    f"""WITH {P1_SQL}, {_MONTHLY}, ranked AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY mean_value DESC, month_of_year) AS top,
          row_number() OVER (PARTITION BY n_name ORDER BY mean_value, month_of_year) AS low FROM m)
        SELECT n_name, month_of_year, {r('mean_value', 3)} AS mean_value, max(CASE WHEN top = 1 THEN month_of_year END) OVER (PARTITION BY n_name) AS peak_month,
          max(CASE WHEN low = 1 THEN month_of_year END) OVER (PARTITION BY n_name) AS trough_month FROM ranked""",
)
def _seasonal_profile(spark, sf):
    return round_columns(st.seasonal_profile(nation_panel(spark, sf), **NATION, col="revenue"), 3)


@query(
    "seasonality_factors",
    f"WITH {P1_SQL}, {_MONTHLY} SELECT n_name, month_of_year, {r('mean_value / avg(mean_value) OVER (PARTITION BY n_name)', 6)} AS factor FROM m",
)
def _seasonality_factors(spark, sf):
    return round_columns(st.seasonality_factors(nation_panel(spark, sf), **NATION, col="revenue"), 6)


@query(
    "describe_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, count({c}) AS n, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, min({c}) AS min,
            {r(f'quantile_cont({c}, 0.25)', 4)} AS q25, {r(f'quantile_cont({c}, 0.5)', 4)} AS q50, {r(f'quantile_cont({c}, 0.75)', 4)} AS q75,
            max({c}) AS max, {r(f'stddev_samp({c}) / avg({c})', 6)} AS cv FROM lineitem"""
        for c in MONEY
    ),
)
def _describe_stats(spark, sf):
    out = st.describe(table(spark, sf, "lineitem").select(*MONEY), MONEY)
    return round_columns(round_columns(out, 6, "cv"), 4, "mean", "std", "q25", "q50", "q75")


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {'1.0::DOUBLE' if a == b else r(f'corr({a}, {b})', 6)} AS corr FROM lineitem"
        + (" GROUP BY ()" if a == b else "")
        for a in MONEY
        for b in MONEY
    ),
)
def _correlation_matrix(spark, sf):
    return round_columns(st.correlation_matrix(table(spark, sf, "lineitem"), MONEY), 6)


@query(
    "target_correlation",
    f"WITH {P1_SQL} " + " UNION ALL ".join(f"SELECT n_name, '{c}' AS metric, {r(f'corr({c}, revenue)', 6)} AS corr FROM p1 GROUP BY 1" for c in ("qty", "avg_disc")),
)
def _target_correlation(spark, sf):
    return round_columns(st.target_correlation(nation_panel(spark, sf), "revenue", ["qty", "avg_disc"], keys=["n_name"]), 6)


@query(
    "lag_correlation",
    f"""WITH {P1_SQL}, l AS (SELECT n_name, revenue, lag.lag, lag(qty, CAST(lag.lag AS INT)) OVER (PARTITION BY n_name, lag.lag ORDER BY month) AS d FROM p1, range(0, 13) lag(lag)),
        c AS (SELECT n_name, CAST(lag AS INT) AS lag, corr(revenue, d) AS corr FROM l GROUP BY 1, 2)
        SELECT n_name, lag, {r('corr', 6)} AS corr, first_value(lag) OVER (PARTITION BY n_name ORDER BY abs(corr) DESC, lag) AS best_lag FROM c""",
)
def _lag_correlation(spark, sf):
    out = st.lag_correlation(nation_panel(spark, sf), **NATION, target="revenue", driver="qty", max_lag=12)
    return round_columns(out, 6)


@query(
    "ols_gram",
    f"""WITH {P1_SQL}, x AS (SELECT n_name, qty, avg_disc, ln(revenue) AS y FROM p1)
        SELECT n_name, count(*) AS n, {r('sum(qty)', 2)} AS s_qty, {r('sum(avg_disc)', 6)} AS s_avg_disc, {r('sum(y)', 4)} AS s_y,
          {r('sum(qty * qty)', 2)} AS g_qty_qty, {r('sum(qty * avg_disc)', 4)} AS g_qty_avg_disc, {r('sum(qty * y)', 3)} AS g_qty_y,
          {r('sum(avg_disc * avg_disc)', 6)} AS g_avg_disc_avg_disc, {r('sum(avg_disc * y)', 6)} AS g_avg_disc_y, {r('sum(y * y)', 4)} AS g_y_y
        FROM x GROUP BY 1""",
)
def _ols_gram(spark, sf):
    panel = nation_panel(spark, sf).select("n_name", "qty", "avg_disc", F.ln("revenue").alias("y"))
    out = st.gram(panel, ["qty", "avg_disc"], "y", keys=["n_name"])
    out = round_columns(out, 2, "s_qty", "g_qty_qty")
    out = round_columns(out, 3, "g_qty_y")
    out = round_columns(out, 6, "s_avg_disc", "g_avg_disc_avg_disc", "g_avg_disc_y")
    return round_columns(out, 4, "s_y", "g_qty_avg_disc", "g_y_y")


@query(
    "duplicate_rows",
    """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates, CAST(sum(n) AS BIGINT) AS n_rows
       FROM (SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)""",
)
def _duplicate_rows(spark, sf):
    return dq.duplicate_rows(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


# ---------------------------------------------------------------- quality

_QUALITY = {
    "orders": ("orders", "o_orderdate", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], ["o_orderkey", "o_custkey", "o_totalprice"]),
    "events": ("events", "ts", ["event_id", "ts", "user_id", "event_type", "value", "props"], ["event_id", "user_id", "value"]),
    "user_days": ("p2w", "day", ["user_id", "day", *EVENT_TYPES], ["user_id", *EVENT_TYPES]),
}


def _quality_sql(name: str) -> str:
    source, date, cols, numeric = _QUALITY[name]
    nulls = [f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols]
    z = " + ".join(f"count(*) FILTER (WHERE abs({c} - m_{c}) > 3 * s_{c})" for c in numeric)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in numeric)
    return f"""SELECT '{name}' AS file_name, count(*) AS row_count, CAST({len(cols)} AS BIGINT) AS column_count, '{date}' AS date_column,
      CAST({' + '.join(f'CAST({n} > 0 AS INT)' for n in nulls)} AS BIGINT) AS missing_columns, {' + '.join(nulls)} AS missing_values,
      {r(f"({' + '.join(nulls)}) * 100.0::DOUBLE / (count(*) * {len(cols)})", 2)} AS missing_pct,
      {z} AS outlier_count, {r(f'({z}) * 100.0::DOUBLE / (count(*) * {len(numeric)})', 2)} AS outlier_pct
      FROM {source}, (SELECT {stats} FROM {source}) s"""


@query(
    "quality_report",
    f"WITH {P2_WIDE_SQL}, q AS ({' UNION ALL '.join(_quality_sql(n) for n in _QUALITY)}) SELECT *, missing_pct > 0 OR outlier_pct > 1 AS needs_cleaning FROM q",
)
def _quality_report(spark, sf):
    sources = {"orders": table(spark, sf, "orders"), "events": table(spark, sf, "events"), "user_days": user_days_wide(spark, sf)}
    return dq.quality_report(sources, dates={n: q[1] for n, q in _QUALITY.items()})


@query(
    "missingness",
    f"WITH {P2_WIDE_SQL}, m AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, {r(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*)', 4)} AS pct_missing FROM p2w"
        for c in ("user_id", "day", *EVENT_TYPES)
    )
    + ") SELECT * FROM m WHERE n_missing > 0",
)
def _missingness(spark, sf):
    return round_columns(dq.missingness(user_days_wide(spark, sf)), 4)


@query(
    "outlier_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, count(*) FILTER (WHERE abs({c} - m) > 3 * s) AS n_outliers, {r(f'count(*) FILTER (WHERE abs({c} - m) > 3 * s) * 100.0::DOUBLE / count(*)', 4)} AS pct_outliers
            FROM events, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM events) t"""
        for c in ("value", "user_id")
    ),
)
def _outlier_summary(spark, sf):
    return round_columns(dq.outlier_summary(table(spark, sf, "events"), ["value", "user_id"]), 4)


@query(
    "jump_summary",
    f"""WITH {P2_DENSE_SQL}, f AS (SELECT user_id, day, last_value(value_sum IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM p2d),
        c AS (SELECT user_id, abs(x / NULLIF(lag(x) OVER (PARTITION BY user_id ORDER BY day), 0) - 1) AS p FROM f)
        SELECT user_id, 'value_sum' AS metric, count(*) FILTER (WHERE p > 0.5) AS n_jumps, {r('max(p)', 6)} AS largest FROM c GROUP BY 1""",
)
def _jump_summary(spark, sf):
    return round_columns(dq.jump_summary(user_days_dense(spark, sf), keys=["user_id"], date="day", cols=["value_sum"]), 6)


@query(
    "high_variability",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, {r(f'abs(stddev_samp({c}) / avg({c}))', 6)} AS cv FROM lineitem" for c in MONEY
    )
    + f" UNION ALL SELECT 'gain', {r('abs(stddev_samp(l_tax - l_discount) / avg(l_tax - l_discount))', 6)} FROM lineitem) WHERE cv > 1",
)
def _high_variability(spark, sf):
    lines = table(spark, sf, "lineitem").select(*MONEY, (F.col("l_tax") - F.col("l_discount")).alias("gain"))
    return round_columns(st.high_variability(lines, [*MONEY, "gain"]), 6)


@query(
    "coverage_gaps",
    f"""WITH {P2_SQL}, s AS (SELECT user_id, day, CAST(day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS INT) AS step FROM p2),
        m AS (SELECT user_id, min(day) AS "start", max(day) AS "end", CAST(max(day) - min(day) AS INT) AS duration_days, quantile_cont(step, 0.5)::DOUBLE AS median_step FROM s GROUP BY 1)
        SELECT m.*, (SELECT count(*) FROM s WHERE s.user_id = m.user_id AND step > 2 * median_step) AS n_gaps FROM m""",
)
def _coverage_gaps(spark, sf):
    return dq.coverage_gaps(user_days(spark, sf), keys=["user_id"], date="day")


@query(
    "date_consistency",
    """WITH s AS (SELECT 'orders' AS source, CAST(min(o_orderdate) AS DATE) AS "start", CAST(max(o_orderdate) AS DATE) AS "end" FROM orders
         UNION ALL SELECT 'lineitem', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE) FROM lineitem
         UNION ALL SELECT 'events', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) FROM events),
       d AS (SELECT *, CAST("start" - (SELECT min("start") FROM s) AS INT) AS starts_after_days, CAST((SELECT max("end") FROM s) - "end" AS INT) AS ends_before_days FROM s)
       SELECT *, starts_after_days > 30 OR ends_before_days > 30 AS inconsistent FROM d""",
)
def _date_consistency(spark, sf):
    dates = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    return dq.date_consistency({n: table(spark, sf, n) for n in dates}, dates=dates)


# ---------------------------------------------------------------- series analysis


@query(
    "seasonal_decompose",
    f"""WITH {P1_SQL}, t AS (SELECT n_name, month, revenue, (row_number() OVER w - 1) % 12 AS phase,
          CASE WHEN count(revenue) OVER c = 11 THEN (sum(revenue) OVER c + (lag(revenue, 6) OVER w + lead(revenue, 6) OVER w) / 2) / 12 END AS trend
          FROM p1 WINDOW w AS (PARTITION BY n_name ORDER BY month), c AS (PARTITION BY n_name ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
        p AS (SELECT n_name, phase, avg(revenue - trend) AS m FROM t GROUP BY 1, 2),
        s AS (SELECT n_name, phase, m - avg(m) OVER (PARTITION BY n_name) AS seasonal FROM p)
        SELECT n_name, month, revenue, {r('trend', 3)} AS trend, {r('seasonal', 3)} AS seasonal, {r('revenue - trend - seasonal', 3)} AS resid FROM t JOIN s USING (n_name, phase)""",
)
def _seasonal_decompose(spark, sf):
    panel = nation_panel(spark, sf).select("n_name", "month", "revenue")
    return round_columns(sr.seasonal_decompose(panel, **NATION, col="revenue"), 3, "trend", "seasonal", "resid")


def _acf_sql(source: str, col: str, lags: int) -> str:
    return f"""d AS (SELECT n_name, month, {col} - avg({col}) OVER (PARTITION BY n_name) AS d FROM {source} WHERE {col} IS NOT NULL),
        l AS (SELECT n_name, k.k AS k, d, lag(d, CAST(k.k AS INT)) OVER (PARTITION BY n_name, k.k ORDER BY month) AS dk FROM d, range(0, {lags + 1}) k(k)),
        acf AS (SELECT n_name, CAST(k AS INT) AS lag, count(*) AS n, sum(d * dk) / NULLIF(sum(d * d), 0) AS acf FROM l GROUP BY 1, 2)"""


@query("acf", f"WITH {P1_SQL}, {_acf_sql('p1', 'revenue', 12)} SELECT n_name, lag, n, {r('acf', 6)} AS acf FROM acf")
def _acf(spark, sf):
    return round_columns(st.acf(nation_panel(spark, sf), **NATION, col="revenue", lags=12), 6)


@query("pacf")
def _pacf(spark, sf):
    return round_columns(st.pacf(nation_panel(spark, sf), **NATION, col="revenue", lags=12), 6)


# ---------------------------------------------------------------- diagnostics

# Residuals of the three-month moving-average forecast.
_RESIDUAL_SQL = f"""{P1_SQL}, e AS (SELECT n_name, month, revenue - CASE WHEN count(revenue) OVER w = 3 THEN avg(revenue) OVER w END AS e
    FROM p1 WINDOW w AS (PARTITION BY n_name ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""


def _residuals(spark, sf):
    panel = nation_panel(spark, sf).select("n_name", "month", "revenue")
    means = rolling_features(panel, **NATION, cols=["revenue"], windows=[3], functions=["mean"])
    lagged = lag_features(means, **NATION, cols=["revenue_mean_3"], lags=[1])
    return lagged.select("n_name", "month", (F.col("revenue") - F.col("revenue_mean_3_lag_1")).alias("e"))




def _tail_one(q: str) -> str:
    """SQL of the chi-square tail at one degree of freedom: the error function by its series."""
    half = f"least({q} / 2, 40.0)"
    term = f"exp((2 * n + 1) * ln({half}) / 2 + 2 * n * ln(2.0) + lgamma(n + 1.0) - lgamma(2.0 * n + 2) - {half})"
    return f"CASE WHEN {q} > 0 THEN greatest(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 400), lambda n: {term})), 0.0) ELSE 1.0 END"


def _tail_even(q: str, df: int) -> str:
    terms = " + ".join(f"pow({q} / 2, {j}) / {math.factorial(j)}.0" for j in range(df // 2))
    return f"exp(-{q} / 2) * ({terms})"


def _vif_sql() -> str:
    x, y, z = "l_quantity", "l_discount", "l_tax"
    names = {x: "a", y: "b", z: "c"}
    sums = ", ".join(f"sum({p} * {q}) AS {names[p]}{names[q]}" for p in names for q in names if names[p] <= names[q])
    det = "(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac))"
    minors = {x: "aa * (bb * cc - bc * bc)", y: "bb * (aa * cc - ac * ac)", z: "cc * (aa * bb - ab * ab)"}
    return f"WITH g AS (SELECT {sums} FROM lineitem) " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {r(f'{m} / {det}', 5)} AS vif FROM g" for f, m in minors.items()
    )


@query("vif", _vif_sql())
def _vif(spark, sf):
    return round_columns(st.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), 5)


@query(
    "breusch_pagan",
    f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
        e AS (SELECT l_quantity AS x, pow(l_extendedprice - a - b * l_quantity, 2) AS e2 FROM lineitem, f),
        l AS (SELECT count(*) AS n, count(*) * pow(corr(e2, x), 2) AS lm FROM e)
        SELECT n, {r('lm', 3)} AS lm, {r(_tail_one('lm'), 6)} AS p_value, lm > 3.841458820694124 AS heteroskedastic FROM l""",
)
def _breusch_pagan(spark, sf):
    out = st.breusch_pagan(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return round_columns(round_columns(out, 3, "lm"), 6, "p_value")


@query(
    "durbin_watson",
    f"""WITH {_RESIDUAL_SQL}, s AS (SELECT n_name, e, e - lag(e) OVER (PARTITION BY n_name ORDER BY month) AS de FROM e),
        w AS (SELECT n_name, sum(de * de) / NULLIF(sum(e * e), 0) AS dw FROM s GROUP BY 1)
        SELECT n_name, {r('dw', 6)} AS dw, CASE WHEN dw < 1.5 THEN 'positive' WHEN dw > 2.5 THEN 'negative' ELSE 'none' END AS autocorrelation FROM w""",
)
def _durbin_watson(spark, sf):
    return round_columns(st.durbin_watson(_residuals(spark, sf), **NATION, residual="e"), 6)


@query(
    "ljung_box",
    f"""WITH {_RESIDUAL_SQL}, {_acf_sql('e', 'e', 10)}, q AS (SELECT n_name, h, max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)) AS q
          FROM acf JOIN (VALUES (1), (10)) v(h) ON lag BETWEEN 1 AND h AND n > lag GROUP BY 1, 2)
        , t AS (SELECT *, CASE h WHEN 1 THEN {_tail_one('q')} ELSE {_tail_even('q', 10)} END AS p FROM q)
        SELECT n_name, CAST(h AS INT) AS horizon, {r('q', 5)} AS q, {r('p', 6)} AS p_value, p < 0.05 AS correlated FROM t""",
)
def _ljung_box(spark, sf):
    out = st.ljung_box(_residuals(spark, sf), **NATION, col="e", lags=(1, 10))
    return round_columns(round_columns(out, 5, "q"), 6, "p_value")


@query(
    "jarque_bera",
    f"""WITH {_RESIDUAL_SQL}, c AS (SELECT n_name, e - avg(e) OVER (PARTITION BY n_name) AS d FROM e WHERE e IS NOT NULL),
        m AS (SELECT n_name, count(*) AS n, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM c GROUP BY 1),
        s AS (SELECT n_name, n, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM m)
        SELECT n_name, n, {r('skew', 6)} AS skew, {r('kurt', 6)} AS kurt, {r('n / 6 * (skew * skew + kurt * kurt / 4)', 5)} AS jb,
          {r('exp(-(n / 6 * (skew * skew + kurt * kurt / 4)) / 2)', 6)} AS p_value FROM s""",
)
def _jarque_bera(spark, sf):
    out = st.jarque_bera(_residuals(spark, sf), keys=["n_name"], col="e")
    return round_columns(round_columns(out, 6, "skew", "kurt", "p_value"), 5, "jb")


@query("adf")
def _adf(spark, sf):
    return round_columns(st.adf(nation_panel(spark, sf), **NATION, col="revenue", max_lag=4), 5)


@query(
    "residual_table",
    f"""WITH {_RESIDUAL_SQL}, b AS (SELECT min(e) AS lo, max(e) AS hi FROM e),
        x AS (SELECT least(floor(coalesce((e - lo) / NULLIF((hi - lo) / 20, 0), 0)), 19) AS bin, lo, (hi - lo) / 20 AS width FROM e, b WHERE e IS NOT NULL)
        SELECT CAST(bin AS INT) AS bin, count(*) AS n, {r('max(lo) + bin * max(width)', 3)} AS lo, {r('max(lo) + (bin + 1) * max(width)', 3)} AS hi FROM x GROUP BY bin""",
)
def _residual_table(spark, sf):
    return round_columns(st.residual_histogram(_residuals(spark, sf), "e", bins=20), 3)


_QQ = [(i + 1) / 20 for i in range(19)]


@query(
    "normal_quantiles",
    f"WITH {_RESIDUAL_SQL} " + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, {r(f'quantile_cont(e, {p})', 3)} AS sample FROM e" for p in _QQ),
)
def _normal_quantiles(spark, sf):
    return round_columns(st.normal_quantile_pairs(_residuals(spark, sf), "e").drop("theoretical"), 3, "sample")
