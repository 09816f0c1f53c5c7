"""The flagship preparation and the composed reports."""

from __future__ import annotations

from seriesloom.functions.expressions import round_columns
from seriesloom.operators import reports
from seriesloom.plans.queries_joins import _DAYS, _POS, _interp_sql
from seriesloom.plans.registry import query, r
from seriesloom.plans.tables import P1_SHIP_SQL, P1_SQL, nation_panel, nation_ship_qty

NATION = {"keys": ["n_name"], "date": "month"}
VALUE = {"revenue": "revenue", "ship_qty": "ship_qty"}


def _sources(spark, sf):
    return {"revenue": nation_panel(spark, sf), "ship_qty": nation_ship_qty(spark, sf)}


def _clip_sql(c: str) -> str:
    s = {k: f"{k} OVER k" for k in (f"avg({c})", f"stddev_pop({c})", f"min({c})", f"max({c})")}
    q = {p: f"quantile_cont({c}, {p}) OVER k" for p in (0.01, 0.25, 0.75, 0.99)}
    mean, sd, lo, hi = s.values()
    spread = f"1.5 * ({q[0.75]} - {q[0.25]})"
    flagged = f"greatest({hi} - {mean}, {mean} - {lo}) > 3 * {sd} OR {lo} < {q[0.25]} - {spread} OR {hi} > {q[0.75]} + {spread}"
    return f"CASE WHEN {flagged} THEN least(greatest({c}, {q[0.01]}), {q[0.99]}) ELSE {c} END AS {c}"


def _treated_sql(name: str, source: str, c: str) -> str:
    """Clip, then the mean: a gap of the only column has no neighbours."""
    return f"""{name}c AS (SELECT n_name, month, {_clip_sql(c)} FROM {source} WINDOW k AS (PARTITION BY n_name)),
    {name} AS (SELECT n_name, month, coalesce({c}, avg({c}) OVER (PARTITION BY n_name)) AS {c} FROM {name}c)"""


_ALIGNED = f"""{P1_SQL}, {P1_SHIP_SQL}, {_treated_sql('t1', 'p1', 'revenue')}, {_treated_sql('t2', 'ship', 'ship_qty')},
    b AS (SELECT greatest((SELECT min(month) FROM t1), (SELECT min(month) FROM t2)) AS lo, least((SELECT max(month) FROM t1), (SELECT max(month) FROM t2)) AS hi),
    names AS (SELECT n_name FROM p1 UNION SELECT n_name FROM t2),
    spine AS (SELECT n_name, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM names, b),
    g AS (SELECT s.n_name, s.month, t1.revenue, t2.ship_qty FROM spine s LEFT JOIN t1 USING (n_name, month) LEFT JOIN t2 USING (n_name, month)),
    {_interp_sql('i1', 'g', 'n_name', 'month', 'revenue', _DAYS.format('month'))}, i1c AS (SELECT n_name, month, revenue, ship_qty FROM i1),
    {_interp_sql('i2', 'i1c', 'n_name', 'month', 'ship_qty', _DAYS.format('month'))},
    al AS (SELECT n_name, month, coalesce(revenue, first_value(revenue IGNORE NULLS) OVER w) AS revenue, coalesce(ship_qty, first_value(ship_qty IGNORE NULLS) OVER w) AS ship_qty
           FROM i2 WINDOW w AS (PARTITION BY n_name ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _mean(n: int) -> str:
    f = f"OVER (PARTITION BY n_name ORDER BY month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"{r(f'CASE WHEN count(log_revenue) {f} >= {n} THEN avg(log_revenue) {f} END', 6)} AS log_revenue_mean_{n}"


@query(
    "prepare_panel",
    f"""WITH {_ALIGNED}, lg AS (SELECT *, CASE WHEN revenue > 0 THEN ln(revenue) END AS log_revenue FROM al)
        SELECT n_name, month, {r('revenue', 3)} AS revenue, {r('ship_qty', 3)} AS ship_qty, {r('log_revenue', 6)} AS log_revenue,
          {', '.join(f"{r(f'lag(log_revenue, {k}) OVER (PARTITION BY n_name ORDER BY month)', 6)} AS log_revenue_lag_{k}" for k in (1, 2, 3))}, {_mean(3)}, {_mean(12)} FROM lg""",
)
def _prepare_panel(spark, sf):
    out = reports.prepare_panel(_sources(spark, sf), **NATION, value=VALUE, target="revenue")
    out = round_columns(out, 6, *[c for c in out.columns if c.startswith("log_")])
    return round_columns(out, 3, "revenue", "ship_qty")


def _capped(c: str) -> str:
    mean, sd = f"avg({c}) OVER k", f"stddev_samp({c}) OVER k"
    return f"{r(f'CASE WHEN {sd} IS NULL THEN {c} ELSE least(greatest({c}, {mean} - 3 * {sd}), {mean} + 3 * {sd}) END', 3)} AS {c}"


@query(
    "complete_dataset",
    f"""WITH {P1_SQL}, {P1_SHIP_SQL}, g AS (SELECT n_name, month, revenue, ship_qty FROM p1 FULL JOIN ship USING (n_name, month)),
        {_interp_sql('i1', 'g', 'n_name', 'month', 'revenue', _POS.format('n_name', 'month'))}, i1c AS (SELECT n_name, month, revenue, ship_qty FROM i1),
        {_interp_sql('i2', 'i1c', 'n_name', 'month', 'ship_qty', _POS.format('n_name', 'month'))},
        f AS (SELECT n_name, month, coalesce(revenue, first_value(revenue IGNORE NULLS) OVER w) AS revenue, coalesce(ship_qty, first_value(ship_qty IGNORE NULLS) OVER w) AS ship_qty
              FROM i2 WINDOW w AS (PARTITION BY n_name ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT n_name, month, {_capped('revenue')}, {_capped('ship_qty')} FROM f WINDOW k AS (PARTITION BY n_name)""",
)
def _complete_dataset(spark, sf):
    return round_columns(reports.complete_dataset(_sources(spark, sf), **NATION, value=VALUE), 3)


def _lead_sql(d: str) -> str:
    return f"""l_{d} AS (SELECT n_name, k.k AS k, revenue, lag({d}, CAST(k.k AS INT)) OVER (PARTITION BY n_name, k.k ORDER BY month) AS d FROM p1, range(0, 13) k(k)),
      c_{d} AS (SELECT n_name, k, corr(revenue, d) AS c FROM l_{d} GROUP BY 1, 2), b_{d} AS (SELECT n_name, k AS value FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY abs(c) DESC, k) AS rn FROM c_{d}) WHERE rn = 1)"""


@query(
    "insight_report",
    f"""WITH {P1_SQL}, m AS (SELECT n_name, month(month) AS m, avg(revenue) AS v FROM p1 GROUP BY 1, 2),
        e AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY v DESC, m) AS top, row_number() OVER (PARTITION BY n_name ORDER BY v, m) AS low FROM m),
        {_lead_sql('qty')}, {_lead_sql('avg_disc')}, c AS (SELECT n_name, corr(revenue, qty) AS ya, corr(revenue, avg_disc) AS yb, corr(qty, avg_disc) AS ab FROM p1 GROUP BY 1),
        w AS (SELECT n_name, ya, yb, abs((ya - ab * yb) / (1 - ab * ab)) AS a, abs((yb - ab * ya) / (1 - ab * ab)) AS b FROM c)
        SELECT n_name, 'peak_month' AS insight, m::DOUBLE AS value FROM e WHERE top = 1
        UNION ALL SELECT n_name, 'trough_month', m::DOUBLE FROM e WHERE low = 1
        UNION ALL SELECT n_name, 'corr_qty', {r('ya', 6)} FROM w UNION ALL SELECT n_name, 'corr_avg_disc', {r('yb', 6)} FROM w
        UNION ALL SELECT n_name, 'best_lag_qty', value::DOUBLE FROM b_qty UNION ALL SELECT n_name, 'best_lag_avg_disc', value::DOUBLE FROM b_avg_disc
        UNION ALL SELECT n_name, 'importance_qty', {r('a / (a + b)', 6)} FROM w UNION ALL SELECT n_name, 'importance_avg_disc', {r('b / (a + b)', 6)} FROM w""",
)
def _insight_report(spark, sf):
    return round_columns(reports.insight_report(nation_panel(spark, sf), **NATION, target="revenue", drivers=("qty", "avg_disc")), 6)
