"""Joins, resampling, alignment and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.expressions import round_columns
from seriesloom.operators import calendar as cal
from seriesloom.operators import impute, panel
from seriesloom.operators.asof import asof_join, last_known_at_period_end
from seriesloom.operators.neighbours import fill_knn_blocks
from seriesloom.plans.registry import query, r
from seriesloom.plans.tables import (
    EVENT_TYPES,
    P1_SHIP_SQL,
    P1_SQL,
    P2_DENSE_SQL,
    P2_SQL,
    P2_WIDE_SQL,
    nation_panel,
    nation_ship_qty,
    table,
    user_days,
    user_days_dense,
    user_days_wide,
)
from seriesloom.session import settled

NATION = {"keys": ["n_name"], "date": "month"}
USER = {"keys": ["user_id"], "date": "day"}

# ---------------------------------------------------------------- merges


@query("outer_merge", f"WITH {P1_SQL}, {P1_SHIP_SQL} SELECT n_name, month, revenue, ship_qty FROM p1 FULL JOIN ship USING (n_name, month)")
def _outer_merge(spark, sf):
    revenue = nation_panel(spark, sf).select("n_name", "month", "revenue")
    return panel.outer_merge(revenue, nation_ship_qty(spark, sf), ["n_name", "month"])


@query("outer_merge_pivot", f"WITH {P1_SQL}, {P1_SHIP_SQL} SELECT n_name, month, revenue, avg_disc AS discount, ship_qty FROM p1 FULL JOIN ship USING (n_name, month)")
def _outer_merge_pivot(spark, sf):
    base = nation_panel(spark, sf)
    return panel.outer_merge_many(
        {"revenue": base, "discount": base, "ship_qty": nation_ship_qty(spark, sf)},
        on=["n_name", "month"],
        value={"revenue": "revenue", "discount": "avg_disc", "ship_qty": "ship_qty"},
    )


def _orders_of(priority: str, name: str) -> str:
    return f"{name} AS (SELECT o_custkey, o_orderkey AS {name}_order, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority = '{priority}')"


@query(
    "outer_merge_rows",
    f"""WITH {_orders_of('1-URGENT', 'urgent')}, {_orders_of('5-LOW', 'low')}, n AS (SELECT c_custkey AS o_custkey, c_name, c_mktsegment FROM customer)
        SELECT o_custkey, urgent_order, urgent.o_orderstatus AS o_orderstatus_urgent, urgent.o_totalprice AS o_totalprice_urgent,
          low_order, low.o_orderstatus AS o_orderstatus_low, low.o_totalprice AS o_totalprice_low, c_name, c_mktsegment
        FROM urgent FULL JOIN low USING (o_custkey) FULL JOIN n USING (o_custkey)""",
)
def _outer_merge_rows(spark, sf):
    orders = table(spark, sf, "orders")

    def of(priority: str, name: str):
        rows = orders.filter(F.col("o_orderpriority") == priority)
        return rows.select("o_custkey", F.col("o_orderkey").alias(f"{name}_order"), "o_orderstatus", "o_totalprice")

    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return panel.outer_merge_rows({"urgent": of("1-URGENT", "urgent"), "low": of("5-LOW", "low"), "customer": customers}, on=["o_custkey"])


@query("inner_merge", f"WITH {P1_SQL}, {P1_SHIP_SQL} SELECT n_name, month, revenue, ship_qty FROM p1 JOIN ship USING (n_name, month)")
def _inner_merge(spark, sf):
    revenue = nation_panel(spark, sf).select("n_name", "month", "revenue")
    return panel.inner_merge(revenue, nation_ship_qty(spark, sf), ["n_name", "month"])


@query(
    "suffix_merge",
    f"""WITH {P1_SQL}, {P1_SHIP_SQL} SELECT n_name, ship.month, ship_qty, revenue AS revenue_sales, avg_disc AS avg_disc_sales
        FROM ship LEFT JOIN p1 USING (n_name, month)""",
)
def _suffix_merge(spark, sf):
    sales = nation_panel(spark, sf).select("n_name", "month", "revenue", "avg_disc")
    return panel.suffix_merge(nation_ship_qty(spark, sf), {"sales": sales}, on=["n_name", "month"])


# ---------------------------------------------------------------- as-of

_ASOF_SQL = """l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
  v AS (SELECT user_id, ts, arg_max(value, event_id) AS view_value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
  b AS (SELECT l.event_id, l.user_id, l.ts, v.ts AS b_ts, v.view_value AS b_value
        FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts >= v.ts),
  f AS (SELECT l.event_id, v.ts AS f_ts, v.view_value AS f_value
        FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts <= v.ts)"""


def _asof(spark, sf, direction):
    events = table(spark, sf, "events")
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value")
    )
    return asof_join(
        purchases,
        views,
        keys=["user_id"],
        left_ts="ts",
        right_ts="view_ts",
        right_cols=["view_value"],
        tie="view_id",
        direction=direction,
    )


@query(
    "asof_nearest",
    f"""WITH {_ASOF_SQL} SELECT user_id, event_id, ts,
          CASE WHEN b_ts IS NULL OR f_ts - ts < ts - b_ts THEN f_ts ELSE b_ts END AS matched_view_ts,
          CASE WHEN b_ts IS NULL OR f_ts - ts < ts - b_ts THEN f_value ELSE b_value END AS view_value FROM b JOIN f USING (event_id)""",
)
def _asof_nearest(spark, sf):
    return _asof(spark, sf, "nearest")


@query("asof_backward", f"WITH {_ASOF_SQL} SELECT user_id, event_id, ts, b_ts AS matched_view_ts, b_value AS view_value FROM b")
def _asof_backward(spark, sf):
    return _asof(spark, sf, "backward")


# ---------------------------------------------------------------- resampling

_PRIORITY_SQL = """pd AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)"""


def _priority_days(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupBy("o_orderpriority", F.col("o_orderdate").cast("date").alias("day")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "calendar_spine",
    f"""WITH {P2_SQL} SELECT user_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
        FROM p2 GROUP BY user_id""",
)
def _calendar_spine(spark, sf):
    return cal.calendar_spine(user_days(spark, sf), **USER, step="1 day")


@query(
    "resample_month_last",
    f"""WITH {_PRIORITY_SQL} SELECT o_orderpriority, CAST(date_trunc('month', day) AS DATE) AS day, arg_max(total, day) AS total FROM pd GROUP BY 1, 2""",
)
def _resample_month_last(spark, sf):
    return panel.resample_last(_priority_days(spark, sf), keys=["o_orderpriority"], date="day", cols=["total"])


@query(
    "asof_month_end",
    f"""WITH {_PRIORITY_SQL}, m AS (SELECT o_orderpriority, CAST(date_trunc('month', day) AS DATE) AS day, arg_max(total, day) AS total FROM pd GROUP BY 1, 2)
        , g AS (SELECT o_orderpriority, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS day FROM m GROUP BY 1)
        SELECT g.o_orderpriority, g.day, last_value(m.total IGNORE NULLS) OVER (PARTITION BY g.o_orderpriority ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
        FROM g LEFT JOIN m USING (o_orderpriority, day)""",
)
def _asof_month_end(spark, sf):
    return last_known_at_period_end(_priority_days(spark, sf), keys=["o_orderpriority"], date="day", cols=["total"])


@query(
    "resample_ffill",
    f"""WITH {P2_DENSE_SQL} SELECT user_id, day, last_value(value_sum IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value_sum FROM p2d""",
)
def _resample_ffill(spark, sf):
    return panel.upsample_ffill(user_days(spark, sf), **USER, cols=["value_sum"], step="1 day")


@query("resample_cubic")
def _resample_cubic(spark, sf):
    return round_columns(panel.cubic_upsample(nation_panel(spark, sf), **NATION, value="revenue"), 4)


def _interp_sql(name: str, source: str, key: str, date: str, value: str, at: str) -> str:
    """CTE ``name`` with ``value`` interpolated linearly in ``at``."""
    return f"""{name}_at AS (SELECT *, {at} AS at_ FROM {source}),
      {name}_n AS (SELECT *,
        last_value(CASE WHEN {value} IS NOT NULL THEN at_ END IGNORE NULLS) OVER b AS pa, last_value({value} IGNORE NULLS) OVER b AS pv,
        first_value(CASE WHEN {value} IS NOT NULL THEN at_ END IGNORE NULLS) OVER f AS na, first_value({value} IGNORE NULLS) OVER f AS nv
        FROM {name}_at WINDOW b AS (PARTITION BY {key} ORDER BY {date} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                              f AS (PARTITION BY {key} ORDER BY {date} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      {name} AS (SELECT * REPLACE (CASE WHEN {value} IS NOT NULL THEN {value} WHEN nv IS NULL THEN pv
                   ELSE pv + (nv - pv) * (at_ - pa) / NULLIF(na - pa, 0) END AS {value}) FROM {name}_n)"""


_DAYS = "CAST({} - DATE '1970-01-01' AS BIGINT)"
_POS = "row_number() OVER (PARTITION BY {} ORDER BY {})"


@query(
    "align_sources",
    f"""WITH {P1_SQL}, {P1_SHIP_SQL},
        ev AS (SELECT n_name, day AS month, ship_qty FROM (SELECT n_name, CAST(month AS DATE) AS day, ship_qty FROM ship)),
        r AS (SELECT greatest((SELECT min(month) FROM p1), (SELECT min(month) FROM ev)) AS lo, least((SELECT max(month) FROM p1), (SELECT max(month) FROM ev)) AS hi),
        names AS (SELECT n_name FROM p1 UNION SELECT n_name FROM ev),
        spine AS (SELECT n_name, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM names, r),
        g AS (SELECT s.n_name, s.month, p1.revenue, CAST(ev.ship_qty AS DOUBLE) AS ship_qty FROM spine s
              LEFT JOIN p1 USING (n_name, month) LEFT JOIN ev USING (n_name, month)),
        {_interp_sql('i1', 'g', 'n_name', 'month', 'revenue', _DAYS.format('month'))},
        i1c AS (SELECT n_name, month, revenue, ship_qty FROM i1),
        {_interp_sql('i2', 'i1c', 'n_name', 'month', 'ship_qty', _DAYS.format('month'))}
        SELECT n_name, month, {r('coalesce(revenue, first_value(revenue IGNORE NULLS) OVER w)', 4)} AS revenue,
               {r('coalesce(ship_qty, first_value(ship_qty IGNORE NULLS) OVER w)', 4)} AS ship_qty FROM i2
        WINDOW w AS (PARTITION BY n_name ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def _align_sources(spark, sf):
    sources = {
        "revenue": settled(nation_panel(spark, sf).select("n_name", "month", "revenue")),
        "ship_qty": settled(nation_ship_qty(spark, sf)),
    }
    aligned = panel.align_sources(sources, **NATION, value={"revenue": "revenue", "ship_qty": "ship_qty"})
    return round_columns(aligned, 4)


# ---------------------------------------------------------------- imputation


def _dense(spark, sf):
    return user_days_dense(spark, sf)


def _fill_sql(stat: str) -> str:
    return f"""WITH {P2_DENSE_SQL}, s AS (SELECT user_id, {stat} AS fill FROM p2d GROUP BY 1)
        SELECT user_id, day, {r('coalesce(value_sum, fill)', 6)} AS value_sum FROM p2d JOIN s USING (user_id)"""


@query("impute_mean", _fill_sql("avg(value_sum)"))
def _impute_mean(spark, sf):
    return round_columns(impute.fill_mean(_dense(spark, sf), keys=["user_id"], cols=["value_sum"]), 6)


@query("impute_median", _fill_sql("quantile_cont(value_sum, 0.5)"))
def _impute_median(spark, sf):
    return round_columns(impute.fill_median(_dense(spark, sf), keys=["user_id"], cols=["value_sum"]), 6)


@query("impute_zero", f"WITH {P2_DENSE_SQL} SELECT user_id, day, coalesce(value_sum, 0) AS value_sum FROM p2d")
def _impute_zero(spark, sf):
    return impute.fill_zero(_dense(spark, sf), ["value_sum"])


_TOP_TYPE_SQL = """t AS (SELECT user_id, CAST(ts AS DATE) AS day, max(event_type) AS top_type FROM events GROUP BY 1, 2)"""


@query(
    "impute_mode",
    f"""WITH {P2_DENSE_SQL}, {_TOP_TYPE_SQL},
        d AS (SELECT p2d.user_id, p2d.day, top_type FROM p2d LEFT JOIN t USING (user_id, day)),
        c AS (SELECT user_id, top_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, top_type) AS rn
              FROM d WHERE top_type IS NOT NULL GROUP BY 1, 2)
        SELECT d.user_id, d.day, coalesce(d.top_type, c.top_type) AS top_type FROM d JOIN c ON d.user_id = c.user_id AND rn = 1""",
)
def _impute_mode(spark, sf):
    events = table(spark, sf, "events")
    days = events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max("event_type").alias("top_type"))
    dense = panel.densify(days, **USER, step="1 day")
    return impute.fill_mode(dense, keys=["user_id"], cols=["top_type"])


@query(
    "impute_ffill",
    f"""WITH {P2_WIDE_SQL}, f AS (SELECT user_id, day, last_value(purchase IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS purchase FROM p2w)
        SELECT user_id, day, coalesce(purchase, first_value(purchase IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS purchase FROM f""",
)
def _impute_ffill(spark, sf):
    wide = user_days_wide(spark, sf).select("user_id", "day", "purchase")
    return impute.fill_forward(wide, **USER, cols=["purchase"], then_back=True)


@query(
    "impute_bfill",
    f"""WITH {P2_WIDE_SQL} SELECT user_id, day, first_value(purchase IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS purchase FROM p2w""",
)
def _impute_bfill(spark, sf):
    wide = user_days_wide(spark, sf).select("user_id", "day", "purchase")
    return impute.fill_backward(wide, **USER, cols=["purchase"])


@query(
    "interpolate_linear",
    f"""WITH {P2_DENSE_SQL}, {_interp_sql('i', 'p2d', 'user_id', 'day', 'value_sum', _POS.format('user_id', 'day'))}
        SELECT user_id, day, {r('value_sum', 6)} AS value_sum FROM i""",
)
def _interpolate_linear(spark, sf):
    return round_columns(impute.interpolate(_dense(spark, sf), **USER, cols=["value_sum"]), 6)


@query(
    "interpolate_time",
    f"""WITH {P2_WIDE_SQL}, s AS (SELECT user_id, day, purchase FROM p2w),
        {_interp_sql('i', 's', 'user_id', 'day', 'purchase', _DAYS.format('day'))}
        SELECT user_id, day, {r('coalesce(purchase, first_value(purchase IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 6)} AS purchase FROM i""",
)
def _interpolate_time(spark, sf):
    wide = user_days_wide(spark, sf).select("user_id", "day", "purchase")
    timed = impute.interpolate(wide, **USER, cols=["purchase"], by="time")
    return round_columns(impute.edge_filled(timed, **USER, cols=["purchase"]), 6)


_SHARED = " + ".join(f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in EVENT_TYPES)
_SQUARE = " + ".join(f"coalesce((b.{c} - a.{c}) * (b.{c} - a.{c}), 0)" for c in EVENT_TYPES)
_KNN_SQL = (
    f"""WITH {P2_WIDE_SQL},
    d AS (SELECT a.user_id, a.day, b.day AS b_day, {', '.join(f'b.{c} AS {c}' for c in EVENT_TYPES)},
          round(({_SQUARE}) * {len(EVENT_TYPES)} / NULLIF({_SHARED}, 0), 9) AS dist FROM p2w a JOIN p2w b USING (user_id))"""
    + "".join(
        f""", k_{c} AS (SELECT user_id, day, avg({c}) AS v FROM (SELECT user_id, day, {c}, row_number() OVER (PARTITION BY user_id, day ORDER BY dist, b_day) AS rn
          FROM d WHERE {c} IS NOT NULL AND dist IS NOT NULL) WHERE rn <= 5 GROUP BY 1, 2), m_{c} AS (SELECT user_id, avg({c}) AS v FROM p2w GROUP BY 1)"""
        for c in EVENT_TYPES
    )
    + " SELECT p2w.user_id, p2w.day, "
    + ", ".join(r(f"coalesce(p2w.{c}, k_{c}.v, m_{c}.v)", 6) + f" AS {c}" for c in EVENT_TYPES)
    + " FROM p2w "
    + " ".join(
        f"LEFT JOIN k_{c} ON k_{c}.user_id = p2w.user_id AND k_{c}.day = p2w.day LEFT JOIN m_{c} ON m_{c}.user_id = p2w.user_id"
        for c in EVENT_TYPES
    )
)


@query("impute_knn", _KNN_SQL)
def _impute_knn(spark, sf):
    return round_columns(impute.fill_knn(user_days_wide(spark, sf), **USER, cols=EVENT_TYPES), 6)


@query("impute_iterative")
def _impute_iterative(spark, sf):
    return round_columns(impute.fill_iterative(user_days_wide(spark, sf), keys=["user_id"], cols=EVENT_TYPES), 4)


@query("impute_knn_blocks")
def _impute_knn_blocks(spark, sf):
    """All users as one series: far above the panel grain."""
    return round_columns(fill_knn_blocks(user_days_wide(spark, sf), date="day", cols=EVENT_TYPES), 6)


def _regressed(source: str) -> str:
    """SQL of one round on the columns click and view of ``source``, with a ridge of 0.001."""
    fits = ", ".join(
        f"covar_pop({x}, {y}) FILTER (NOT gap_{y}) / (var_pop({x}) FILTER (NOT gap_{y}) + 0.001) AS slope_{y}, "
        f"avg({x}) FILTER (NOT gap_{y}) AS mx_{y}, avg({y}) FILTER (NOT gap_{y}) AS my_{y}"
        for x, y in (("click", "view"), ("view", "click"))
    )
    cells = ", ".join(
        f"CASE WHEN gap_{y} THEN my_{y} + slope_{y} * ({x} - mx_{y}) ELSE {y} END AS {y}"
        for x, y in (("click", "view"), ("view", "click"))
    )
    return f"SELECT user_id, day, gap_click, gap_view, {cells} FROM {source}, (SELECT {fits} FROM {source})"


@query(
    "impute_iterative_two",
    f"""WITH {P2_WIDE_SQL}, k AS (SELECT user_id, avg(click) AS kc, avg(view) AS kv FROM p2w GROUP BY 1),
        a AS (SELECT user_id, day, click IS NULL AS gap_click, view IS NULL AS gap_view, coalesce(click, kc) AS click, coalesce(view, kv) AS view FROM p2w JOIN k USING (user_id)),
        r0 AS (SELECT user_id, day, gap_click, gap_view, coalesce(click, (SELECT avg(click) FROM a)) AS click, coalesce(view, (SELECT avg(view) FROM a)) AS view FROM a),
        r1 AS ({_regressed('r0')}), r2 AS ({_regressed('r1')}), r3 AS ({_regressed('r2')})
        SELECT user_id, day, {r('click', 4)} AS click, {r('view', 4)} AS view FROM r3""",
)
def _impute_iterative_two(spark, sf):
    wide = user_days_wide(spark, sf).select("user_id", "day", "click", "view")
    return round_columns(impute.fill_iterative(wide, keys=["user_id"], cols=["click", "view"], rounds=3, tolerance=0.0), 4)


@query(
    "clean_dataset",
    f"""WITH {P2_DENSE_SQL}, {_TOP_TYPE_SQL}, w AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 2) AS purchase FROM events GROUP BY 1, 2),
        d AS (SELECT p2d.user_id, p2d.day, value_sum, top_type, purchase FROM p2d LEFT JOIN t USING (user_id, day) LEFT JOIN w USING (user_id, day)),
        c AS (SELECT user_id, top_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, top_type) AS rn
              FROM d WHERE top_type IS NOT NULL GROUP BY 1, 2),
        md AS (SELECT user_id, quantile_cont(purchase, 0.5) AS med FROM d GROUP BY 1),
        e AS (SELECT d.user_id, d.day, d.value_sum, coalesce(d.top_type, c.top_type) AS top_type, coalesce(d.purchase, med) AS purchase
              FROM d LEFT JOIN c ON d.user_id = c.user_id AND rn = 1 LEFT JOIN md ON md.user_id = d.user_id),
        {_interp_sql('i', 'e', 'user_id', 'day', 'value_sum', _POS.format('user_id', 'day'))},
        s AS (SELECT user_id, avg(value_sum) AS vm, stddev_samp(value_sum) AS vs, avg(purchase) AS pm, stddev_samp(purchase) AS ps FROM i GROUP BY 1)
        SELECT user_id, day, top_type,
          {r('CASE WHEN value_sum IS NULL OR vs IS NULL THEN value_sum ELSE least(greatest(value_sum, vm - 3 * vs), vm + 3 * vs) END', 6)} AS value_sum,
          {r('CASE WHEN purchase IS NULL OR ps IS NULL THEN purchase ELSE least(greatest(purchase, pm - 3 * ps), pm + 3 * ps) END', 6)} AS purchase
        FROM i JOIN s USING (user_id)""",
)
def _clean_dataset(spark, sf):
    events = table(spark, sf, "events")
    days = events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.round(F.sum("value"), 2).alias("value_sum"),
        F.max("event_type").alias("top_type"),
        F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 2).alias("purchase"),
    )
    dense = panel.densify(days, **USER, step="1 day")
    return round_columns(impute.clean(dense, **USER, methods={"purchase": "median"}), 6)
