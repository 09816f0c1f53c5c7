"""Sources, projections, scalar and calendar functions, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.expressions import INF, round_columns
from seriesloom.operators import calendar as cal
from seriesloom.operators import outliers as out
from seriesloom.operators import projections as pj
from seriesloom.plans.registry import query, r
from seriesloom.plans.tables import P1_SQL, P2_WIDE_SQL, nation_panel, table, user_days_wide
from seriesloom.sources import SourceSpec, coerce_types, load_sources, standardize_dates

# ---------------------------------------------------------------- sources


@query(
    "load_sources",
    f"""SELECT source, date, count(*) AS n_rows, {r('sum(value)', 2)} AS total FROM (
          SELECT 'sales' AS source, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value FROM orders
          UNION ALL SELECT 'shipments', CAST(l_shipdate AS DATE), l_extendedprice FROM lineitem
          UNION ALL SELECT 'activity', CAST(ts AS DATE), value FROM events) GROUP BY 1, 2""",
)
def _load_sources(spark, sf):
    specs = {
        "sales": SourceSpec(f"{sf}/orders.parquet", date_col="o_orderdate", numeric_cols=["o_totalprice"]),
        "shipments": SourceSpec(f"{sf}/lineitem.parquet", date_col="l_shipdate", numeric_cols=["l_extendedprice"]),
        "activity": SourceSpec(f"{sf}/events.parquet", date_col="ts", numeric_cols=["value"]),
        "gold": SourceSpec(f"{sf}/gold_price.parquet", date_col="date", required=False),
    }
    fields = {"sales": ("o_orderdate", "o_totalprice"), "shipments": ("l_shipdate", "l_extendedprice"), "activity": ("ts", "value")}
    stacked = None
    for name, df in load_sources(spark, specs).items():
        date, value = fields[name]
        part = df.groupBy(F.lit(name).alias("source"), F.col(date).alias("date")).agg(
            F.count("*").alias("n_rows"), F.round(F.sum(value), 2).alias("total")
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


_DIRTY_SQL = """dirty AS (SELECT o_orderkey,
    CASE WHEN o_orderpriority LIKE '5%' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text,
    CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS price_text FROM orders)"""


def _dirty_orders(spark, sf):
    """Orders with their date and price as text, some of it unreadable."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority").startswith("5"), F.lit("unknown"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("date_text"),
        F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("price_text"),
    )


@query(
    "coerce_types",
    f"WITH {_DIRTY_SQL} SELECT o_orderkey, TRY_CAST(date_text AS DATE) AS date_text, TRY_CAST(price_text AS DOUBLE) AS price_text FROM dirty",
)
def _coerce_types(spark, sf):
    return coerce_types(_dirty_orders(spark, sf), dates={"date_text": "yyyy-MM-dd"}, numerics=["price_text"])


@query(
    "standardize_dates",
    f"WITH {_DIRTY_SQL} SELECT o_orderkey, CAST(date_text AS DATE) AS date_text, price_text FROM dirty WHERE TRY_CAST(date_text AS DATE) IS NOT NULL",
)
def _standardize_dates(spark, sf):
    return standardize_dates(_dirty_orders(spark, sf), "date_text", "yyyy-MM-dd")


# ---------------------------------------------------------------- projections


@query("numeric_projection", "SELECT o_orderstatus, o_orderkey, o_custkey, o_totalprice FROM orders")
def _numeric_projection(spark, sf):
    return pj.numeric_projection(table(spark, sf, "orders"), keep=["o_orderstatus"])


@query(
    "drop_missing",
    f"WITH {P2_WIDE_SQL} SELECT * FROM p2w WHERE click IS NOT NULL AND view IS NOT NULL AND purchase IS NOT NULL",
)
def _drop_missing(spark, sf):
    return pj.drop_missing(user_days_wide(spark, sf), ["click", "view", "purchase"])


@query("drop_all_null_columns", f"WITH {P2_WIDE_SQL} SELECT * FROM p2w")
def _drop_all_null_columns(spark, sf):
    events = table(spark, sf, "events")
    refunds = F.sum(F.when(F.col("event_type") == "refund", F.col("value")))
    per_day = events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        *[
            F.round(F.sum(F.when(F.col("event_type") == t, F.col("value"))), 2).alias(t)
            for t in ("click", "error", "purchase", "signup", "view")
        ],
        refunds.alias("refund"),
    )
    return pj.drop_empty_columns(per_day)


@query("low_variance_filter", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def _low_variance_filter(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_discount",
        (F.col("l_quantity") - F.col("l_quantity") + 1).alias("constant"),
    )
    return pj.drop_near_constant(lines, ["l_quantity", "l_discount", "constant"])


@query(
    "replace_inf",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / NULLIF(l_discount, 0) AS per_discount FROM lineitem),
             m AS (SELECT avg(per_discount) AS mean FROM x)
        SELECT l_orderkey, l_linenumber, {r('coalesce(per_discount, mean)', 4)} AS per_discount FROM x, m""",
)
def _replace_inf(spark, sf):
    per_discount = F.when(F.col("l_discount") == 0, F.lit(INF)).otherwise(F.try_divide("l_quantity", "l_discount"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", per_discount.alias("per_discount"))
    return round_columns(pj.replace_infinite(lines, ["per_discount"]), 4)


@query(
    "log_transform",
    f"""WITH b AS (SELECT min(c_acctbal) AS lo FROM customer)
        SELECT o_orderkey, {r('ln(o_totalprice)', 6)} AS log_o_totalprice, {r('sqrt(o_totalprice)', 6)} AS sqrt_o_totalprice,
               {r('CASE WHEN lo > 0 THEN ln(c_acctbal) ELSE c_acctbal END', 6)} AS log_c_acctbal
        FROM orders JOIN customer ON o_custkey = c_custkey, b""",
)
def _log_transform(spark, sf):
    customer = pj.transform_columns(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": "log"})
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    orders = pj.transform_columns(pj.transform_columns(orders, {"o_totalprice": "log"}), {"o_totalprice": "sqrt"})
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return round_columns(joined.select("o_orderkey", "log_o_totalprice", "sqrt_o_totalprice", "log_c_acctbal"), 6)


@query(
    "log1p_roundtrip",
    f"""WITH b AS (SELECT CASE WHEN min(c_acctbal) < 0 THEN -min(c_acctbal) ELSE 0 END AS shift FROM customer)
        SELECT c_custkey, {r('shift', 2)} AS c_acctbal_shift, {r('ln(1 + c_acctbal + shift)', 6)} AS log1p_c_acctbal,
               {r('c_acctbal', 2)} AS c_acctbal_restored FROM customer, b""",
)
def _log1p_roundtrip(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out_ = pj.expm1_restored(pj.log1p_shifted(customer, "c_acctbal"), "c_acctbal")
    return out_.select(
        "c_custkey",
        F.round("c_acctbal_shift", 2).alias("c_acctbal_shift"),
        F.round("log1p_c_acctbal", 6).alias("log1p_c_acctbal"),
        F.round("c_acctbal_restored", 2).alias("c_acctbal_restored"),
    )


_BOXCOX_LLF = "-max(n) * max(g) - max(n) / 2 * ln(var_pop(CASE WHEN abs(lam) < 1e-12 THEN ln(z) ELSE (pow(z, lam) - 1) / NULLIF(lam, 0) END))"


@query(
    "boxcox",
    f"""WITH b AS (SELECT avg(ln(o_totalprice)) AS g, count(*) AS n FROM orders WHERE o_totalprice > 0),
        z AS (SELECT exp(ln(o_totalprice) - g) AS z, g, n FROM orders, b WHERE o_totalprice > 0),
        l1 AS (SELECT round(-2 + i * 0.1, 10)::DOUBLE AS lam FROM range(0, 41) t(i)),
        c AS (SELECT lam, {_BOXCOX_LLF} AS llf FROM z, l1 GROUP BY lam),
        best AS (SELECT arg_max(lam, llf) AS top FROM c),
        l2 AS (SELECT round(top + i * 0.01, 10)::DOUBLE AS lam FROM best, range(-9, 10) t(i) WHERE i <> 0),
        f AS (SELECT lam, {_BOXCOX_LLF} AS llf FROM z, l2 GROUP BY lam)
        SELECT 'coarse' AS stage, lam, {r('llf', 3)} AS llf FROM c UNION ALL SELECT 'fine', lam, {r('llf', 3)} FROM f""",
)
def _boxcox(spark, sf):
    grid = pj.boxcox_grid(table(spark, sf, "orders"), "o_totalprice")
    return grid.withColumn("llf", F.round("llf", 3))


def _finer(step: str, reach: int, near: str) -> str:
    return f"SELECT round({near}.top + i * {step}, 10)::DOUBLE AS lam FROM {near}, range({-reach}, {reach + 1}) t(i)"


@query(
    "boxcox_column",
    f"""WITH b AS (SELECT avg(ln(o_totalprice)) AS g, count(*) AS n FROM orders WHERE o_totalprice > 0),
        z AS (SELECT exp(ln(o_totalprice) - g) AS z, g, n FROM orders, b WHERE o_totalprice > 0),
        l0 AS (SELECT 0.0 AS top), l1 AS ({_finer('0.1', 20, 'l0')}), t1 AS (SELECT arg_max(lam, llf) AS top FROM (SELECT lam, {_BOXCOX_LLF} AS llf FROM z, l1 GROUP BY lam)),
        l2 AS ({_finer('0.01', 10, 't1')}), t2 AS (SELECT arg_max(lam, llf) AS top FROM (SELECT lam, {_BOXCOX_LLF} AS llf FROM z, l2 GROUP BY lam)),
        l3 AS ({_finer('0.001', 10, 't2')}), t3 AS (SELECT arg_max(lam, llf) AS top FROM (SELECT lam, {_BOXCOX_LLF} AS llf FROM z, l3 GROUP BY lam))
        SELECT o_orderkey, top AS boxcox_lambda_o_totalprice,
               {r('CASE WHEN abs(top) < 1e-12 THEN ln(o_totalprice) ELSE (pow(o_totalprice, top) - 1) / NULLIF(top, 0) END', 4)} AS boxcox_o_totalprice
        FROM orders, t3""",
)
def _boxcox_column(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return round_columns(pj.boxcox_columns(orders, ["o_totalprice"]).drop("o_totalprice"), 4, "boxcox_o_totalprice")


@query(
    "derived_ratios",
    f"""SELECT l_orderkey, l_linenumber, {r('(l_discount + l_tax) / 2', 6)} AS avg_rate, {r('l_tax - l_discount', 6)} AS rate_spread,
               {r('l_extendedprice / NULLIF(l_quantity, 0) - 1', 8)} AS price_per_unit, {r('l_discount + l_tax', 6)} AS rate_sum,
               {r('l_discount * 10', 6)} AS discount_scaled, greatest(l_quantity, 5.0::DOUBLE) AS qty_floor FROM lineitem""",
)
def _derived_ratios(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    made = pj.derived_features(
        lines,
        averages={"avg_rate": ["l_discount", "l_tax"]},
        spreads={"rate_spread": ("l_tax", "l_discount")},
        relatives={"price_per_unit": ("l_extendedprice", "l_quantity")},
        totals={"rate_sum": ["l_discount", "l_tax"]},
        scaled={"discount_scaled": ("l_discount", 10.0)},
        floors={"qty_floor": ("l_quantity", 5.0)},
    )
    made = round_columns(made.drop("l_quantity", "l_extendedprice", "l_discount", "l_tax"), 8, "price_per_unit")
    return round_columns(made, 6, "avg_rate", "rate_spread", "rate_sum", "discount_scaled", "qty_floor")


@query(
    "minmax_normalize",
    f"""WITH b AS (SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)
        SELECT o_orderkey, o_orderpriority, {r('(o_totalprice - lo) / NULLIF(hi - lo, 0)', 6)} AS o_totalprice_norm
        FROM orders JOIN b USING (o_orderpriority)""",
)
def _minmax_normalize(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    scaled = pj.minmax_normalize(orders, ["o_totalprice"], keys=["o_orderpriority"])
    return round_columns(scaled.drop("o_totalprice"), 6)


@query(
    "resolve_features",
    f"""WITH {P1_SQL} SELECT n_name, month, revenue AS retail_sales, qty AS qty_lending, avg_disc AS disc,
          {r('ln(revenue)', 6)} AS sales_level, 0.0::DOUBLE AS gold_price FROM p1""",
)
def _resolve_features(spark, sf):
    panel = nation_panel(spark, sf)
    trained_on = panel.select(
        "n_name", "month", "revenue", "qty", F.col("avg_disc").alias("disc_macro"), F.round(F.ln("revenue"), 6).alias("log_sales_level")
    )
    return pj.resolve_features(
        trained_on,
        ["retail_sales", "qty_lending", "disc", "sales_level", "gold_price"],
        aliases={"retail_sales": "revenue"},
        suffixes=["_gold", "_oil", "_lending", "_iip", "_cpi", "_macro"],
        keep=["n_name", "month"],
    )


# ---------------------------------------------------------------- calendar


@query(
    "calendar_features",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter,
              CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day_of_month,
              CAST(isodow(o_orderdate) - 1 AS INT) AS day_of_week FROM orders""",
)
def _calendar_features(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return cal.calendar_parts(orders, "date")


@query(
    "cyclical_features",
    f"""SELECT o_orderkey, {r('sin(2 * pi() * month(o_orderdate) / 12)', 6)} AS month_sin, {r('cos(2 * pi() * month(o_orderdate) / 12)', 6)} AS month_cos,
               {r('sin(2 * pi() * quarter(o_orderdate) / 4)', 6)} AS quarter_sin, {r('cos(2 * pi() * quarter(o_orderdate) / 4)', 6)} AS quarter_cos FROM orders""",
)
def _cyclical_features(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return round_columns(cal.cyclical_parts(orders, "o_orderdate").drop("o_orderdate"), 6)


@query(
    "season_flags",
    """WITH m AS (SELECT o_orderkey, month(o_orderdate) AS m FROM orders)
       SELECT o_orderkey, CAST(m IN (3, 9, 10, 11, 12) AS INT) AS is_holiday_season, CAST(m IN (10, 11) AS INT) AS is_diwali_season,
              CAST(m IN (8, 9) AS INT) AS is_pre_diwali, CAST(m = 2 AS INT) AS is_budget_month,
              CAST(m = 1 AS INT) AS is_pre_budget, CAST(m = 3 AS INT) AS is_post_budget FROM m""",
)
def _season_flags(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return cal.season_flags(orders, "o_orderdate").drop("o_orderdate")


_WAVES = ", ".join(
    f"{r(f'{fn}(2 * pi() * p / {n})', 6)} AS seasonal_{fn}_{n}" for n in (4, 6, 12) for fn in ("sin", "cos")
)


@query(
    "seasonal_waves",
    f"""WITH {P1_SQL}, o AS (SELECT n_name, month, row_number() OVER (PARTITION BY n_name ORDER BY month) - 1 AS p FROM p1)
        SELECT n_name, month, {_WAVES} FROM o""",
)
def _seasonal_waves(spark, sf):
    panel = nation_panel(spark, sf).select("n_name", "month")
    return round_columns(cal.seasonal_waves(panel, keys=["n_name"], date="month"), 6)


@query(
    "forecast_calendar",
    f"""WITH {P1_SQL}, l AS (SELECT n_name, max(month) AS last FROM p1 GROUP BY 1)
        SELECT n_name, CAST(i AS INT) AS step, last_day(CAST(last + to_months(CAST(i AS INT)) AS DATE)) AS month FROM l, range(1, 13) t(i)""",
)
def _forecast_calendar(spark, sf):
    return cal.forecast_calendar(nation_panel(spark, sf), keys=["n_name"], date="month", periods=12)


@query(
    "detect_date_format",
    """SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'MM/DD/YYYY' WHEN 'P' THEN 'DD.MM.YYYY' ELSE 'YYYY-MM-DD' END AS date_format,
              count(*) AS n_matching, count(*) AS n_values FROM orders GROUP BY 1""",
)
def _detect_date_format(spark, sf):
    d = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(d, "MM/dd/yyyy"))
        .when(F.col("o_orderstatus") == "P", F.date_format(d, "dd.MM.yyyy"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    orders = table(spark, sf, "orders").select("o_orderstatus", text.alias("text"))
    return cal.detect_date_format(orders, "text", keys=["o_orderstatus"])


# ---------------------------------------------------------------- outliers

_STATS = """s AS (SELECT avg(value) AS mean, stddev_samp(value) AS sd, stddev_pop(value) AS sdp, min(value) AS lo, max(value) AS hi,
      quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.01) AS q1,
      quantile_cont(value, 0.99) AS q99, quantile_cont(value, 0.5) AS q50 FROM events)"""


def _event_values(spark, sf):
    return table(spark, sf, "events").select("event_id", "value")


@query(
    "outlier_clip",
    f"""WITH {_STATS}, f AS (SELECT count(*) AS n FROM events, s WHERE abs(value - mean) / sdp > 3
          OR value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25))
        SELECT event_id, {r('CASE WHEN n > 0 THEN least(greatest(value, q1), q99) ELSE value END', 4)} AS value FROM events, s, f""",
)
def _outlier_clip(spark, sf):
    return round_columns(out.clip_flagged_columns(_event_values(spark, sf), ["value"]), 4)


@query(
    "outlier_iqr",
    f"""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.75) AS q75,
              quantile_cont(o_totalprice, 0.05) AS q5, quantile_cont(o_totalprice, 0.95) AS q95 FROM orders),
        f AS (SELECT count(*) AS n FROM orders, q WHERE o_totalprice < q25 - 0.4 * (q75 - q25) OR o_totalprice > q75 + 0.4 * (q75 - q25))
        SELECT o_orderkey, {r('CASE WHEN n > 0 THEN least(greatest(o_totalprice, q5), q95) ELSE o_totalprice END', 4)} AS o_totalprice FROM orders, q, f""",
)
def _outlier_iqr(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    clipped = out.clip_flagged_columns(orders, ["o_totalprice"], methods=["iqr"], iqr_factor=0.4, caps=(0.05, 0.95))
    return round_columns(clipped, 4)


@query(
    "outlier_winsorize",
    f"WITH {_STATS} SELECT event_id, {r('least(greatest(value, mean - 3 * sd), mean + 3 * sd)', 4)} AS value FROM events, s",
)
def _outlier_winsorize(spark, sf):
    return round_columns(out.winsorize(_event_values(spark, sf), ["value"]), 4)


@query("outlier_remove", f"WITH {_STATS} SELECT event_id, value FROM events, s WHERE abs(value - mean) / sd <= 3")
def _outlier_remove(spark, sf):
    return out.remove_outliers(_event_values(spark, sf), ["value"])


@query(
    "outlier_median",
    f"WITH {_STATS} SELECT event_id, {r('CASE WHEN abs(value - mean) / sd > 3 THEN q50 ELSE value END', 4)} AS value FROM events, s",
)
def _outlier_median(spark, sf):
    return round_columns(out.replace_outliers_by_median(_event_values(spark, sf), ["value"]), 4)


@query("outlier_flag_2sd", f"WITH {_STATS} SELECT event_id, value, abs(value - mean) / sd > 2 AS is_extreme FROM events, s")
def _outlier_flag_2sd(spark, sf):
    return out.flag_beyond(_event_values(spark, sf), "value")
