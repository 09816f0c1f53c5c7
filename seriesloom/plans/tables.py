"""The two panels every query starts from, in Spark and in SQL.

Both are aggregated in stages that shrink a hot customer, order or user before
the rows that carry it are shuffled again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.calendar import month_start
from seriesloom.operators.panel import densify

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _per_nation(spark: SparkSession, sf_dir: str, per_customer: DataFrame, measures: dict) -> DataFrame:
    """(o_custkey, month, ...) -> (n_name, month, ...)."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    named = per_customer.join(customer, "o_custkey").join(nation, "c_nationkey")
    return named.groupBy("n_name", "month").agg(*[total.alias(name) for name, total in measures.items()])


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(n_name, month, revenue, qty, avg_disc)`` by order month, revenue in whole units."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_extendedprice", "l_discount"
    )
    per_order = lines.groupBy("o_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.sum("l_quantity").alias("qty"),
        F.sum("l_discount").alias("disc"),
        F.count("*").alias("n"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", month_start("o_orderdate").alias("month"))
    per_customer = per_order.join(orders, "o_orderkey").groupBy("o_custkey", "month").agg(
        *[F.sum(c).alias(c) for c in ("revenue", "qty", "disc", "n")]
    )
    measures = {
        "revenue": F.round(F.sum("revenue"), 0),
        "qty": F.sum("qty"),
        "disc": F.round(F.sum("disc"), 2),
        "n": F.sum("n"),
    }
    panel = _per_nation(spark, sf_dir, per_customer, measures)
    return panel.select("n_name", "month", "revenue", "qty", (F.col("disc") / F.col("n")).alias("avg_disc"))


def nation_ship_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(n_name, month, ship_qty)`` by shipping month."""
    lines = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("o_orderkey"), month_start("l_shipdate").alias("month")
    ).agg(F.sum("l_quantity").alias("ship_qty"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per_customer = lines.join(orders, "o_orderkey").groupBy("o_custkey", "month").agg(F.sum("ship_qty").alias("ship_qty"))
    return _per_nation(spark, sf_dir, per_customer, {"ship_qty": F.sum("ship_qty")})


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, day, value_sum)``, observed days only."""
    events = table(spark, sf_dir, "events")
    per_day = events.groupBy("user_id", F.col("ts").cast("date").alias("day"))
    return per_day.agg(F.round(F.sum("value"), 2).alias("value_sum"))


def user_days_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_days`` with the days between a user's first and last one."""
    return densify(user_days(spark, sf_dir), keys=["user_id"], date="day", step="1 day")


def user_days_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, day, click, error, ...)``: value per event type, NULL for
    none; observed days only."""
    events = table(spark, sf_dir, "events")
    per_day = events.groupBy("user_id", F.col("ts").cast("date").alias("day"))
    return per_day.agg(
        *[F.round(F.sum(F.when(F.col("event_type") == t, F.col("value"))), 2).alias(t) for t in EVENT_TYPES]
    )


P1_SQL = """p1 AS (
  SELECT n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue,
         sum(l_quantity) AS qty,
         round(sum(l_discount), 2) / count(*) AS avg_disc
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)"""

P1_SHIP_SQL = """ship AS (
  SELECT n_name, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS ship_qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)"""

P2_SQL = """p2 AS (
  SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 2) AS value_sum FROM events GROUP BY 1, 2)"""

P2_DENSE_SQL = P2_SQL + """,
p2g AS (
  SELECT user_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP),
         INTERVAL 1 DAY)) AS DATE) AS day
  FROM p2 GROUP BY user_id),
p2d AS (SELECT p2g.user_id, p2g.day, p2.value_sum FROM p2g LEFT JOIN p2 USING (user_id, day))"""

P2_WIDE_SQL = "p2w AS (SELECT user_id, CAST(ts AS DATE) AS day, " + ", ".join(
    f"round(sum(CASE WHEN event_type = '{t}' THEN value END), 2) AS {t}" for t in EVENT_TYPES
) + " FROM events GROUP BY 1, 2)"
