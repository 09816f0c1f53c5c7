"""Running operators on order lines, of which a single return flag holds a third or more."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import blocks
from seriesloom.plans.registry import query
from seriesloom.plans.tables import table

IDS = ("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")


def _long() -> dict:
    return {"keys": ["l_returnflag"], "order": ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], "block": F.date_trunc("month", F.col("l_shipdate"))}


def _lines(spark, sf):
    """Lines with gaps: the quantity is known where the discount is over 5 %."""
    known = F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(*IDS, "l_shipdate", "l_quantity", "l_extendedprice", known.alias("qty"))


_SQL = """WITH l AS (
  SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice, CASE WHEN l_discount > 0.05 THEN l_quantity END AS qty FROM lineitem),
w AS (
  SELECT *, row_number() OVER s - 1 AS pos,
         last_value(qty IGNORE NULLS) OVER u AS prev, first_value(qty IGNORE NULLS) OVER d AS next
  FROM l WINDOW s AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey),
       u AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       d AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_IDS = ", ".join(IDS)


@query("long_ffill", f"{_SQL} SELECT {_IDS}, prev AS qty FROM w")
def _long_ffill(spark, sf):
    return blocks.fill_forward(_lines(spark, sf), **_long(), cols=["qty"]).select(*IDS, "qty")


@query("long_bfill", f"{_SQL} SELECT {_IDS}, coalesce(next, prev) AS qty FROM w")
def _long_bfill(spark, sf):
    return blocks.fill_both(_lines(spark, sf), **_long(), cols=["qty"], forward_first=False).select(*IDS, "qty")


@query(
    "long_interpolate",
    f"""{_SQL}, k AS (
      SELECT *, max(CASE WHEN qty IS NOT NULL THEN pos END) OVER (PARTITION BY l_returnflag ORDER BY pos) AS pat,
             min(CASE WHEN qty IS NOT NULL THEN pos END) OVER (PARTITION BY l_returnflag ORDER BY pos DESC) AS nat FROM w)
    SELECT {_IDS}, CASE WHEN qty IS NOT NULL THEN qty WHEN next IS NULL THEN prev ELSE prev + ((next - prev) * (pos - pat)) / (nat - pat) END AS qty FROM k""",
)
def _long_interpolate(spark, sf):
    return blocks.interpolate(_lines(spark, sf), **_long(), cols=["qty"]).select(*IDS, "qty")


@query(
    "long_expanding_mean",
    f"""{_SQL} SELECT {_IDS}, avg(qty) OVER (PARTITION BY l_returnflag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qty_exp_mean FROM w""",
)
def _long_expanding_mean(spark, sf):
    return blocks.expanding_mean(_lines(spark, sf), **_long(), cols=["qty"]).select(*IDS, "qty_exp_mean")


@query(
    "long_gram",
    f"""{_SQL}, c AS (SELECT *, CASE WHEN qty IS NULL THEN 0 ELSE 1 END AS ok, coalesce(qty, 0) AS x, CASE WHEN qty IS NULL THEN 0 ELSE floor(l_extendedprice) END AS y FROM w)
    SELECT {_IDS}, (sum(ok) OVER r)::BIGINT AS n, sum(x) OVER r AS s_qty, sum(y) OVER r AS s_price, sum(x * x) OVER r AS g_qty_qty, sum(x * y) OVER r AS g_qty_price,
           sum(y * y) OVER r AS g_price_price
    FROM c WINDOW r AS (PARTITION BY l_returnflag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _long_gram(spark, sf):
    rows = _lines(spark, sf).withColumn("price", F.floor("l_extendedprice").cast("double"))
    out = blocks.running_gram(rows, ["qty"], "price", **_long())
    return out.select(*IDS, "n", "s_qty", "s_price", "g_qty_qty", "g_qty_price", "g_price_price")
