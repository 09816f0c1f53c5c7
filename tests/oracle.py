"""Run registered queries beside their SQL and compare, order-insensitive."""

from __future__ import annotations

import datetime as dt
import math
import os
import signal
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"f:{v!r}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, dt.datetime):
        return f"t:{v.isoformat()}"
    if isinstance(v, dt.date):
        return f"d:{v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return f"{type(v).__name__[0]}:{v}"


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """(status, seconds, detail)"""
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(x) for x in df.collect()]
    took = time.time() - start
    if sql is None:
        return "rows", took, f"{len(rows)} rows {df.columns}"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canonical(names, cur.fetchall())
    got = canonical(df.columns, rows)
    if sorted(names) != sorted(df.columns):
        return "FAIL", took, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if got == want:
        return "ok", took, f"{len(rows)} rows"
    have, need = set(got), set(want)
    extra = [g for g in got if g not in need][:3]
    lack = [w for w in want if w not in have][:3]
    return "FAIL", took, f"{len(got)} vs {len(want)} rows\n  cols  {sorted(names)}\n  spark {extra}\n  sql   {lack}"


def main() -> int:
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = os.environ.get("SF", "sf0.01")
    sf_dir = f"/root/testdata/{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    wanted = [q for q in queries if any(q == w or (w.endswith("*") and q.startswith(w[:-1])) for w in wanted)]
    bad = 0
    limit = int(os.environ.get("LIMIT", "60"))

    def too_long(*_):
        raise TimeoutError(f"over {limit}s")

    signal.signal(signal.SIGALRM, too_long)
    for name in wanted:
        signal.alarm(limit)
        try:
            status, took, detail = compare(spark, con, name, queries[name], sqls.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            status, took, detail = "ERROR", 0.0, f"{type(error).__name__}: {str(error)[:1500]}"
        signal.alarm(0)
        bad += status in ("FAIL", "ERROR")
        print(f"{status:5} {took:6.2f}s {name}: {detail}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
