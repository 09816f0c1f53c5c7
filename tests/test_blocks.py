"""Block-wise running operators equal the plain window forms, whatever the blocks."""

import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import blocks, features, impute

ORDER = {"keys": ["key"], "order": ["t"]}
PLAIN = {"keys": ["key"], "date": "t"}


def _frame(spark):
    rng = random.Random(6)
    rows = []
    for key, n in (("hot", 400), ("b", 37), ("one", 1), ("empty", 20), (None, 30)):
        at = 0
        for i in range(n):
            at += rng.choice([1, 1, 1, 9])
            known = key != "empty" and rng.random() < (0.05 if 100 < i < 300 else 0.5)
            rows.append((key, at, float(rng.randint(0, 99)) if known else None, float(i % 7)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "key string, t long, x double, z double").repartition(5)


def _rows(df, *cols):
    return sorted((str(r.key), r.t, *[r[c] for c in cols]) for r in df.collect())


def _same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2] and all((u is None) == (v is None) and (u is None or u == pytest.approx(v)) for u, v in zip(x[2:], y[2:], strict=True))


@pytest.mark.parametrize("length", [1, 3, 50, 10_000])
def test_any_block_length(spark, length):
    df = _frame(spark).cache()
    block = F.floor(F.col("t") / length)
    _same(_rows(blocks.fill_forward(df, **ORDER, block=block, cols=["x"]), "x"), _rows(impute.fill_forward(df, **PLAIN, cols=["x"]), "x"))
    _same(_rows(blocks.fill_backward(df, **ORDER, block=block, cols=["x"]), "x"), _rows(impute.fill_backward(df, **PLAIN, cols=["x"]), "x"))
    both = impute.fill_forward(df, **PLAIN, cols=["x"], then_back=True)
    _same(_rows(blocks.fill_both(df, **ORDER, block=block, cols=["x"]), "x"), _rows(both, "x"))
    line = blocks.interpolate(df, **ORDER, block=block, cols=["x"])
    assert line.columns == df.columns
    _same(_rows(line, "x"), _rows(impute.interpolate(df, **PLAIN, cols=["x"]), "x"))
    mean = features.expanding_mean(df, **PLAIN, cols=["x", "z"])
    _same(_rows(blocks.expanding_mean(df, **ORDER, block=block, cols=["x", "z"]), "x_exp_mean", "z_exp_mean"), _rows(mean, "x_exp_mean", "z_exp_mean"))
    df.unpersist()


def test_running_gram_against_a_loop(spark):
    df = _frame(spark)
    got = {(str(r.key), r.t): r for r in blocks.running_gram(df, ["x"], "z", **ORDER, block=F.floor(F.col("t") / 20)).collect()}
    for key in ("hot", "b", "None", "empty"):
        n = sx = sxz = 0.0
        for r in sorted((r for r in df.collect() if str(r.key) == key), key=lambda r: r.t):
            if r.x is not None:
                n, sx, sxz = n + 1, sx + r.x, sxz + r.x * r.z
            row = got[key, r.t]
            assert (row.n, row.s_x, row.g_x_z) == (n, sx, sxz)


def test_by_days(spark):
    rows = [("a", "2020-01-01", 0.0), ("a", "2020-01-02", None), ("a", "2020-01-11", 10.0), ("a", "2020-02-20", None)]
    df = spark.createDataFrame(rows, "key string, t string, x double").withColumn("t", F.col("t").cast("date"))
    out = blocks.interpolate(df, **ORDER, block=F.trunc("t", "month"), cols=["x"], by="days").orderBy("t")
    assert [r.x for r in out.collect()] == [0.0, 1.0, 10.0, 10.0]


def test_empty(spark):
    df = _frame(spark).limit(0)
    assert blocks.interpolate(df, **ORDER, block=F.col("t"), cols=["x"]).count() == 0


def test_rows_are_only_ordered_inside_blocks(spark):
    plan = blocks.fill_forward(_frame(spark), **ORDER, block=F.floor(F.col("t") / 20), cols=["x"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    over_rows = [line for line in windows if "_kind" in line]
    assert len(windows) == 2 and len(over_rows) == 1 and "[key#" in over_rows[0] and "_block#" in over_rows[0]
