"""Nearest rows by blocks: recall against all pairs, and equality with the exact fill."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import impute
from seriesloom.operators.neighbours import _first, _nearest, block_neighbours, fill_knn_blocks

COLS = ["u", "v", "w", "z"]


def _frame(spark, n, keys=("a",), seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, 4)) + 0.1 * rng.normal(size=(n, 4))
    x[rng.random(x.shape) < 0.08] = np.nan
    rows = [(keys[i % len(keys)], dt.date(2000, 1, 1) + dt.timedelta(i), *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "key string, date date, u double, v double, w double, z double"), x


def test_recall_in_one_long_series(spark):
    df, x = _frame(spark, 6000)
    numbered = df.withColumn("_id", F.datediff("date", F.lit("2000-01-01")).cast("long"))
    means = np.nanmean(x, axis=0).tolist()
    numbered = numbered.withColumns({f"_full_{c}": F.coalesce(c, F.lit(m)) for c, m in zip(COLS, means)})
    rows = block_neighbours(numbered, keys=["key"], date="date", cols=COLS, k=5, block=128, orders=1, seed=42).collect()
    found = {(r._id, j): {n.donor for n in near} for r in rows for j, near in enumerate(r.near)}
    hits = total = 0
    for i in np.flatnonzero(np.isnan(x).any(axis=1)):
        step = x - x[i]
        both = ~np.isnan(step)
        dist = np.where(both.any(axis=1), np.nansum(step**2, axis=1) * 4 / np.maximum(both.sum(axis=1), 1), np.inf)
        for j in np.flatnonzero(np.isnan(x[i])):
            donors = np.flatnonzero(~np.isnan(x[:, j]) & np.isfinite(dist))
            best = set(donors[np.argsort(np.round(dist[donors], 9), kind="stable")[:5]].tolist())
            hits, total = hits + len(best & found.get((int(i), int(j)), set())), total + len(best)
    assert total > 8000 and hits / total >= 0.9


@pytest.mark.parametrize("n", [90, 0])
def test_short_series_are_filled_exactly(spark, n):
    df, _ = _frame(spark, max(n, 1), keys=("a", "b", "c"))
    df = df.limit(n).unionByName(df.limit(min(n, 2)))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = fill_knn_blocks(df, keys=["key"], date="date", cols=COLS).orderBy("key", "date", *COLS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = impute.fill_knn(df, keys=["key"], date="date", cols=COLS).orderBy("key", "date", *COLS).collect()
    assert len(got) == len(want)
    np.testing.assert_allclose(np.array([r[2:] for r in got], float), np.array([r[2:] for r in want], float))


def test_hard_rows(spark):
    rows = [(None, None, 1.0, None), (None, None, None, None), ("a", dt.date(2020, 1, 1), None, None), ("a", dt.date(2020, 1, 2), None, 4.0)]
    df = spark.createDataFrame(rows, "key string, date date, u double, v double")
    out = fill_knn_blocks(df, keys=["key"], date="date", cols=["u", "v"]).collect()
    assert sorted(((r.key, r.u, r.v) for r in out), key=str) == sorted([(None, 1.0, None), (None, 1.0, None), ("a", None, 4.0), ("a", None, 4.0)], key=str)
    whole = fill_knn_blocks(df, date="date", cols=["u", "v"]).collect()
    assert {(r.u, r.v) for r in whole} == {(1.0, 4.0)}


def test_first_cells_by_size_then_place():
    dist = np.array([[3.0, 1.0, 1.0, np.inf, 0.5], [np.inf] * 5, [2.0, 2.0, 2.0, 2.0, 2.0]])
    r, c = _first(dist, 3)
    assert list(zip(r.tolist(), c.tolist())) == [(0, 4), (0, 1), (0, 2), (2, 0), (2, 1), (2, 2)]
    assert [len(x) for x in _first(dist, 9)] == [9, 9] and [len(x) for x in _first(dist[:, :0], 3)] == [0, 0]


def test_a_list_for_every_missing_cell():
    n, names = 300, ["u", "v"]
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"u": rng.integers(0, 5, n).astype(float), "v": rng.normal(size=n), "_id": np.arange(n), "_at": np.arange(n) // 2, "_order": 0, "_group": "/0"})
    rows.loc[::7, "v"], rows.loc[5::50, "u"] = np.nan, np.inf
    out = _nearest(rows, rows, names, 5, np.eye(2) != 0).to_pandas()
    missing = rows[rows.v.isna() & np.isfinite(rows.u)]
    assert sorted(out["_id"]) == sorted(missing["_id"]) and set(out["_col"]) == {1}
    for i, near in zip(out["_id"], out["near"]):
        donors = rows[rows.v.notna() & np.isfinite(rows.u)].assign(dist=lambda d: np.round((d.u - rows.u[i]) ** 2 * 2, 9))
        want = donors.sort_values(["dist", "_at", "_id"])[["dist", "_at", "_id", "v"]][:5]
        assert [tuple(x.values()) for x in near] == list(want.itertuples(index=False, name=None))
