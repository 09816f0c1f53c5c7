"""Refits on every window: no leak, trees against a search by hand, a forest against the last value."""

import datetime as dt

import numpy as np
import pytest

from seriesloom.operators import backtest, refit

WALK = backtest.walk_forward(min_train=60, window=12, step=12)
SERIES = {"keys": ["key"], "date": "month", "target": "y", "features": ["x", "phase"]}


def _series(spark, change=lambda i, y: y, gaps=()):
    rng = np.random.default_rng(1)
    rows = []
    for key in ("a", None):
        x = rng.normal(size=120)
        for i in range(120):
            y = float(np.where(x[i] > 0.3, 50, 10) + 20 * (i % 4 == 1) + rng.normal())
            rows.append((key, dt.date(2010 + i // 12, i % 12 + 1, 1), change(i, y), None if i in gaps else float(x[i]), float(i % 4)))
    return spark.createDataFrame(rows, "key string, month date, y double, x double, phase double")


def _rmse(rows):
    return float(np.sqrt(np.mean([(r.true_value - r.predicted_value) ** 2 for r in rows])))


@pytest.mark.parametrize("model", ["forest", "boosted"])
def test_trees_beat_the_last_value(spark, model):
    df = _series(spark)
    rows = refit.backtest_refit(df, WALK, **SERIES, model=model).collect()
    naive = backtest.backtest_naive(df, WALK, keys=["key"], date="month", target="y").collect()
    test = [r for r in rows if r.split == "test"]
    assert len(test) == len(naive) == 2 * 5 * 12
    assert _rmse(test) < 0.4 * _rmse(naive)


@pytest.mark.parametrize("model", ["ridge", "forest", "boosted"])
def test_test_rows_do_not_leak(spark, model):
    """Other values after a window's train rows leave its predictions of the same inputs unchanged."""

    def predictions(df):
        rows = refit.backtest_refit(df, WALK, **SERIES, model=model).filter("window = 0").collect()
        return sorted((str(r.key), r.month, r.predicted_value) for r in rows)

    assert predictions(_series(spark)) == predictions(_series(spark, lambda i, y: y if i < 60 else 1000.0))


def test_gaps_and_short_series(spark):
    df = _series(spark, lambda i, y: None if i in (3, 61) else y, gaps=(5, 62))
    rows = refit.backtest_refit(df, WALK, **SERIES, alpha=1.0).filter("window = 0 and key = 'a'").orderBy("month").collect()
    assert [i for i, r in enumerate(rows) if r.predicted_value is None] == [5, 62] and rows[61].true_value is None
    assert refit.backtest_refit(df.limit(0), WALK, **SERIES).count() == 0
    few = refit.backtest_refit(df, backtest.walk_forward(min_train=1, window=12, step=200), **SERIES).filter("split = 'test'")
    assert few.filter("predicted_value is not null").count() == 0 and few.count() == 24


def test_scaler_knows_train_rows_only():
    change = refit.scaled(np.array([[1.0, 5.0], [3.0, 5.0]]))
    assert change(np.array([[5.0, 6.0]])).tolist() == [[3.0, 1.0]]


def test_cut_against_a_search_by_hand():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 6, (25, 3)).astype(float), rng.normal(size=25)
        best = max(
            (sum((y - y.mean()) ** 2) - sum(sum((p - p.mean()) ** 2) for p in (y[x[:, j] <= v], y[x[:, j] > v])))
            for j in range(3)
            for v in np.unique(x[:, j])[:-1]
        )
        saved, j, limit = refit._best_cut(x, y, np.arange(3), 1)
        parts = y[x[:, j] <= limit], y[x[:, j] > limit]
        assert saved == pytest.approx(best) == pytest.approx(sum((y - y.mean()) ** 2) - sum(sum((p - p.mean()) ** 2) for p in parts))


def test_split_metrics(spark):
    rows = [("a", 0, "train", 1.0, 2.0), ("a", 0, "train", 3.0, 2.0), ("a", 0, "test", 4.0, 2.0), ("a", 0, "test", 2.0, None)]
    (out,) = refit.split_metrics(spark.createDataFrame(rows, "key string, window int, split string, true_value double, predicted_value double"), keys=["key"]).collect()
    assert (out.train_rmse, out.test_rmse, out.train_r2, out.rmse_rise_pct) == (1.0, 2.0, 0.0, 100.0)
