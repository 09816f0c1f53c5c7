"""Hand-made series with known answers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from seriesloom.functions.windows import series_window
from seriesloom.operators import features as ft
from seriesloom.operators import impute, panel
from seriesloom.operators.asof import asof_join, last_known_at_period_end
from seriesloom.operators.series import seasonal_decompose

K = {"keys": ["key"], "date": "date"}


def test_interpolation_edges(series, values):
    df = series({"a": [None, 1, None, None, 4, None]})
    line = impute.interpolate(df, **K, cols=["value"])
    assert values(line) == [None, 1, 2, 3, 4, 4]
    assert values(impute.fill_backward(line, **K, cols=["value"])) == [1, 1, 2, 3, 4, 4]


def test_interpolation_by_position_and_time(spark):
    rows = [("a", dt.date(2020, 1, 1), 0.0), ("a", dt.date(2020, 1, 2), None), ("a", dt.date(2020, 1, 11), 10.0)]
    df = spark.createDataFrame(rows, "key string, date date, value double")
    middle = [
        impute.interpolate(df, **K, cols=["value"], by=by).filter("date = '2020-01-02'").first().value
        for by in ("position", "time")
    ]
    assert middle == [5.0, 1.0]


def test_keys_do_not_leak(series, values):
    df = series({"a": [1, None, 3], "b": [None, 20, None]})
    out = impute.fill_forward(df, **K, cols=["value"])
    assert values(out, "a") == [1, 1, 3] and values(out, "b") == [None, 20, 20]
    lagged = ft.lag_features(df, **K, cols=["value"], lags=1)
    assert values(lagged, "b", "value_lag_1") == [None, None, 20]


def test_pct_change_zero_base_and_gap(series, values):
    out = ft.change_features(series({"a": [0, 5], "b": [10, None, 20]}), **K, cols=["value"], periods=[1])
    assert values(out, "a", "value_pct_1") == [None, None]
    assert values(out, "b", "value_pct_1") == [None, 0.0, 1.0]


def test_rolling_min_periods_and_ddof(series, values):
    df = series({"a": [1, 2, 3], "b": [7]})
    strict = ft.rolling_features(df, **K, cols=["value"], windows=[3], functions=["mean", "std", "std_sample"])
    assert values(strict, col="value_mean_3") == [None, None, 2]
    assert values(strict, col="value_std_3")[2] == pytest.approx(0.8165, abs=1e-4)
    assert values(strict, col="value_std_sample_3")[2] == pytest.approx(1.0)
    loose = ft.rolling_features(df, **K, cols=["value"], windows=[3], functions=["mean"], min_periods=1)
    assert values(loose, col="value_mean_3") == [1, 1.5, 2]
    one = ft.rolling_features(df, **K, cols=["value"], windows=[1], functions=["std", "std_sample"])
    assert values(one, "b", "value_std_1") == [0.0] and values(one, "b", "value_std_sample_1") == [None]


def test_rolling_callable_matches_numpy(series, values):
    x = [3.0, 1, 4, 1, 5, 9, 2, 6]
    out = ft.rolling_features(series({"a": x}), **K, cols=["value"], windows=[4], functions={"med": np.median})
    assert values(out, col="value_med_4")[3:] == [float(np.median(x[i - 3 : i + 1])) for i in range(3, 8)]


def test_window_without_keys_is_refused():
    with pytest.raises(ValueError):
        series_window([], "date")


def test_mode_tie_takes_the_smallest(spark):
    rows = [("k", dt.date(2020, 1, i + 1), v) for i, v in enumerate(["b", "a", "a", "b", None])]
    df = spark.createDataFrame(rows, "key string, date date, value string")
    assert impute.fill_mode(df, keys=["key"], cols=["value"]).filter("date = '2020-01-05'").first().value == "a"


def test_mean_and_median_fill(series, values):
    df = series({"a": [1, 2, 4, 8, None]})
    assert values(impute.fill_mean(df, keys=["key"], cols=["value"]))[-1] == 3.75
    assert values(impute.fill_median(df, keys=["key"], cols=["value"]))[-1] == 3.0
    assert values(impute.fill_mean(series({"a": [None, None]}), keys=["key"], cols=["value"])) == [None, None]


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3)).round(2)
    x[rng.random(x.shape) < 0.25] = np.nan
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(40)]
    pdf = pd.DataFrame(x, columns=["u", "v", "w"]).assign(key="a", date=days)
    rows = [tuple(None if isinstance(c, float) and np.isnan(c) else c for c in row) for row in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "u double, v double, w double, key string, date date")
    got = impute.fill_knn(df, **K, cols=["u", "v", "w"]).orderBy("date").select("u", "v", "w").toPandas().to_numpy()
    want = x.copy()
    for i in range(40):
        for j in range(3):
            if np.isnan(x[i, j]):
                dist = []
                for o in range(40):
                    both = ~np.isnan(x[i]) & ~np.isnan(x[o])
                    if not np.isnan(x[o, j]) and both.any():
                        dist.append((round(float(((x[i] - x[o])[both] ** 2).sum() * 3 / both.sum()), 9), o))
                near = [o for _, o in sorted(dist)[:5]]
                want[i, j] = x[near, j].mean() if near else np.nanmean(x[:, j])
    np.testing.assert_allclose(got, want)


def test_iterative_imputation_recovers_a_plane(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200), rng.normal(size=200)
    c = 2 * a - b + 1
    rows = [(f"k{i % 4}", i, float(a[i]), float(b[i]), None if i % 7 == 0 else float(c[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, i int, a double, b double, c double")
    out = impute.fill_iterative(df, keys=["key"], cols=["a", "b", "c"], alpha=1e-9).orderBy("i").toPandas()
    assert set(out.columns) == set(df.columns)
    np.testing.assert_allclose(out["c"], c, atol=1e-3)


def test_patterns_and_passes_fill_the_same(spark, monkeypatch):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 50
    x[rng.random(x.shape) < 0.25] = np.nan
    rows = [(i, None if i % 7 == 0 else f"k{i % 5}", *[None if np.isnan(v) else float(v) for v in row], None) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, key string, a double, b double, c double, d double, empty double")
    args = {"keys": ["key"], "cols": ["a", "b", "c", "d", "empty"], "rounds": 4}
    one = impute.fill_iterative(df, **args).orderBy("i").toPandas()
    monkeypatch.setattr(impute, "PATTERN_CELLS", 40)
    other = impute.fill_iterative(df, **args).orderBy("i").toPandas()
    assert one["empty"].isna().all() and not one[list("abcd")].isna().any().any()
    np.testing.assert_allclose(one[list("abcd")], other[list("abcd")], rtol=1e-9)
    held = ~np.isnan(x)
    np.testing.assert_allclose(one[list("abcd")].to_numpy()[held], x[held])
    assert impute.fill_iterative(df.limit(0), **args).count() == 0


def test_rows_without_a_key_are_a_series(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), ("a", 5.0), ("a", None)], "key string, x double")
    assert sorted(r.x for r in impute.fill_mean(df, keys=["key"], cols=["x"]).collect()) == [1.0, 1.0, 5.0, 5.0]


def test_clean_dispatch(spark):
    rows = [("a", dt.date(2020, 1, i + 1), v, t, z) for i, (v, t, z) in enumerate([(1.0, "x", None), (None, None, 2.0), (3.0, "x", None)])]
    df = spark.createDataFrame(rows, "key string, date date, v double, t string, z double")
    out = impute.clean(df, **K, methods={"z": "zero"}).orderBy("date").collect()
    assert [(r.v, r.t, r.z) for r in out] == [(1.0, "x", 0.0), (2.0, "x", 2.0), (3.0, "x", 0.0)]


def test_densify_and_month_ends(spark):
    rows = [("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 1, 4), 2.0), ("b", dt.date(2020, 2, 1), 3.0)]
    df = spark.createDataFrame(rows, "key string, date date, value double")
    out = panel.densify(df, **K, step="1 day").orderBy("key", "date").collect()
    assert [(r.key, r.date.day, r.value) for r in out] == [("a", 1, 1.0), ("a", 2, None), ("a", 3, None), ("a", 4, 2.0), ("b", 1, 3.0)]


def test_reindex_drops_off_grid(spark):
    rows = [("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 2, 15), 2.0)]
    df = spark.createDataFrame(rows, "key string, date date, value double")
    out = panel.reindex(df, **K, start="2020-01-01", end="2020-03-01").orderBy("date").collect()
    assert [(r.date.month, r.value) for r in out] == [(1, 1.0), (2, None), (3, None)]


def test_month_end_carry(spark):
    rows = [("a", dt.date(2020, 1, 5), 1.0), ("a", dt.date(2020, 1, 20), 2.0), ("a", dt.date(2020, 3, 2), 5.0)]
    df = spark.createDataFrame(rows, "key string, date date, value double")
    out = last_known_at_period_end(df, **K, cols=["value"]).orderBy("date").collect()
    assert [(r.date.month, r.value) for r in out] == [(1, 2.0), (2, 2.0), (3, 5.0)]


def test_cubic_reproduces_a_cubic(spark):
    f = lambda d: 0.001 * d**3 - 0.05 * d**2 + d
    days = [0, 10, 25, 40, 60]
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(d), float(f(d))) for d in days]
    df = spark.createDataFrame(rows, "key string, date date, value double")
    out = panel.cubic_upsample(df, **K, value="value").orderBy("date").toPandas()
    np.testing.assert_allclose(out["value"], [f(d) for d in range(61)], atol=1e-8)


def test_align_drops_off_grid_or_takes_the_months_last(spark):
    a = spark.createDataFrame([("k", dt.date(2020, m, 1), float(m)) for m in range(1, 6)], "key string, date date, x double")
    b = spark.createDataFrame(
        [("k", dt.date(2020, 1, 1), 10.0), ("k", dt.date(2020, 2, 15), 99.0), ("k", dt.date(2020, 3, 1), 30.0), ("k", dt.date(2020, 4, 1), 40.0)],
        "key string, date date, y double",
    )
    kw = {"keys": ["key"], "date": "date", "value": {"x": "x", "y": "y"}}
    exact = panel.align_sources({"x": a, "y": b}, **kw).orderBy("date").collect()
    assert [r.date.month for r in exact] == [1, 2, 3, 4]
    assert exact[1].y == pytest.approx(10 + 20 * 31 / 60)
    loose = panel.align_sources({"x": a, "y": b}, **kw, exact=False).orderBy("date").collect()
    assert loose[1].y == 99.0


def _asof(spark, left, right, direction, block):
    l = spark.createDataFrame(left, "key string, id int, ts timestamp_ntz")
    r = spark.createDataFrame(right, "key string, rid int, rts timestamp_ntz, value double")
    out = asof_join(l, r, keys=["key"], left_ts="ts", right_ts="rts", right_cols=["value"], tie="rid", direction=direction, block=block)
    return {row.id: row.value for row in out.collect()}


def test_asof_tie_prefers_the_earlier(spark):
    left = [("a", 1, dt.datetime(2020, 1, 5))]
    right = [("a", 1, dt.datetime(2020, 1, 3), 1.0), ("a", 2, dt.datetime(2020, 1, 7), 2.0)]
    assert _asof(spark, left, right, "nearest", "day") == {1: 1.0}


@pytest.mark.parametrize("block", ["minute", "hour", "year"])
@pytest.mark.parametrize("direction", ["nearest", "backward"])
def test_asof_matches_pandas_whatever_the_block(spark, block, direction):
    rng = np.random.default_rng(3)
    base = dt.datetime(2020, 1, 1)
    # Key "hot" holds most rows; some times repeat on the right side.
    keys = ["hot" if v < 0.8 else "b" for v in rng.random(300)]
    left = [(k, i, base + dt.timedelta(seconds=int(s))) for i, (k, s) in enumerate(zip(keys, rng.integers(0, 20000, 300)))]
    right = [(k, i, base + dt.timedelta(seconds=int(s) * 7), float(i)) for i, (k, s) in enumerate(zip(keys[:150], rng.integers(0, 2800, 150)))]
    l = pd.DataFrame(left, columns=["key", "id", "ts"]).sort_values("ts")
    r = pd.DataFrame(right, columns=["key", "rid", "rts", "value"]).sort_values(["rts", "rid"]).drop_duplicates(["key", "rts"], keep="last")
    want = pd.merge_asof(l, r, left_on="ts", right_on="rts", by="key", direction=direction)
    expected = {i: (None if pd.isna(v) else v) for i, v in zip(want["id"], want["value"])}
    assert _asof(spark, left, right, direction, block) == expected


def test_outer_merge_many_equals_joins(spark):
    d = dt.date(2020, 1, 1)
    a = spark.createDataFrame([("k", d, 1.0)], "key string, date date, v double")
    b = spark.createDataFrame([("k", d, 2.0), ("m", d, 3.0)], "key string, date date, v double")
    out = panel.outer_merge_many({"x": a, "y": b}, on=["key", "date"], value={"x": "v", "y": "v"}).orderBy("key").collect()
    assert [(r.x, r.y) for r in out] == [(1.0, 2.0), (None, 3.0)]


def test_decompose_adds_up(series):
    season = [5, -3, 1, 0, 2, -5, 4, -4, 3, -3, 1, -1]
    df = series({"a": [10 + 0.5 * i + season[i % 12] for i in range(48)]})
    out = seasonal_decompose(df, **K, col="value").orderBy("date").toPandas()
    inner = out.dropna()
    np.testing.assert_allclose(inner["resid"], 0, atol=1e-9)
    np.testing.assert_allclose(out["seasonal"][:12], season, atol=1e-9)
    assert len(inner) == 36


def test_bundle_is_one_window_and_one_exchange(series):
    df = series({"a": range(30), "b": range(30)})
    plan = ft.target_bundle(df, **K, target="value")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    assert "SinglePartition" not in plan


def test_iterative_method_and_edge_fill(spark):
    rows = [("a", dt.date(2020, 1, i + 1), float(i), None if i == 3 else 2.0 * i) for i in range(12)]
    df = spark.createDataFrame(rows, "key string, date date, x double, y double")
    out = impute.clean(df, **K, methods={"x": "iterative", "y": "iterative"}, cap=False)
    assert out.filter("date = '2020-01-04'").first().y == pytest.approx(6.0, abs=0.1)


def test_only_flagged_sources_are_cleaned(series):
    from seriesloom.operators.reports import clean_flagged

    good, bad = series({"a": [1, 2, 3]}), series({"a": [1, None, 3]})
    out = clean_flagged({"good": good, "bad": bad}, keys=["key"], dates={"good": "date", "bad": "date"})
    assert out["good"] is good
    assert [r.value for r in out["bad"].orderBy("date").collect()] == [1, 2, 3]


def test_outer_merge_rows_equals_a_chain_of_joins(spark):
    a = spark.createDataFrame([("k", 1, "p"), ("k", 2, "p"), ("k", 2, "p"), (None, 3, "q"), ("a", 4, None)], "key string, n int, v string")
    b = spark.createDataFrame([("k", 1.0), ("k", None), (None, 2.0), ("b", 3.0)], "key string, v double")
    c = spark.createDataFrame([("k", True), ("c", False), ("c", False)], "key string, w boolean")
    out = [tuple(r) for r in panel.outer_merge_rows({"x": a, "y": b, "z": c}, on=["key"]).collect()]

    def join(left, right, width):
        keys = {r[0] for r in left} | {r[0] for r in right}
        rows = []
        for k in keys:
            mine = [r for r in left if r[0] == k] or [(k, *[None] * (len(left[0]) - 1))]
            rows += [(*m, *t[1:]) for m in mine for t in ([r for r in right if r[0] == k] or [(k, *[None] * width)])]
        return rows

    want = join(join([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()], 1), [tuple(r) for r in c.collect()], 1)
    assert sorted(out, key=str) == sorted(want, key=str) and len(out) == 11
    assert panel.outer_merge_rows({"x": a, "y": b, "z": c}, on=["key"]).columns == ["key", "n", "v_x", "v_y", "w"]
    empty = panel.outer_merge_rows({"x": a.limit(0), "z": c.filter("w")}, on=["key"]).collect()
    assert [tuple(r) for r in empty] == [("k", None, None, True)]
    plan = panel.outer_merge_rows({"x": a, "y": b}, on=["key"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
