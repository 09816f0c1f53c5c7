"""Every registered query: against its SQL where there is one, else it runs;
and the shape of the plans that matter at scale."""

import os

import pytest
from oracle import canonical, connect

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    if name in ("gbt", "hyperparam_search", "hyperparam_best", "feature_selection", "rfe_forest"):
        pytest.skip("long fits: covered by the bench and by unit tests")
    rows = QUERIES[name](spark, SF).collect()
    assert rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["prepare_panel", "ts_feature_bundle", "asof_nearest", "interpolate_linear", "backtest_linear", "ensemble_predict"])
def test_no_window_in_one_task(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line:
            assert not any("SinglePartition" in below for below in lines[i + 1 : i + 4])


def test_scan_reads_only_what_it_needs(spark):
    plan = _plan(QUERIES["outlier_winsorize"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_scenarios_are_broadcast(spark):
    assert "BroadcastHashJoin" in _plan(QUERIES["scenario_run"](spark, SF))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
