"""Helpers that the text operators share."""

import pytest
from pyspark.sql import functions as F

from seriesloom.llm import common


@pytest.mark.parametrize("hashes", [1 << 21, 4, 1])
def test_thinned_loses_no_wanted_row(spark, monkeypatch, hashes):
    monkeypatch.setattr(common, "HASHES", hashes)
    rows = spark.range(2000).select("id", F.lit("text").alias("__hash"))
    rows = rows.unionByName(rows.filter("id < 50"))
    wanted = spark.createDataFrame([(7,), (7,), (40,), (1999,), (5000,), (None,)], "w long")
    out = common.thinned(rows, "id", wanted)
    assert out.columns == rows.columns
    exact = out.join(wanted, out["id"] == wanted["w"], "left_semi")
    assert sorted(r.id for r in exact.collect()) == [7, 7, 40, 40, 1999]
    assert hashes < 2000 or out.count() < 100
    assert common.thinned(rows, "id", wanted.limit(0)).count() == 0
