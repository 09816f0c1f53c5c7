"""Reads, casts and writes."""

import datetime as dt

import pytest

from seriesloom.operators import models as ml
from seriesloom.operators.calendar import detect_date_format
from seriesloom.operators.projections import resolve_features
from seriesloom.sources import SourceSpec, load_model, load_sources, save_model, write_table


def _csv(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_headers_casts_and_bad_dates(spark, tmp_path):
    path = _csv(tmp_path, "Date,Index Value\n2020-01-01,1.5\nnot a date,2\n2020-03-01,n/a\n")
    spec = SourceSpec(path, format="csv", options={"header": "true"}, date_col="date", numeric_cols=["index_value"])
    rows = load_sources(spark, {"s": spec})["s"].orderBy("date").collect()
    assert [(r.date, r.index_value) for r in rows] == [(dt.date(2020, 1, 1), 1.5), (dt.date(2020, 3, 1), None)]


def test_rename_known_or_by_position(spark, tmp_path):
    path = _csv(tmp_path, "when,what,more\n01/2020,3,x\n")
    spec = SourceSpec(path, format="csv", options={"header": "true"}, rename={"Date": "date", "CPI": "cpi"}, positional=["date", "cpi"], date_col="date", date_format="MM/yyyy")
    row = load_sources(spark, {"s": spec})["s"].first()
    assert row.asDict() == {"date": dt.date(2020, 1, 1), "cpi": "3"}


def test_years_are_years(spark, tmp_path):
    path = _csv(tmp_path, "date,gdp\n2005,1\n")
    spec = SourceSpec(path, format="csv", options={"header": "true"}, date_col="date", date_format="yyyy")
    assert load_sources(spark, {"g": spec})["g"].first().date == dt.date(2005, 1, 1)


def test_optional_sources_may_be_missing_or_empty(spark, tmp_path):
    empty = _csv(tmp_path, "date,x\n", "empty.csv")
    opts = {"format": "csv", "options": {"header": "true"}, "required": False}
    got = load_sources(spark, {"none": SourceSpec(str(tmp_path / "no.csv"), **opts), "empty": SourceSpec(empty, **opts)})
    assert got == {}
    with pytest.raises(Exception):
        load_sources(spark, {"none": SourceSpec(str(tmp_path / "no.csv"), format="csv")})


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_write_and_read_back(spark, tmp_path, format):
    df = spark.range(100).selectExpr("id", "CASE WHEN id < 60 THEN 'hot' ELSE 'cold' END AS k")
    out = str(tmp_path / "t")
    write_table(df, out, format=format, partition_by=["k"])
    back = spark.read.format(format).options(header="true").load(out)
    assert back.count() == 100 and back.filter("k = 'hot'").count() == 60
    assert {p.name for p in (tmp_path / "t").glob("k=*")} == {"k=hot", "k=cold"}


def test_model_round_trip(spark, tmp_path):
    df = spark.range(50).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(2 * id AS DOUBLE) AS y")
    model = ml.fit_forest(df, ["x"], "y", numTrees=3)
    save_model(model, str(tmp_path / "m"), features=["x"], params={"numTrees": 3}, spark=spark)
    again = load_model(str(tmp_path / "m"))
    assert again.transform(df).select("yhat").collect() == model.transform(df).select("yhat").collect()
    meta = spark.read.parquet(str(tmp_path / "m" / "meta"))
    assert {(r.kind, r.value) for r in meta.collect()} == {("feature", "x"), ("param", "3")}


def test_date_shapes(spark):
    df = spark.createDataFrame([("a", "2020-01-02"), ("a", "01/02/2020"), ("a", "2020-01-03"), ("b", "03.01.2020"), ("c", "x")], "src string, t string")
    got = {r.src: r.date_format for r in detect_date_format(df, "t", keys=["src"]).collect()}
    assert got == {"a": "YYYY-MM-DD", "b": "DD.MM.YYYY", "c": None}


def test_feature_names_resolve(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "a double, b_gold double, log_c double, d double")
    row = resolve_features(df, ["a", "b", "c", "d_oil", "x", "e"], aliases={"e": "a"}, suffixes=["_gold", "_oil"]).first()
    assert tuple(row) == (1.0, 2.0, 3.0, 4.0, 0.0, 1.0)


def test_settled_frames_forget_their_lineage(spark):
    from seriesloom.session import settled

    out = settled(spark.range(10).selectExpr("id % 3 AS k").groupBy("k").count())
    assert "Range" not in out._jdf.queryExecution().logical().toString()
    assert sum(r["count"] for r in out.collect()) == 10
