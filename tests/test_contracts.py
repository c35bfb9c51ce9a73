from datetime import date

import pytest

from weirflow.operators import contracts, trend


def test_records(spark):
    rows = [("t", "d", "s", "x"), ("", "d", "s", "x"), ("t", None, "s", "x"), ("سلام", "d", "s", " ")]
    df = spark.createDataFrame(rows, "text string, date string, source string, platform string")
    assert [r.ok for r in df.select(contracts.valid_record().alias("ok")).collect()] == [True, False, False, False]
    assert "سلام" in contracts.to_json_lines(df).collect()[3].value


def test_config():
    good = {"topic": "a", "date_range": {"start": "2024-01-01", "end": "2024-01-01"}}
    assert contracts.TopicConfig.load(good).end == date(2024, 1, 1)
    assert contracts.TopicConfig.load({"topic": "a", "date_range": {"start": "2024-01-01", "end": "auto"}}, date(2024, 5, 5)).end == date(2024, 5, 5)
    for bad in ({}, {"topic": "a"}, {"topic": "a", "date_range": {"start": "2024-02-01", "end": "2024-01-01"}}):
        with pytest.raises(ValueError):
            contracts.TopicConfig.load(bad)


def test_gates():
    card = [{"route": "a", "coverage": 0.95, "failure_rate": 0.0, "cost_per_1000": 2.0}, {"route": "b", "coverage": 0.5, "failure_rate": 0.0, "cost_per_1000": 1.0}]
    assert contracts.decision_gate(card)[0] == "a" and "b" in contracts.decision_gate(card)[1]
    assert contracts.cost_allows(1, 1, 2) and not contracts.cost_allows(1, 1.5, 2)
    assert contracts.registry_problems([{"id": 1, "n": "x"}, {"id": 1}], "id", ("n",)) == ["id 1 is repeated", "id 1: n is missing"]


def test_one_to_one_and_report(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 0.5), (2, None)], "k int, v double")
    contracts.require_one_to_one(a, b, "k")
    with pytest.raises(ValueError):
        contracts.require_one_to_one(a, b.filter("k = 1"), "k")
    with pytest.raises(ValueError):
        contracts.require_one_to_one(a, b.union(b), "k")
    assert "| 1 | 0.5000 |" in contracts.markdown("T", b.orderBy("k"))


def test_synthetic_gap(spark):
    rows = contracts.synthetic_records(spark, 2000)
    out = {(r.platform, r.project_week): r.n for r in trend.class_trend(rows, "sentiment_label", ("positive",)).collect()}
    assert out["reddit", "W02"] == 0 and out["x", "W02"] > 0
    assert rows.filter("created_at IS NULL").count() > 0
