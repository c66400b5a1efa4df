"""Fields in order and logs by day against plain filters, and what they leave unread."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from corpuslode.operators import range_index as R
from corpuslode.operators.filters import Filter, where
from corpuslode.sources import log_store as S


def ids(df):
    return sorted(r["node_id"] for r in df.collect())


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    # a third of the rows share one value; some have none, some are not a number
    rows = [(i, 50.0 if i % 3 == 0 else None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(i % 101) / 2, i % 7) for i in range(600)]
    nodes = spark.createDataFrame(rows, "node_id long, area double, level int").withColumn("value", F.lit("clash")).withColumn("zone", F.lit(1))
    path = str(tmp_path_factory.mktemp("ranges"))
    R.write(nodes, path, ["area", "level"], zone_rows=40)
    return nodes, path


ASKED = [Filter("area", v, o) for o in ("GT", "GTE", "LT", "LTE", "EQ") for v in (50, -1, 17.5, 17.25)]
ASKED += [Filter("level", v, o) for o in ("GT", "GTE", "LT", "LTE", "EQ") for v in (3, 2.5, 6)]
ASKED += [Filter("area", [50, 3.5, 999], "IN"), Filter("level", [], "IN"), Filter("level", [2.5], "IN")]


@pytest.mark.parametrize("compat", [False, True])
def test_comparisons(spark, indexed, compat):
    nodes, path = indexed
    for f in (f for f in ASKED if not compat or f.operator in ("GT", "LTE")):
        expected = ids(where(nodes, [f], compat_range=compat))
        assert ids(R.search(spark, path, f, compat)) == expected, f
        assert R.count(spark, path, f, compat).first()["n"] == len(expected), f


def test_together(spark, indexed):
    nodes, path = indexed
    both = [Filter("area", 20, "GT"), Filter("level", 3, "LTE")]
    for how in ("and", "or"):
        assert ids(R.where(spark, path, both, how)) == ids(where(nodes, both, how))


def test_zones_stay_shut(spark, indexed):
    _, path = indexed
    zones = spark.read.parquet(f"{path}/area/zones")
    assert zones.count() >= 10 and zones.agg(F.max("n")).first()[0] < 120  # the value of a third of the rows is in several
    row = R.count(spark, path, Filter("area", 17.5, "GT")).first()
    assert row["opened"] == 1 and row["zones"] == zones.count()
    plan = R.search(spark, path, Filter("area", 3, "LT"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(zone" in plan and "LessThan(value,3.0)" in plan


def test_no_rows(spark, tmp_path):
    R.write(spark.createDataFrame([], "node_id string, x int"), str(tmp_path), ["x"])
    assert R.search(spark, str(tmp_path), Filter("x", 1, "GT")).collect() == []
    assert R.count(spark, str(tmp_path), Filter("x", 1, "GT")).first()["n"] == 0


def test_zones_do_not_grow_in_number_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "MOST_ZONES", 12)
    nodes = spark.range(3000).selectExpr("id AS node_id", "id * 7 % 1000 AS x")
    R.write(nodes, str(tmp_path), ["x"], zone_rows=5)
    assert 8 <= len(list((tmp_path / "x" / "values").glob("zone=*"))) <= 12  # 600 before
    for f in (Filter("x", 400, "GT"), Filter("x", [3, 999], "IN"), Filter("x", 17.5, "LTE")):
        expected = ids(where(nodes, [f]))
        assert ids(R.search(spark, str(tmp_path), f)) == expected and R.count(spark, str(tmp_path), f).first()["n"] == len(expected)
    monkeypatch.setattr(R, "ZONE_ROWS", 100)  # zones that are large enough stay so
    R.write(nodes, str(tmp_path / "more"), ["x"], zone_rows=5)
    assert 20 <= len(list((tmp_path / "more" / "x" / "values").glob("zone=*"))) <= 30


DAY = 86400.0


def entries(spark, rows):
    kind = "ts double, query string, latency_ms double, prompt_tokens long, completion_tokens long, confidence double, error string"
    df = spark.createDataFrame([(t, q, 1.234, 2, None, 0.12345, None) for t, q in rows], kind)
    return df.select("*", F.lit("").alias("timestamp"), F.lit("i").alias("index"), F.lit("s").alias("strategy"))


def queries(spark, path):
    return sorted((r["query"], str(r["day"])) for r in S.read(spark, path).collect())


def test_days(spark, tmp_path):
    path = str(tmp_path / "days")
    first = [(0.0, "a"), (DAY - 0.5, "b"), (DAY, "c"), (None, "none"), (0.0, "a")]
    S.append(entries(spark, first), path, 0)
    S.append(entries(spark, first), path, 0)  # a stream repeats its batch
    S.append(entries(spark, [(1.0, "d"), (2 * DAY, "e")]), path, 1)
    S.append(entries(spark, [(2.0, "f"), (None, "none")]), path, 2)
    expected = sorted([("a", "1970-01-01")] * 2 + [("b", "1970-01-01"), ("c", "1970-01-02"), ("d", "1970-01-01"), ("e", "1970-01-03"), ("f", "1970-01-01")] + [("none", "None")] * 2)
    assert queries(spark, path) == expected
    S.compact(spark, path, file_rows=2)
    assert queries(spark, path) == expected  # merged and old folders are there together
    assert os.listdir(f"{path}/day=1970-01-01/merged=1") == ["batch=1"] and not os.path.exists(f"{path}/day=1970-01-02/merged=1")
    assert S.sweep(spark, path) == 2 and S.sweep(spark, path) == 0
    assert queries(spark, path) == expected
    S.append(entries(spark, [(2.0, "f"), (None, "none")]), path, 2)  # the newest batch once more, behind the compaction
    assert queries(spark, path) == expected
    S.append(entries(spark, [(3.0, "g")]), path, 3)
    S.compact(spark, path)
    S.sweep(spark, path)
    assert queries(spark, path) == sorted([*expected, ("g", "1970-01-01")])
    assert S.drop_days(spark, path, datetime.date(1970, 1, 2)) == 1
    assert queries(spark, path) == [("c", "1970-01-02"), ("e", "1970-01-03"), ("none", "None"), ("none", "None")]
