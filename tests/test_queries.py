"""Each registered query of the library against its SQL, over whole tables."""

import pytest
from comparing import connect, rows_of, rows_of_sql

import corpuslode.plans.catalog  # noqa: F401
from corpuslode.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    found = rows_of(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        assert found == rows_of_sql(duck, ORACLES[name])
    else:
        assert found[1]


def test_text_search_asks_every_passage(spark, sf_dir):
    asked = {r["item_id"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    found = QUERIES["u1_text_search"](spark, sf_dir).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == dict.fromkeys(asked, 5) and len(asked) == 40


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "node_id", "score", "rank"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
