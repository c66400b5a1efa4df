"""Stored indexes against searches over all rows, and what they leave shut."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslode.operators import keyword_index as K
from corpuslode.operators import ranking as R
from corpuslode.operators import vector_index as V


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(K, "GROUP_DOCS", 8)
    monkeypatch.setattr(K, "FOLDERS", 3)


def test_keywords_of_all_documents(spark, sf_dir, tmp_path, small_groups):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("node_id"), "text")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id % 5 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    K.write(docs, str(tmp_path / "k"))
    assert rows(K.search(spark, str(tmp_path / "k"), asked, 3)) == rows(R.keyword_search(docs, asked, 3))
    found = K.opened(spark, str(tmp_path / "k"), asked, 3).collect()
    assert len(found) == asked.count() and all(r["opened"] <= r["blocks"] for r in found)
    assert sum(r["opened"] for r in found) < 0.8 * sum(r["blocks"] for r in found)


def test_keywords_with_ties_frequent_terms_and_odd_rows(spark, tmp_path, small_groups):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "omega", "rare" + str(i % 7)], k=rnd.randint(1, 40))) for i in range(150)]
    # a term that all documents have weighs less than nothing
    texts = [f"common {t}" for t in texts] + ["common alpha"] * 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "the of and"])], "node_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "common"), (3, "rare3 rare3 common alpha"), (4, "absent word"), (5, None), (6, "rare1")], "query_id int, query string")
    K.write(docs, str(tmp_path / "k"))
    for k in (1, 4, 1000):
        assert rows(K.search(spark, str(tmp_path / "k"), asked, k)) == rows(R.keyword_search(docs, asked, k))
    blocks = spark.read.parquet(str(tmp_path / "k" / "blocks"))
    assert blocks.groupBy("term").count().where("count > 5").count() > 0
    assert blocks.agg(F.max("docs")).first()[0] < 60


def test_search_names_its_terms_to_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha beta word{i}") for i in range(50)], "node_id long, text string")
    K.write(docs, str(tmp_path / "k"))
    asked = spark.createDataFrame([(1, "word7 word9")], "query_id int, query string")
    plan = K.search(spark, str(tmp_path / "k"), asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "In(term, [word7,word9])" in plan.replace("word9,word7", "word7,word9")


def test_empty_keyword_index(spark, tmp_path):
    docs = spark.createDataFrame([], "node_id long, text string")
    K.write(docs, str(tmp_path / "k"))
    asked = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    assert K.search(spark, str(tmp_path / "k"), asked).collect() == []


def test_vectors_of_the_table(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    nodes = e.select(F.col("vec_id").alias("node_id"), "embedding")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    V.write(nodes, str(tmp_path / "v"))
    assert rows(V.search(spark, str(tmp_path / "v"), asked)) == rows(R.search_many(nodes, asked))


def test_clustered_vectors_leave_clusters_shut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "PART_ROWS", 50)
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(20, 16))
    x = middle[rng.integers(0, 20, 900)] + rng.normal(scale=0.03, size=(900, 16))
    # a third of all rows are one vector; some have no direction, or another size
    data = [(i, v.tolist()) for i, v in enumerate([*x, *([x[0]] * 450)])]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [1.0, 2.0]), (5003, [])]
    nodes = spark.createDataFrame(data + odd, "node_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x[i * 7].tolist()) for i in range(40)] + [(99, [0.0] * 16), (98, None)], "query_id long, vector array<double>")
    V.write(nodes, str(tmp_path / "v"))
    for k in (1, 7):
        assert rows(V.search(spark, str(tmp_path / "v"), asked, k)) == rows(R.search_many(nodes.where("node_id < 5000"), asked, k))
    found = V.opened(spark, str(tmp_path / "v"), asked).collect()
    assert len(found) == 40 and sum(r["opened"] for r in found) < 0.5 * sum(r["clusters"] for r in found)
    stored = spark.read.parquet(str(tmp_path / "v" / "vectors"))
    assert stored.select(F.sum(F.size("ids"))).first()[0] == 1350 and stored.select(F.max(F.size("ids"))).first()[0] < 500
    radius = {r["cluster"]: r["radius"] for r in spark.read.parquet(str(tmp_path / "v" / "clusters")).collect()}
    assert all(0 <= r <= math.pi for r in radius.values())


def test_empty_vector_index(spark, tmp_path):
    nodes = spark.createDataFrame([], "node_id long, embedding array<double>")
    V.write(nodes, str(tmp_path / "v"))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    assert V.search(spark, str(tmp_path / "v"), asked).collect() == []


def test_words_are_counted_in_the_row(spark):
    from corpuslode.functions.keywords import counted

    given = [(["b", "a", "b", "ab", "b"],), ([],), (None,), (["x"],)]
    found = [r[0] for r in spark.createDataFrame(given, "t array<string>").select(counted(F.col("t"))).collect()]
    assert [x and [tuple(y) for y in x] for x in found] == [[("a", 1), ("ab", 1), ("b", 3)], [], None, [("x", 1)]]


def test_postings_are_shuffled_once_at_most(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("node_id"), "text")
    whole = rows(R.postings(docs).withColumn("weight", F.round("weight", 9)))
    monkeypatch.setattr(R, "FREQUENT", 3)
    found = R.postings(docs)
    # no shuffle deals postings out to count them
    assert "node_id" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x)
    assert rows(found.withColumn("weight", F.round("weight", 9))) == whole


def test_blocks_of_a_folder_are_the_work_of_several_tasks(spark, sf_dir, tmp_path, small_groups, monkeypatch):
    monkeypatch.setattr(K, "TASK_TOKENS", 20_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("node_id"), "text")
    K.write(docs, str(tmp_path / "k"))
    blocks = spark.read.parquet(str(tmp_path / "k" / "blocks"))
    assert max(len(list((tmp_path / "k" / "blocks").glob(f"folder={i}/*.parquet"))) for i in range(3)) > 1  # one for each folder before
    assert blocks.groupBy("term", "g").count().where("count > 1").count() == 0


def test_no_row_holds_all_queries_and_batches_are_small(spark, tmp_path, monkeypatch):
    from pyspark.sql import SparkSession

    monkeypatch.setattr(V, "PACK", 16)
    monkeypatch.setattr(V, "STEP", 5)
    monkeypatch.setattr(V, "BOUNDS", 40)
    x = np.random.default_rng(3).normal(size=(300, 8))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, embedding array<double>")
    asked = nodes.where("node_id % 2 = 0").selectExpr("node_id AS query_id", "embedding AS vector")
    path = str(tmp_path / "v")
    V.write(nodes, path)
    largest: list[int] = []
    run = type(nodes).mapInArrow

    def seen(self, f, schema, *more):
        if "qv" in self.columns:
            largest.append(self.agg(F.max(F.size("qs"))).first()[0])
        return run(self, f, schema, *more)

    monkeypatch.setattr(type(nodes), "mapInArrow", seen)
    found = rows(V.search(spark, path, asked))
    monkeypatch.setattr(type(nodes), "mapInArrow", run)
    assert max(largest) < 40  # 150 before
    assert found == rows(R.search_many(nodes, asked))
    bounds = SparkSession.getActiveSession().conf
    assert int(bounds.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 and bounds.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4194304b"
