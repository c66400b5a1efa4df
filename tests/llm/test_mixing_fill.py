import random

import pytest
from pyspark.sql import functions as F

from corpuslode.llm import mixing


@pytest.mark.parametrize("gather", [50_000, 200])
def test_fill_goes_on_behind_long_documents(spark, gather, monkeypatch):
    """Long documents in the way: each source ends short of its target by less than the smallest document it leaves out."""
    monkeypatch.setattr(mixing, "GATHER", gather)
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(1, 9), f"s{i % 6}") for i in range(6 * 700)]
    rows += [(10_000 + i, "w " * 20_000, f"s{i % 6}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    plan = mixing.mix(docs, seed=3)
    taken = {r["doc_id"]: r["n"] for r in plan.rows.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    sizes = {r["doc_id"]: r for r in plan.sizes.collect()}
    for s in range(6):
        ids = [i for i, _, source in rows if source == f"s{s}"]
        got = sum(sizes[i]["size"] * taken.get(i, 0) for i in ids)
        whole = min(taken.get(i, 0) for i in ids)
        goal = sizes[ids[0]]["target"]
        out = [sizes[i]["size"] for i in ids if taken.get(i, 0) == whole]
        assert goal - got < min(out) + 1 and got <= goal + 1
