import datetime

import pytest
from pyspark.sql import functions as F

from corpuslode.operators import ranking as R
from corpuslode.plans import control as K
from corpuslode.sources import files as S
from corpuslode.sources import tables as T
from corpuslode.streaming.logs import to_parquet, windowed


def test_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes("province,deed_no,owner_date,price\nกรุงเทพ,12,25/09/2567,1.5\nนนทบุรี,13,26/09/2567,2\n".encode())
    assert T.probe_encoding(spark, str(p)) in T.ENCODINGS
    df = T.read_csv(spark, str(p), "utf-8")
    assert df.count() == 2
    profile = {r["column"]: r for r in T.profile(df).collect()}
    assert profile["province"]["distinct"] == 2 and profile["price"]["nulls"] == 0 and profile["deed_no"]["examples"] == ["12", "13"]
    config = T.infer_config(df, "c")
    kinds = {m.column: (m.field_type, m.data_type) for m in config.mappings}
    assert kinds == {"province": ("location", "string"), "deed_no": ("identifier", "integer"), "owner_date": ("dates", "date"), "price": ("financial", "numeric")}
    assert T.config_from_json(T.config_to_json(config)) == config
    bad = T.read_csv(spark, str(p), "utf-8", "province string, deed_no int, owner_date date, price int")
    assert len(T.failed_rows(bad).collect()) == 2


def test_columns_by_one_aggregation(spark, tmp_path):
    rows = [("25/09/2567", "1", "1.5", "", None, "x"), ("2024-01-02", "-7", "2", " ", None, "1"), ("20240103", "30", "1e3", "", None, "2"), ("no date", "4", "5", "", None, "")]
    df = spark.createDataFrame(rows, "owner_date string, deed_no string, `Land Value` string, blank string, nothing string, `my name` string").withColumn("whole", F.lit(3)).withColumn("list", F.array(F.lit(1)))
    found = {r["column"]: r for r in T.analyzed(df).collect()}
    assert {c: r["data_type"] for c, r in found.items()} == {"owner_date": "date", "deed_no": "integer", "Land Value": "numeric", "blank": "string", "nothing": "string", "my name": "string", "whole": "integer", "list": "string"}
    assert {c: r["n"] for c, r in found.items()} == {"owner_date": 4, "deed_no": 4, "Land Value": 4, "blank": 0, "nothing": 0, "my name": 3, "whole": 4, "list": 4}
    for c, r in found.items():
        kind, confidence = T.score_name(c)
        assert (r["field_type"], r["confidence"]) == (kind, round(confidence, 6))
        assert r["key"] == T.suggest_key(c, T.METADATA_KEYS.get(kind, ()))


def test_name_scores():
    assert T.score_name("land_id")[0] == "identifier" and T.score_name("zzz") == ("other", 0.1)
    assert T.suggest_key("Deed Type", ("deed_type",)) == "deed_type" and T.suggest_key("My Column", ()) == "my_column"


def test_markdown(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "# A\nProvince: Bangkok", "Bangkok", {"province": "Bangkok"}), ("d2", "# B", None, {})], "doc_id string, text string, province string, metadata map<string,string>")
    S.write_markdown(docs, str(tmp_path / "md"))
    assert len(list((tmp_path / "md").glob("*/*/*.txt"))) == 2  # a file for each document
    folders = {(r["folder"], r["document"], r["text"]) for r in S.read_markdown_folders(spark, str(tmp_path / "md")).collect()}
    assert folders == {("Bangkok", "d1", "# A\nProvince: Bangkok"), ("unknown", "d2", "# B")}
    back = S.read_markdown(spark, str(tmp_path / "md" / "*" / "*" / "*.txt"))
    assert back.count() == 2 and {r["fields"]["province"] for r in back.collect()} == {"Bangkok", None}
    assert {r["batch_number"] for r in S.in_batches(back, 1).collect()} == {1, 2}
    S.write_jsonl(docs, str(tmp_path / "jsonl"), ["province"])
    rows = spark.read.json(str(tmp_path / "jsonl")).orderBy("id").collect()
    assert rows[0]["embedding_priority_fields"]["province"] == "Bangkok"
    assert S.markdown_index(docs).where("province = 'Bangkok'").first()["n"] == 1


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    e = spark.createDataFrame([("n1", [1.0, 2.0], 1, "chunk"), ("n2", [1.0, 2.0], 2, "summary"), ("n3", [1.0], 10, "chunk")], "node_id string, embedding array<double>, batch_number int, type string")
    S.write_snapshot(e.limit(1), path, "20240101")
    S.write_snapshot(e, path, "20240201")
    assert [r[0] for r in S.snapshots(spark, path).collect()] == [20240101, 20240201]
    assert S.read_snapshot(spark, path).count() == 3
    assert S.read_snapshot(spark, path, ["chunk"]).count() == 2
    assert S.read_snapshot(spark, path, ["chunk"], batch=10).first()["node_id"] == "n3"
    assert S.read_snapshot(spark, path, stamp="20240101").count() == 1


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("t", float(i), f"q{i}", "i", "vector", 1.239, 5, 7, None, 0.12345, None) for i in range(3)]
    S.append_log(spark.createDataFrame(rows, S.LOG_SCHEMA), path)
    (tmp_path / "log" / "bad.json").write_text("{not json\n")
    got = S.read_log(spark, path, 2).collect()
    assert [r["query"] for r in got] == ["q2", "q1"] and got[0]["latency_ms"] == 1.24 and got[0]["confidence"] == 0.123 and got[0]["total_tokens"] == 12
    assert S.kept_log(S.read_log(spark, path), 1, F.timestamp_seconds(F.lit(86401.5))).count() == 1
    S.compact_log(spark, path, str(tmp_path / "small"))
    assert S.read_log(spark, str(tmp_path / "small")).count() == 3


def test_strategy_rules():
    assert K.select_strategy("โฉนดที่ดินในกรุงเทพ", K.PRIORITY) == "metadata"
    assert K.select_strategy("โฉนด", K.PRIORITY) == "hybrid"
    assert K.select_strategy("Show all", ["summary", "vector"]) == "vector"
    assert K.select_strategy("compare things", ["recursive", "hybrid"], K.GENERIC_RULES) == "recursive"
    assert K.select_strategy("x", ["odd"]) == "odd" and K.select_strategy("x", []) == "vector"
    got = K.parse_selection("STRATEGY: Hybrid Search\nCONFIDENCE: 7\nREASONING: r", ["vector", "hybrid"], "q")
    assert got == {"strategy": "hybrid", "confidence": 0.8, "method": "llm_partial_match"}
    assert K.parse_selection("nothing", ["vector"], "q")["method"] == "llm_fallback_heuristic"

    def broken(_):
        raise RuntimeError("no model")

    assert K.choose_strategy("q", ["vector"], broken)["confidence"] == 0.2
    assert K.classify_index("land deeds", {"a": "land deeds of bangkok", "b": "salaries of people"}, broken)["selected_index"] == "a"
    assert K.classify_index("x", {"a": "", "b": ""}, lambda q: "zzz") == {"selected_index": "a", "confidence": 0.3, "method": "llm_fallback"}
    assert K.decompose("q") == [{"question": "q", "purpose": "original", "priority": 1}]
    assert [s["question"] for s in K.decompose("q", lambda q: [{"question": "b"}, {"question": "a", "priority": 1}])] == ["a", "b"]


def test_cache():
    now = [0.0]
    c = K.TTLCache(2, 10, lambda: now[0])
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.get("b") is None and c.get("a") == 1
    now[0] = 11
    assert c.get("a") is None and c.stats()["hit_rate"] == 0.5


def test_router(spark):
    n = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "node_id long, embedding array<double>")
    r = K.Router({"main": "land deeds"})
    with pytest.raises(ValueError):
        r.query("x")
    r.add_retriever("main", "vector", lambda q, k: R.search(n, [1.0, 0.1], k))
    first = r.query("what is it", 1)
    assert first[0]["node_id"] == 1 and first == r.query("What is it ", 1) and r.cache.hits == 1
    r.add_retriever("main", "hybrid", lambda q, k: spark.sql("SELECT * FROM nowhere"))
    r.remove_retriever("main", "vector")
    assert r.query("other") == [] and r.log[-1]["error"]
    assert K.synthesize(["a", "b"]).endswith("a\n\nb") and K.synthesize([]) == "No relevant information found."


def test_plan(spark):
    n = spark.createDataFrame([(1, "a b"), (2, "b c")], "node_id long, text string")
    found = K.plan_and_execute("alpha beta", lambda asked: R.top(n.crossJoin(asked).withColumn("score", F.lit(1.0)), 5, by=["query_id"]), spark, 5.0, lambda q: [{"question": "x"}, {"question": "y"}], 1)
    assert sorted((r["query_id"], r["node_id"]) for r in found.collect()) == [(0, 1), (1, 1)]


def test_stream_leaves_late_rows_out(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, strategy string, latency_ms double, error string"
    src = str(tmp_path / "in")
    spark.createDataFrame([(at(1), "a", 1.0, None), (at(1, 30), "a", 2.0, "x"), (at(9), "a", 1.0, None)], schema).coalesce(1).write.parquet(src)
    for _ in range(2):
        to_parquet(windowed(spark.readStream.schema(schema).parquet(src), "strategy"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        spark.createDataFrame([(at(1), "a", 9.0, None), (at(20), "a", 1.0, None)], schema).coalesce(1).write.mode("append").parquet(src)
    got = {r["window_start"].hour: (r["n"], r["errors"], r["mean_ms"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == (2, 1, 1.5)
