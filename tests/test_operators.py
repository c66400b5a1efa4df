import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslode.operators import chunking as C
from corpuslode.operators import metadata as M
from corpuslode.operators import ranking as R
from corpuslode.operators import stats as A
from corpuslode.operators.filters import Filter, by_area, by_values, configured, equal_all, inferred, section_chunks, spelled, validated, where, worth_prefiltering


@pytest.fixture(scope="module")
def deeds(spark):
    rows = [
        ("node_001", "กรุงเทพมหานคร", "บางรัก", "โฉนด", 2.5), ("node_002", "สมุทรปราการ", "บางพลี", "นส.3", 5.0),
        ("node_003", "นนทบุรี", "บางใหญ่", "โฉนด", 10.0), ("node_004", "กรุงเทพมหานคร", "วัฒนา", "นส.4", 1.0),
    ]
    return spark.createDataFrame(rows, "node_id string, province string, district string, deed_type string, area_rai double")


@pytest.mark.parametrize(
    ("filters", "how", "compat", "wanted"),
    [
        ([Filter("province", "กรุงเทพมหานคร")], "and", False, "1 4"),
        ([Filter("deed_type", "โฉนด")], "and", False, "1 3"),
        ([Filter("area_rai", 2.0, "GT")], "and", False, "1 2 3"),
        ([Filter("province", "กรุงเทพมหานคร"), Filter("deed_type", "โฉนด")], "and", False, "1"),
        ([Filter("deed_type", "โฉนด"), Filter("deed_type", "นส.3")], "or", False, "1 2 3"),
        ([Filter("area_rai", 2.5, "GT")], "and", False, "2 3"),
        ([Filter("area_rai", 2.5, "GT")], "and", True, "1 2 3"),
        ([Filter("area_rai", 2.5, "LTE")], "and", False, "1 4"),
        ([Filter("area_rai", 2.5, "LTE")], "and", True, "4"),
        ([Filter("area_rai", 2.5)], "and", False, "1"),
        ([Filter("nothing", 2.5)], "and", False, ""),
        ([Filter("area_rai", 1, "NEAR")], "and", False, ""),
        ([], "and", False, "1 2 3 4"),
    ],
)
def test_filters(deeds, filters, how, compat, wanted):
    found = sorted(r["node_id"][-1] for r in where(deeds, filters, how, compat).collect())
    assert " ".join(found) == wanted


@pytest.mark.parametrize(
    ("filters", "pushed"),
    [
        ([Filter("p_size", 7)], "EqualTo(p_size,7)"),
        ([Filter("p_size", 7.0, "GT")], "GreaterThan(p_size,7)"),
        ([Filter("p_size", 6.5, "GTE"), Filter("p_retailprice", 1000, "LT")], "GreaterThanOrEqual(p_size,7)"),
        ([Filter("p_brand", "Brand#13", exact=True)], "EqualTo(p_brand,Brand#13)"),
        ([Filter("p_brand", ["Brand#13", "Brand#14"], "IN", exact=True)], "In(p_brand"),
    ],
)
def test_filters_reach_the_scan(spark, sf_dir, filters, pushed):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    plan = where(part, filters)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan.split("PushedFilters: ")[1].replace(" ", ""), plan
    assert "cast(" not in plan


def test_spelled(spark, sf_dir):
    rows = spark.createDataFrame([("EN", 1), (" en", 2), ("de", 3), (None, 4)], "lang string, n long")
    found = spelled(rows, [Filter("lang", "En "), Filter("n", 1, "GT"), Filter("lang", ["fr", "EN"], "IN"), Filter("lang", "xx")])
    assert found[0] == found[2] == Filter("lang", [" en", "EN"], "IN", True) and found[1] == Filter("n", 1, "GT")
    assert [r["n"] for r in where(rows, found[:2]).collect()] == [2] and where(rows, found).count() == 0


def test_bounds_between_whole_numbers(spark):
    rows = spark.createDataFrame([(i, 2**53 + i) for i in range(5)], "a int, b long")
    got = lambda *f: [r["a"] for r in where(rows, [Filter(*f)]).collect()]
    assert got("a", 1.5, "GT") == got("a", 1.5, "GTE") == [2, 3, 4] and got("a", 1.5, "LT") == got("a", 1.5, "LTE") == [0, 1] and got("a", 1.5) == []
    assert got("b", 2**53 + 1) == [1] and got("b", 2**53 + 1, "GT") == [2, 3, 4]
    assert got("a", 10**12, "LT") == [0, 1, 2, 3, 4] and got("a", 10**12) == []


def test_embedding_filters(spark):
    e = spark.createDataFrame([("Bangkok", "chanote", "5 ไร่"), ("Chiang Mai", "nor_sor_3", "1 ไร่"), ("X", "other", "none")], "province string, deed_type_category string, search_text string")
    assert by_values(e, "province", ["Bangkok"]).count() == 1
    assert by_area(e, low=2).count() == 1 and by_area(e).count() == 2
    assert configured(e, deed_types=["nor_sor_3"]).count() == 1
    assert configured(e, limit=2, order="province").count() == 2
    assert equal_all(e, {"province": "Nowhere"}).count() == 0 and equal_all(e, {"province": "Nowhere"}, compat=True).count() == 3
    assert validated({"province": "Bangkok", "a": 1, "deed_type": "?"}, {"province": ["Bangkok"], "deed_type": ["chanote"]}) == {"province": "Bangkok"}
    assert inferred("Large properties in Chiang Mai", {"large properties": {"area_category": "large"}}) == {"area_category": "large", "province": "Chiang Mai"}
    assert worth_prefiltering(7, 10) and not worth_prefiltering(8, 10) and not worth_prefiltering(0, 10)
    t = spark.createDataFrame([("chunk", "plain")], "type string, chunk_type string")
    assert section_chunks(t).count() == 1


def test_extraction(spark):
    text = "Deed Type: Chanote\nProvince: Bangkok\nDistrict: Bang Kapi\nDeed Serial No: 1234\nLand Rai: 2\nDeed Total Square Wa: 200"
    d = spark.createDataFrame([(text,), ("- **Province**: X\n",), ("",)], "text string")
    got = d.select("text", *M.extract_deed(F.col("text"))).collect()
    assert (got[0]["deed_type"], got[0]["province"], got[0]["deed_total_square_wa"]) == ("Chanote", "Bangkok", 200.0)
    assert got[1]["province"] == "X" and got[2]["province"] is None
    assert d.select(*M.extract_deed(F.col("text"), compat=True)).collect()[1]["province"] == "**: X"
    first = d.limit(1).select(*M.extract_deed(F.col("text")))
    assert first.select(M.area_category(F.col("deed_total_square_wa"))).first()[0] == "small"
    assert first.select(M.document_title(first, F.lit(1))).first()[0] == "Chanote - Bangkok > Bang Kapi (#1234)"
    assert "land_deed" in d.select(M.content_types(F.col("text")).alias("c")).first()["c"]


def test_row_to_document(spark):
    rows = spark.createDataFrame([("Bangkok", "Bang Kapi", 2, "Chanote", "residential")], "province string, district string, area_rai int, deed_type string, land_use_type string")
    config = M.Config("c", [
        M.Mapping("province", "province", "location"), M.Mapping("district", "district", "location"), M.Mapping("area_rai", "area_rai", "area_measurements", "numeric"),
        M.Mapping("deed_type", "deed_type", "deed_info"), M.Mapping("land_use_type", "land_use_type", "land_details"), M.Mapping("absent", "x"),
    ])
    d = M.computed(M.map_columns(rows, config))
    r = d.select("*", M.render(d, config).alias("text"), M.document_id(d).alias("id")).first()
    assert (r["location_hierarchy"], r["area_total_sqm"], r["x"]) == ("Bangkok > Bang Kapi", 3200.0, None)
    assert r["area_formatted"].startswith("2") and r["text"].startswith("#") and r["id"].startswith("doc_")
    assert r["search_text"] == "Bangkok > Bang Kapi | 2 ไร่ | โฉนดChanote | residential"


def test_sections(spark):
    t = M.SECTION_TITLES
    text = f"# x\n## {t['deed_info']}\n" + "a" * 60 + f"\n## {t['location']}\nshort\n## {t['dates']}\n" + "one two. " * 400
    docs = spark.createDataFrame([(1, text, "12345"), (2, "no header. at all", None), (3, "", None), (4, None, None)], "doc_id long, text string, deed_serial_no string")
    got = C.section_chunks(docs).orderBy("doc_id", "chunk_index").collect()
    one = [r for r in got if r["doc_id"] == 1]
    assert (one[0]["chunk_type"], one[0]["chunk_index"], one[0]["text"]) == ("key_info", 0, "โฉนดเลขที่: 12345")
    assert [r["section"] for r in one][:2] == ["key_info", "deed_info"] and "location" not in {r["section"] for r in one}
    parts = [r for r in one if r["section"] == "dates"]
    assert len(parts) > 1 and all(r["chunk_type"] == "section_part" and r["text"].startswith(f"## {t['dates']}\n") for r in parts)
    assert [(r["chunk_type"], r["section"]) for r in got if r["doc_id"] == 2] == [("key_info", "key_info"), ("fallback", "full_document")]
    assert [r["text"] for r in got if r["doc_id"] == 3] == [C.KEY_INFO_MISSING]


def brute_pack(text, size, overlap):
    """Sentence by sentence."""
    found = [x.strip() for x in re.findall(r"[^.!?。\n]*[.!?。\n]+|[^.!?。\n]+", text or "") if x.strip()]
    out, held = [], []
    for s in found:
        k = len(s.split())
        if held and sum(len(h.split()) for h in held) + k > size:
            out.append(" ".join(held))
            tail = []
            for t in reversed(held):
                if sum(len(x.split()) for x in [t, *tail]) > overlap:
                    break
                tail.insert(0, t)
            held = tail if sum(len(x.split()) for x in tail) + k <= size else []
        held.append(s)
    return out + [" ".join(held)] if held else out


def test_packed_sentences(spark):
    rng = random.Random(3)
    texts = ["a b c. d e. f g h. i.", "", None, "one", " . . ", "A b. C!\n\nD", " ".join(rng.choice(["a", "b.", "c!", "dd\n"]) for _ in range(400))]
    texts += [" ".join(rng.choice(["a", "b.", "c d e f g h i j."]) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for size, overlap in ((5, 2), (12, 4), (3, 3), (1000, 5)):
        got = {r["i"]: r["p"] for r in df.select("i", C.packed(F.col("text"), size, overlap).alias("p")).collect()}
        for i, t in enumerate(texts):
            assert (got[i] or []) == brute_pack(t, size, overlap), (t, size, overlap)
    assert brute_pack(texts[0], 5, 2) == ["a b c. d e.", "d e. f g h.", "i."]


def test_section_chunks_need_no_shuffle(spark):
    d = spark.createDataFrame([(1, "## A\ntext")], "doc_id long, text string")
    plan = C.section_chunks(d, {"a": "A"})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1 and "Python" not in plan


def test_running_values_in_buckets(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["x", "x", "y", None]), rng.choice([None, *map(float, range(9))])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, v double")
    one = A.running_mean(df, "v", ["i"], ["g"])
    many = A.running_mean(df, "v", ["i"], ["g"], rows=40)
    assert one.columns == many.columns and sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))
    count = {r["i"]: r["n"] for r in A.running(df, {"n": F.lit(1)}, ["i"], ["g"], rows=7).collect()}
    seen = {}
    for i, g, _ in rows:
        seen[g] = seen.get(g, 0) + 1
        assert count[i] == seen[g]
    assert A.running(df.limit(0), {"n": F.lit(1)}, ["i"]).count() == 0


def test_search_in_packs(spark, monkeypatch):
    monkeypatch.setattr(R, "PACK", 7)
    rng = random.Random(2)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]
    nodes = [(i, vector()) for i in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, 2.0]), (103, [])]
    asked = [(f"q{i}", vector()) for i in range(9)] + [("none", None), ("zero", [0.0] * 3)]
    n, q = spark.createDataFrame(nodes, "node_id long, embedding array<double>"), spark.createDataFrame(asked, "query_id string, vector array<double>")

    def cos(a, b):
        norm = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else None

    want = set()
    for name, v in asked:
        s = sorted((-round(c, 6), i) for i, e in nodes if v and e and len(e) == 3 and (c := cos(v, e)) is not None)[:4]
        want |= {(name, i, -c, r + 1) for r, (c, i) in enumerate(s)}
    for limit in (1 << 23, 0):
        monkeypatch.setattr(R, "BROADCAST_VALUES", limit)
        got = {(r["query_id"], r["node_id"], r["score"], r["rank"]) for r in R.search_many(n, q, 4).collect()}
        assert {(a, b, d) for a, b, _, d in got} == {(a, b, d) for a, b, _, d in want}
    assert R.search_many(n.limit(0), q).count() == 0


def test_lexical_topk_is_filled_up(spark):
    d = spark.createDataFrame([(1, "x y"), (2, None), (3, "a b"), (4, "A"), (5, "z")], "node_id long, text string")
    q = spark.createDataFrame([(1, "a B a"), (2, ""), (3, "x")], "query_id long, query string")
    got = sorted((r["query_id"], r["rank"], r["node_id"], r["score"]) for r in R.lexical_topk(d, q, 3).collect())
    assert got == [(1, 1, 3, 1.0), (1, 2, 4, 0.85), (1, 3, 1, 0.7), (2, 1, 1, 0.7), (2, 2, 2, 0.7), (2, 3, 3, 0.7), (3, 1, 1, 1.0), (3, 2, 2, 0.7), (3, 3, 3, 0.7)]


def test_windows(spark):
    got = C.sentence_windows(spark.createDataFrame([(1, "a. b. c. d. e. f."), (2, None)], "doc_id long, text string")).orderBy("sentence_index").collect()
    assert [r["window_text"] for r in got] == ["a. b. c. d.", "a. b. c. d. e.", "a. b. c. d. e. f.", "a. b. c. d. e. f.", "b. c. d. e. f.", "c. d. e. f."]


def test_fusion(spark):
    lists = spark.createDataFrame([("a", 1, 0.9, 1), ("a", 2, 0.8, 2), ("b", 2, 0.5, 1), ("b", 3, 0.4, 2)], "list string, node_id long, score double, rank int")
    assert [r["node_id"] for r in R.fuse(lists, "rrf", 2).orderBy("rank").collect()] == [2, 1]
    assert {r["node_id"]: r["score"] for r in R.borda(lists).collect()} == {1: 2.0, 2: 3.0, 3: 1.0}
    assert {r["node_id"]: r["score"] for r in R.inverse_rank(lists).collect()} == {1: 1.0, 2: 1.5, 3: 0.5}
    assert {r["node_id"] for r in R.weighted(lists, {"a": 1.0}).collect()} == {1, 2}
    assert R.overlaps(lists).collect()[0]["both"] == 1


def test_ties_go_by_id(spark):
    n = spark.createDataFrame([(3, [0.2, 0.2]), (1, [0.1, 0.1]), (2, [1.0, 0.0])], "node_id long, embedding array<double>")
    assert [r["node_id"] for r in R.search(n, [1.0, 1.0], 3).orderBy("rank").collect()] == [1, 3, 2]


def test_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "strategy string, latency_ms double, prompt_tokens long, completion_tokens long, error string, text string, n_chars double")
    assert A.log_summary(empty).first()["success_rate"] is None
    assert A.coverage(empty, ["text"]).first()["percent"] is None
    assert A.spread(empty, "n_chars").first()["least"] is None
    assert A.accuracy(empty, F.lit(1), F.lit(1)).first()["accuracy"] == 0.0


def test_best_strategy_leaves_failures_out(spark):
    r = spark.createDataFrame([("a", 1.0, 0, 0.0, "x"), ("b", 5.0, 3, 0.5, None), ("c", 4.0, 2, 0.9, None)], "strategy string, latency_ms double, n_results int, mean_score double, error string")
    assert [A.best_strategy(r, how).first()["strategy"] for how in ("fastest", "most_results", "best")] == ["c", "b", "c"]


def test_base_windows_stay_in_their_base_chunk(spark):
    text = " ".join(f"one two three s{i}." for i in range(10))
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "a\nb. c")], "doc_id int, text string")
    got = {}
    for r in C.base_windows(docs, window=1, size=12, overlap=4).orderBy("base_index", "sentence_index").collect():
        got.setdefault((r["doc_id"], r["base_index"]), []).append((r["text"].split()[-1], r["window_text"]))
    assert {d for d, _ in got} == {1, 4}
    assert [x for x, _ in got[1, 0]] == ["s0.", "s1.", "s2."] and [x for x, _ in got[1, 1]] == ["s2.", "s3.", "s4."]
    assert got[1, 1][0][1] == "one two three s2. one two three s3."
    assert [x for x, _ in got[4, 0]] == ["a", "b.", "c"]


def test_section_rows_parse_the_longest_chunk_again(spark):
    body = "x" * 60
    chunks = spark.createDataFrame([("d", f"## A\n{body}\n## B\nshort"), ("d", "other"), ("e", None)], "doc_id string, text string")
    got = C.section_rows(chunks, titles={"a": "A", "b": "B"}).orderBy("node_id").collect()
    assert [(r["node_id"], r["section"]) for r in got] == [("d_section_0", "key_info"), ("d_section_1", "a"), ("e_section_0", "key_info")]
