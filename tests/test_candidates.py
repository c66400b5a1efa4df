"""Bitmaps, searches steered by them, and filters inferred from tables of queries."""

import random

import pytest

from corpuslode.operators import candidates as C
from corpuslode.operators import inference as I
from corpuslode.operators.filters import Filter, inferred, where
from corpuslode.operators.ranking import search


@pytest.fixture(scope="module")
def nodes(spark):
    rnd = random.Random(2)
    # ids of several ranges of a bitmap; null values; one value that most nodes have
    rows = [(i * 997, rnd.choice(["a", "a", "a", "a", "b", None]), rnd.randint(0, 9), [rnd.random(), rnd.random()]) for i in range(400)]
    return spark.createDataFrame(rows, "node_id long, kind string, size int, embedding array<double>")


FILTERS = [
    ([Filter("kind", "b", exact=True)], "and"), ([Filter("kind", ["a", "b"], "IN", exact=True), Filter("size", 4, "GT")], "and"), ([Filter("kind", "b", exact=True), Filter("size", 2, "LTE")], "or"),
    ([Filter("size", [1, 3], "IN"), Filter("kind", "a", exact=True), Filter("size", 1, "GTE")], "and"), ([Filter("kind", "none", exact=True)], "and"), ([], "and"), ([Filter("size", 8, "LT")], "and"),
]


@pytest.mark.parametrize(("filters", "how"), FILTERS)
def test_bitmaps_are_the_filters(nodes, filters, how):
    index = C.bitmap_index(nodes, ["kind", "size"])
    wanted = sorted(r[0] for r in where(nodes, filters, how).select("node_id").collect())
    assert sorted(r[0] for r in C.only(nodes, C.candidates(index, filters, how)).select("node_id").collect()) == wanted
    assert C.decision(index, filters, how) == (len(wanted), 400)
    found = C.steered_search(nodes, index, filters, [1.0, 0.5], 7, how)
    rows = lambda df: sorted((r["rank"], r["node_id"], r["score"]) for r in df.collect())
    assert rows(found) == rows(search(where(nodes, filters, how), [1.0, 0.5], 7))


def test_only_few_candidates_are_joined(nodes):
    index = C.bitmap_index(nodes, ["kind", "size"])
    plan = lambda f: C.steered_search(nodes, index, f, [1.0, 0.5])._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan([Filter("size", 2, "LT")]) and "LeftSemi" not in plan([Filter("size", 8, "LT")])


def test_inference_is_that_of_single_queries(spark):
    rows = [("bang", "province", "X"), ("bangkok", "province", "Bangkok"), ("ที่ดิน", "kind", "land"), ("a", "letter", "a"), ("ab", "letter", "ab"), ("", "letter", "none"), (None, "letter", "null"), ("Chiang Mai", "province", "CM")]
    phrases = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "phrase string, field string, value string, place int")
    queries = ["Land in BANGKOK", "bangbangkok", "chiang mai ที่ดิน", "ab", "b", "", None, "xchiang maix a", "a" * 2000]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    found = {}
    for q, f, v in I.infer(asked, phrases).collect():
        found.setdefault(q, {})[f] = v
    table = {p.lower(): {f: v} for p, f, v in rows if p}
    assert found == {i: w for i, q in enumerate(queries) if q and (w := inferred(q, table, ()))}


def test_given_filters_win_and_answers_are_checked(spark):
    have = spark.createDataFrame([(1, "lang", "en"), (1, "source", "s"), (2, "lang", "de")], "query_id int, field string, value string")
    given = spark.createDataFrame([(1, "lang", "fr"), (3, "lang", "es")], "query_id int, field string, value string")
    assert sorted(map(tuple, I.overridden(have, given).collect())) == [(1, "lang", "fr"), (1, "source", "s"), (2, "lang", "de"), (3, "lang", "es")]
    answers = spark.createDataFrame([(1, '{"lang": "en", "x": "en", "source": "zz"}'), (2, "no json"), (3, None), (4, '{"lang": null}'), (5, "[1]")], "query_id int, answer string")
    inventory = spark.createDataFrame([("lang", "en"), ("source", "s"), ("lang", "en")], "field string, value string")
    assert [tuple(r) for r in I.checked(answers, inventory).collect()] == [(1, "lang", "en")]


def test_search_filtered(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["en", "de", None]), rnd.choice(["s", "t", None]), rnd.randint(0, 20)) for i in range(300)]
    nodes = spark.createDataFrame(rows, "node_id int, lang string, source string, score int")
    wanted = {1: {"lang": "en"}, 2: {"lang": "en", "source": "s"}, 3: {}, 4: {"lang": "en"}, 5: {"lang": "none"}, 6: {"other": "x", "lang": "en"}}
    asked = spark.createDataFrame([(q,) for q in wanted], "query_id int")
    filters = spark.createDataFrame([(q, f, v) for q, w in wanted.items() for f, v in w.items()], "query_id int, field string, value string")
    found = sorted((r["query_id"], r["rank"], r["node_id"], r["score"]) for r in I.search_filtered(nodes, asked, filters, ["lang", "source"], "score", 4).collect())
    expected = []
    for q, w in wanted.items():
        kept = [r for r in rows if all({"lang": r[1], "source": r[2]}.get(f) == v for f, v in w.items())]
        expected += [(q, i + 1, r[0], r[3]) for i, r in enumerate(sorted(kept, key=lambda r: (-r[3], r[0]))[:4])]
    assert found == sorted(expected)
    assert I.search_filtered(nodes.limit(0), asked, filters, ["lang", "source"], "score").collect() == []
