import bisect
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from comparing import connect, rows_of, rows_of_sql
from pyspark.sql import functions as F

from corpuslode.llm import language, quality_model, quality_rules
from corpuslode.llm.common import below, share
from corpuslode.llm.queries import ORACLES, QUERIES


def test_op1_sql(spark, sf_dir):
    assert rows_of(QUERIES["op1_quality_rules"](spark, sf_dir)) == rows_of_sql(connect(sf_dir), ORACLES["op1_quality_rules"])


def brute_repeats(text):
    w = text.split()
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})


def test_op1_odd(odd, nothing):
    got = quality_rules.apply_rules(odd).collect()
    assert len(got) == 11
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[9]["n_repeat_words"] == brute_repeats("word " * 30_000) == 30_000
    assert quality_rules.apply_rules(nothing).count() == 0


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "a b c d e x b c d e x y", "a a a a a a", "a b c d e f g h a b c d e f g q", "a\nb\nb\n\n \n \na"])
def test_op1_counts(spark, text):
    r = quality_rules.measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    lines = [x for x in text.split("\n") if x.split()]
    assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(text.split()), brute_repeats(text), len(lines) - len(set(lines)))


def test_op1_order_changes_no_verdict(docs):
    counts = quality_rules.measure(docs)
    one = counts.select("doc_id", quality_rules.cascade(list(quality_rules.RULES)).isNull().alias("k")).collect()
    two = counts.select("doc_id", quality_rules.cascade(list(quality_rules.RULES)[::-1]).isNull().alias("k")).collect()
    assert sorted(one) == sorted(two)


def test_op1_plan_is_stable(spark, docs, nothing):
    """Equal plans in three runs, best value first; measured on rows from all over the table."""
    big = docs.union(docs.selectExpr("doc_id + 1000000", "concat(text, ' !')", "lang", "source", "n_chars")).repartition(3)
    for late in (False, True):
        plans = [quality_rules.plan_cascade(big, quality_rules.BASE_RULES + quality_rules.RULES, late=late, sample_rows=100) for _ in range(3)]
        assert plans[0] == plans[1] == plans[2] and len(plans[0]) == 7
        assert [m.value for m in plans[0]] == sorted((m.value for m in plans[0]), reverse=True)
    by = {m.rule.name: m for m in plans[0]}
    assert by["repeated_words"].work > by["duplicate_lines"].work > by["symbols"].work == 1 and 0 < by["few_words"].rejected < 1
    assert [m.rule.name for m in quality_rules.plan_cascade(nothing)] == sorted(r.name for r in quality_rules.RULES)
    assert quality_rules.plan_cascade(docs, ()) == []


def test_op1_keep_good(spark, sf_dir, docs, odd, nothing):
    """The rows alone: those that the whole query keeps, and nothing of a rejected row is evaluated further."""
    kept = {r["doc_id"] for r in QUERIES["op1_quality_rules"](spark, sf_dir).where("kept").collect()}
    got = quality_rules.keep_good(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == kept
    assert quality_rules.keep_good(odd.toDF("doc_id", "text", "n_words", "row", "words")).count() == 0 and quality_rules.keep_good(nothing).count() == 0
    boom = quality_rules.Rule("boom", "CASE WHEN n_words < 10 THEN raise_error('evaluated') ELSE n_repeat_words > 100 END")
    rows = spark.createDataFrame([("a b", 2), ("a b c d e f g h i j k", 11)], "text string, n_words long")
    assert rows.where(quality_rules.cascade([quality_rules.BASE_RULES[0], boom], late=True).isNull()).count() == 1


def test_op4_held_out(spark, sf_dir, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [r for r in QUERIES["op4_language"](spark, sf_dir).collect()]
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def brute_language(m, text):
    """Word by word and letter by letter, without caches or matrices."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    if not words:
        return "und", 0.0
    total = [0.0] * len(m.languages)
    for w in words:
        if w in m.words:
            logs = [m.word_logs[m.words[w]]]
        else:
            s, logs = f"^{w}$", []
            for i in range(len(s)):
                n = next((n for n in (4, 3, 2, 1) if i + n <= len(s) and s[i : i + n] in m.grams), None)
                if n:
                    logs.append(m.gram_logs[m.grams[s[i : i + n]]])
        for k in range(len(total)):
            total[k] += sum(x[k] for x in logs) / max(len(logs), 1)
    best = max(range(len(total)), key=lambda k: (total[k], -k))
    return m.languages[best], 1 / sum(math.exp(min(t - total[best], 0)) for t in total)


def test_op4_query_brute(spark, sf_dir, docs):
    """Languages and scores of the whole query from the model's tables; the tables from counts over the learning rows."""
    rows = docs.collect()
    learn = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None]
    model = language.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    counts = Counter((r["lang"], w) for r in learn for w in re.findall(r"[^\W\d_]+", r["text"].lower()))
    assert model.languages == sorted({r["lang"] for r in learn}) and set(model.words) == {w for _, w in counts}
    own = [sum(n + 0.0 for (lang, _), n in counts.items() if lang == x) + 0.5 * len(model.words) for x in model.languages]
    for (lang, w), n in list(counts.items())[:2000]:
        k = model.languages.index(lang)
        assert model.word_logs[model.words[w], k] == pytest.approx(math.log((n + 0.5) / own[k]))
    got = {r["doc_id"]: r for r in QUERIES["op4_language"](spark, sf_dir).collect()}
    for r in rows:
        lang, score = brute_language(model, r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang and got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-6)


def test_op9_query_brute(spark, sf_dir, docs):
    """Scores of the whole query, bin by bin from the model's tables."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    m = quality_model.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in QUERIES["op9_quality_model"](spark, sf_dir).collect()}
    for r in docs.collect():
        x = quality_model.features(r["text"])
        z = m.base + sum(float(t[bisect.bisect_right(e.tolist(), v)]) for e, t, v in zip(m.edges, m.tables, x, strict=True))
        for (f, g), t in zip(m.pairs, m.pair_tables, strict=True):
            z += float(t[bisect.bisect_right(m.pair_edges[f].tolist(), x[f]), bisect.bisect_right(m.pair_edges[g].tolist(), x[g])])
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)))


@pytest.mark.parametrize("n", [20_001, 10**9, 10**11, 10**15])
def test_share_of_any_table(n):
    """A share is never empty by rounding: its threshold is as far above the least hash as it should be."""
    assert (below(20_000, n) + (1 << 63)) / 2**64 == pytest.approx(20_000 / n, rel=1e-3) and below(20_000, n) > -(1 << 63)


def test_share_of_repeated_ids(spark):
    rows = spark.createDataFrame([(7, f"text {i}") for i in range(4000)], "id long, text string")
    assert 50 < share(rows, 100, F.col("id"), F.col("text")).count() < 200
    assert share(rows, 4000, F.col("id")).count() == 4000


def test_op4_odd(odd, nothing):
    model = language.fit(odd)
    got = language.predict(odd, model).collect()
    assert len(got) == 11
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"} and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert language.predict(nothing, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(nothing)).collect()} == {"und"}


def test_op4_backs_off():
    m = language.Model(["a", "b"], {"the": 0}, np.log([[0.9, 0.1]]), {"zq": 0, "z": 1}, np.log([[0.1, 0.9], [0.5, 0.5]]))
    s = language.Scorer(m, 2)
    assert s("the the")[0] == "a" and s("zqzq")[0] == "b" and s("123 ,.") == ("und", 0.0)
    assert s("zq one two three four the") == language.Scorer(m, 100)("zq one two three four the")


def test_op9_held_out(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op9_quality_model"](spark, "/root/testdata/sf0.01").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(got[d]["predicted"] == labels[d] for d in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_op9_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (9, None), (None, 1), (77, 1)], "doc_id long, quality int")
    model = quality_model.fit(odd, labels)
    assert quality_model.score(odd, model).count() == 11
    assert quality_model.score(nothing, model).count() == 0
    assert {r["score"] for r in quality_model.score(odd, quality_model.fit(odd, labels.limit(0))).collect()} == {0.5}
    kept = quality_model.keep_good(odd, model)
    assert kept.columns == odd.columns
    scores = [r["score"] for r in quality_model.score(odd, model).collect()]
    assert kept.count() == sum(s >= quality_model.THRESHOLD for s in scores)


def test_op9_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    m = quality_model.fit_rows(x[:3000], y[:3000])
    assert (0, 1) in m.pairs
    assert ((m.scores(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.9
