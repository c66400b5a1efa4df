import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslode.llm import simhash, suffix_dedup
from corpuslode.llm.components import components
from corpuslode.llm.queries import QUERIES


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in ([w[i : i + 3] for i in range(len(w) - 2)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fingerprint)."""
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 3:
                name[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(rows))]


def test_op2_query(spark, sf_dir, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in QUERIES["op2_simhash"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    rows = [(d, brute_fingerprint(t)) for d, t in sorted(texts.items())]
    assert all(got[d]["fingerprint"] == f"{f:016x}" for d, f in rows)
    assert [got[d]["component_id"] for d, _ in rows] == brute_components(rows)


@pytest.mark.parametrize("hot", [1, 32])
def test_op2_links(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(3)
    fps = [0, (1 << 64) - 1, 7, 1 << 63]
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(8):
            fps.append(f)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
    rows = list(enumerate(fps))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(df).collect()}
    assert [got[i] for i, _ in rows] == brute_components(rows)


@pytest.mark.parametrize("few", [0, 200_000])
def test_op2_broadcasts_nothing_exploded(spark, docs, few, monkeypatch):
    """Spark sizes an explode like what goes into it: at 0.58 GB it broadcast 19 million rows of 283,076 fingerprints."""
    monkeypatch.setattr(simhash, "HOT", 0)
    monkeypatch.setattr(simhash, "FEW_ENTRIES", few)
    plans = {}

    def note(name, df):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()

    cut = simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, name, **more: note(name, df) or cut(df, name, **more))
    monkeypatch.setattr(simhash, "components", lambda links: note("links", links) or components(links))
    few_docs = docs.where("doc_id < 20")
    simhash.near_duplicates(few_docs).count()
    assert "SortMergeJoin" in plans["simhash-index"] and "BroadcastExchange" not in plans["simhash-index"]
    # only keys that were counted are broadcast
    assert "SortMergeJoin" in plans["links"] and plans["links"].count("BroadcastExchange") == (1 if few else 0)
    simhash.keep_one(few_docs).count()
    assert "SortMergeJoin" in plans["copies-index"] and "BroadcastExchange" not in plans["copies-index"]


def test_op2_odd(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 11 and all(r["fp"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and 6 not in {r["doc_id"] for r in kept.collect()}
    assert simhash.near_duplicates(nothing).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_spans(texts):
    n = suffix_dedup.LENGTH
    seen, out = {}, []
    for t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    for t in texts:
        change = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                change[i] += 1
                change[i + n] -= 1
        gone = np.cumsum(change[: len(t)]) > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def against_brute(df):
    got = sorted((tuple(r) for r in suffix_dedup.spans(df, with_spans=False).collect()), key=repr)
    rows = df.collect()
    want = sorted(((r["doc_id"], *x) for r, x in zip(rows, brute_spans([(r["text"] or "").encode() for r in rows]), strict=True)), key=repr)
    assert got == want


def test_op5_query(spark, sf_dir, docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op5_suffix_dedup"](spark, sf_dir).collect()}
    rows = docs.collect()
    assert got == dict(zip([r["doc_id"] for r in rows], brute_spans([r["text"].encode() for r in rows]), strict=True))


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdé fg") for _ in range(2000))
    rows = [
        (0, base), (1, base[100:900]), (2, "x" * 1000), (3, "x" * 150), (4, None), (5, ""), (6, base[500:700]), (7, base[500:699]), (8, "hello world. " * 60),
        (9, "zz" + base[1000:1400] + "q" * 50 + base[1100:1500]), (9, "other"), (9, "other"), (None, base[:250]), (11, base[:250]), (11, base[:250]),
    ]
    rows += [(100 + i, str(i) * 40 + base[1000:1210] + str(i * 7) * 30) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("hot", "batch"), [(20_000, 20_000), (3, 20_000), (20_000, 5), (1, 3)])
def test_op5_ways(passages, hot, batch, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    against_brute(passages)


def test_op5_long_texts_are_whole(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 300)
    rng = random.Random(9)
    a = "".join(rng.choice("abc ") for _ in range(2000))
    against_brute(spark.createDataFrame([(1, a), (2, "q" + a[:1000]), (3, a[1000:])], "doc_id long, text string"))


def test_op5_hot_passage(spark, monkeypatch):
    """A passage between texts that all differ: the segments around one gram are split by more and more of their context."""
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short, long = noise(150), noise(230)
    rows = [(i, noise(rng.randint(0, 300)) + (short if i % 2 else long) + noise(rng.randint(0, 300))) for i in range(40)]
    rows += [(100 + i, "left" * 10 + short + "r" * 60) for i in range(3)]
    against_brute(spark.createDataFrame(rows, "doc_id long, text string"))


def test_op5_names_may_clash(odd):
    names = ["__hash", "__text", "lang", "__id", "__check"]
    got = suffix_dedup.without_repeats(odd.toDF(*names), id_col="__hash", text_col="__text")
    want = suffix_dedup.without_repeats(odd).collect()
    assert got.columns == names and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want)))


def test_op5_odd(odd, nothing):
    assert suffix_dedup.spans(odd).count() == 11 and suffix_dedup.spans(nothing).count() == 0
    out = suffix_dedup.without_repeats(odd)
    assert out.columns == odd.columns
    got = out.collect()
    assert len(got) == 11 and [r["text"] for r in got if r["doc_id"] == 1] == [None] and [r["text"] for r in got if r["doc_id"] == 4] == ["one"]
    assert all(len(r["text"]) == 0 for r in got if r["doc_id"] == 10)


def test_op5_whole_characters():
    raw = "aéb".encode()
    assert suffix_dedup._whole_characters(raw, [(2, 4)]) == [(3, 4)] and suffix_dedup._whole_characters(raw, [(0, 2)]) == [(0, 1)]


def test_op5_rows_of_one_id_and_text(spark):
    rng = np.random.default_rng(8)
    texts = ["".join(map(chr, rng.integers(97, 110, n))) for n in (3000, 900, 250, 150)]
    mixed = texts[0][500:900] + texts[1][:300]
    rows = [(7, texts[0])] * 5 + [(None, texts[1])] * 4 + [(None, texts[2])] * 3 + [(9, texts[3])] * 3 + [(10, mixed), (None, mixed + "x"), (7, texts[2] + "y"), (11, None)] + [(12, "")] * 2
    against_brute(spark.createDataFrame(rows, "doc_id long, text string"))


def test_op5_grows_with_the_number_of_equal_rows(spark):
    text = "".join(map(chr, np.random.default_rng(9).integers(97, 110, 4000)))
    df = spark.range(1000).select(F.lit(5).alias("doc_id"), F.lit(text).alias("text"))
    found = suffix_dedup.find(df)
    marks = found.agg(F.max(F.size("marks")), F.count("*")).first()
    one = suffix_dedup.find(df.limit(2)).agg(F.max(F.size("marks"))).first()
    assert tuple(marks) == (one[0], 1000)
    gone = suffix_dedup.spans(df, with_spans=False).distinct().collect()
    assert [tuple(r) for r in gone] == [(5, 4000, 4000, 1, hashlib.sha256(b"").hexdigest())]
