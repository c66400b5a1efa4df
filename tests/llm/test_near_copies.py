import random

import numpy as np

import corpus_pipeline
from corpuslode.llm import simhash


def brute_parts(rows):
    """The component of each of ``rows`` (id, text): five-word similarity of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if min(len(a), len(sets[j])) * 5 < max(len(a), len(sets[j])) * 4:
                continue
            c = len(a & sets[j])
            if 5 * c >= 4 * (len(a) + len(sets[j]) - c):
                name[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def compare(rows, kept):
    """Rows that had to go, how many of them went; no component loses all its rows, and one that keeps one row keeps the smallest id."""
    parts = brute_parts(rows)
    members = {}
    for i, p in enumerate(parts):
        members.setdefault(p, []).append(i)
    for m in members.values():
        stay = [i for i in m if i in kept]
        assert stay
        assert min(m, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) in stay
    had = len(rows) - len(members)
    return had, len(rows) - len(kept)


def test_stage_joins_five_word_copies(spark, sf_dir):
    path = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = corpus_pipeline.near_duplicates(spark, docs, path)
    assert got.columns == docs.columns
    at = {d: i for i, (d, _) in enumerate(rows)}
    had, went = compare(rows, {at[r["doc_id"]] for r in got.collect()})
    assert had >= 20 and 0.9 * had <= went <= had


def kept_rows(spark, rows):
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, at long")
    return {r["at"] for r in simhash.keep_one(df).collect()}


def test_near_copies_of_many_kinds(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.choice([2, 3, 40])):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    line = " ".join(words[:30])
    rows += [(len(rows) + i, line + " " + " ".join(rng.choice(words) for _ in range(rng.randint(8, 30)))) for i in range(60)]
    rng.shuffle(rows)
    found = {}
    for hot, block, cell in ((32, 2048, 1 << 20), (2, 8, 512)):
        for name, value in (("HOT", hot), ("BLOCK", block), ("CELL", cell)):
            monkeypatch.setattr(simhash, name, value)
        kept = found[hot] = kept_rows(spark, rows)
        had, went = compare(rows, kept)
        assert 0.9 * had <= went <= had
    assert found[32] == found[2]


def test_same_words_in_another_order(spark, monkeypatch):
    """Equal fingerprints of texts that are not similar: nothing goes but copies."""
    monkeypatch.setattr(simhash, "HOT", 4)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        rng.shuffle(words)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "end"]))]
    had, went = compare(rows, kept_rows(spark, rows))
    assert had == 40 >= went >= 34


def test_near_copies_by_row(spark):
    """Rows that repeat an id, a text or both, and null ids: exactly one row of each component stays."""
    same = "the very same text of quite a few words"
    rows = [(5, same), (5, same), (6, same), (6, "a clean text under the id of a row that goes"), (None, same), (None, "no id but a text of its own"), (None, "no id but a text of its own"), (7, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=repr)
    assert got == sorted([(5, same), rows[3], rows[5], (7, "")], key=repr)


def test_clean_text_under_the_id_of_a_copy(spark):
    rows = [(1, "text a of some words"), (2, "text a of some words"), (2, "text b, which is clean and stays")]
    got = {tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[0], rows[2]}


def test_near_copies_odd(odd, nothing):
    got = simhash.keep_one(odd.withColumnRenamed("lang", "__row"))
    assert got.columns == ["doc_id", "text", "__row", "source", "score"] and got.count() == 7
    assert simhash.keep_one(nothing).count() == 0


def test_shingles():
    assert len(simhash.shingles([])) == 0 and len(simhash.shingles([b"a", b"b"])) == 1
    assert (np.diff(simhash.shingles([b"%d" % i for i in range(9)]).astype(float)) > 0).all()
    a, b = simhash.ring_prints([b"%d" % i for i in range(200)]), simhash.ring_prints([b"%d" % i for i in range(1, 201)])
    assert len(set(a.tolist())) == simhash.RINGS and (np.bitwise_count((a ^ b).view(np.uint64)) <= 6).all() and not simhash.ring_prints([]).any()
