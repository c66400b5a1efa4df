"""Periodic runs against a definition by hand: every period, every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from corpuslode.llm import periodic_runs as P
from corpuslode.llm.queries import QUERIES, planted


def brute(w, least=P.LEAST):
    """(start, length, smallest period) of each run."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("least", [2, 5, 12, 30])
def test_random_arrays(least):
    rnd = random.Random(least)
    for _ in range(400):
        codes, wanted = [], []
        for t in range(rnd.randint(1, 4)):
            w = [rnd.randint(0, rnd.randint(0, 4)) for _ in range(rnd.randint(0, 90))]
            for _ in range(rnd.randint(0, 3)):
                if w:
                    s, p, n = rnd.randrange(len(w)), rnd.randint(1, 20), rnd.randint(1, 60)
                    w[s : s + n] = (w[s : s + p] * n)[: len(w[s : s + n])]
            wanted += [(s + len(codes), s + n + len(codes), q) for s, n, q in brute(w, least)]
            codes += [10 * t + x for x in w] + [1000 + t]
        assert sorted(zip(*[x.tolist() for x in P.runs(np.array(codes), least)], strict=True)) == sorted(wanted)


@pytest.mark.parametrize("w", [[1] * 5000, [1, 2] * 2500, ([1, 2] * 20 + [1]) * 30, list(range(700)) * 4, [1, 1, 2, 1, 1, 2, 1] * 300], ids=range(5))
def test_long_runs(w):
    start, end, q = P.runs(np.array([*w, -1]))
    assert list(zip(start.tolist(), (end - start).tolist(), q.tolist(), strict=True)) == brute(w)


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    values = rng.permutation(1000)[:700]
    tree = P.WaveletMatrix(values, 10)
    low = rng.integers(0, 700, 300)
    high = np.minimum(700, low + rng.integers(1, 400, 300))
    x = rng.integers(0, 1000, 300)
    c = tree.smaller(low, high, x)
    assert c.tolist() == [(values[a:b] < v).sum() for a, b, v in zip(low, high, x, strict=True)]
    i = rng.integers(0, high - low)
    assert tree.nth(low, high, i).tolist() == [np.sort(values[a:b])[k] for a, b, k in zip(low, high, i, strict=True)]


def words_of(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def test_whole_query(spark, sf_dir, docs):
    found = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    texts = docs.select("doc_id", "text").collect()
    assert len(found) == len(texts)
    with_runs = 0
    for doc_id, text in texts:
        w, r = words_of(doc_id, text), found[doc_id]
        runs = brute(w)
        with_runs += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        wanted = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == wanted
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert with_runs > 10


def test_odd_rows(odd):
    rows = {(r["doc_id"], r["n_words"]): r for r in P.periodic_runs(odd).collect()}
    assert [(r.start, r.length, r.period) for r in rows[9, 30_000]["runs"]] == [(0, 30_000, 1)] and rows[9, 30_000]["collapsed"] == "word"
    assert rows[1, 0]["runs"] == [] and rows[1, 0]["collapsed"] == "" and rows[2, 0]["collapsed"] == "" and rows[3, 0]["collapsed"] == ""
    assert rows[None, 4]["collapsed"] == "no id at all"
    assert P.periodic_runs(odd).count() == odd.count()
    assert planted(odd).count() == odd.count()


def test_empty_table(nothing):
    assert P.periodic_runs(nothing).collect() == []


def test_a_long_text_is_a_group_of_its_own():
    assert list(P.groups(np.array([5, 900, 5, 5]), 10)) == [(0, 1), (1, 2), (2, 4)]
    assert list(P.groups(np.array([], dtype=np.int64))) == []
