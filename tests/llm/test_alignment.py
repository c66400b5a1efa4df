"""Alignment against the libraries on whole texts and plain sets of ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from corpuslode.llm import alignment as A
from corpuslode.llm.queries import QUERIES

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_common_ends():
    rnd = random.Random(5)
    for _ in range(3000):
        a, b = (sorted(rnd.sample(range(80), rnd.randint(0, 40))) for _ in range(2))
        x, y = A.common_ends(np.array(a, np.int64), np.array(b, np.int64))
        assert list(zip(x.tolist(), y.tolist(), strict=True)) == [(a.index(v), b.index(v)) for v in sorted(set(a) & set(b))]


def test_gallop_from_a_start():
    rng = np.random.default_rng(2)
    for _ in range(200):
        long = np.unique(rng.integers(0, 500, 100))
        short = rng.integers(0, 510, 50)
        place = np.searchsorted(long, short)
        assert A.gallop(short, long, (place * rng.random(50)).astype(np.int64)).tolist() == place.tolist()


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def decoded(libraries, text):
    """Both libraries' ids and bytes of a whole text, without cutting it."""
    a, b = libraries
    # fixed: the byte-level alphabet
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
    x = a.encode(" " + text, add_special_tokens=False).ids
    y = b.encode(text)
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return x, [bytes(table[c] for c in a.id_to_token(i)) for i in x], y, [piece(i) for i in y]


def brute(libraries, texts):
    """Of each text n_a, n_b, groups and links, by a walk along the bytes."""
    found = []
    for t in texts:
        x, xb, y, yb = decoded(libraries, t) if t else ([], [], [], [])
        if not t or b"".join(xb) != (" " + t).encode() or b"".join(yb) != (" " + t).encode():
            found.append((0, 0, [], []))
            continue
        groups, links, i, j, left, right, begin = [], [], 0, 0, 0, 0, (0, 0)
        while i < len(x) or j < len(y):
            if left <= right:
                left, i = left + len(xb[i]), i + 1
            else:
                right, j = right + len(yb[j]), j + 1
            if left == right:
                groups.append((x[begin[0] : i], y[begin[1] : j]))
                links.append((x[i - 1], y[j - 1]))
                begin = (i, j)
        found.append((len(x), len(y), groups, links))
    return found


def expected(libraries, texts):
    each = brute(libraries, texts)
    counts = Counter(p for e in each for p in e[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for n_a, n_b, groups, links in each:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_whole_query(spark, sf_dir, docs, libraries):
    texts = dict(docs.select("doc_id", "text").collect())
    wanted = dict(zip(texts, expected(libraries, texts.values()), strict=True))
    found = QUERIES["op13_alignment"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        assert tuple(r[c] for c in COLUMNS) == wanted[r["doc_id"]]


ODD = [
    "a  b", " a", "  ", " ", "\n", "a\n b", "a \n b", "a\t\tb  \n", "x<|endoftext|>y <s> </s>", "▁", "a ▁b", "日本語 텍스트", "é́   b", "　 a", "a  b",
    "\x00", "it's 123 !!!  ok", "😀😀 x", "a \x1c b", "a\u0085 b", "word\n\n  next", "Ġ <0x41> Ċ", "trailing ", "…  …", "x" * 700,
]


def test_odd_texts(spark, libraries):
    rnd = random.Random(9)
    texts = [*ODD, *("".join(rnd.choice([*"ab. \n\t'1é", "  ", " the", "<s>", "▁", "日"]) for _ in range(rnd.randint(1, 30))) for _ in range(400)), None, ""]
    texts += texts[:40]
    df = spark.createDataFrame([(None if i % 7 == 0 else i % 50, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pairs string")
    wanted = Counter(expected(libraries, texts))
    aligned = A.align(df, *PATHS).cache()
    for most in (0, A.BROADCAST_PAIRS):
        rows = A.with_counts(aligned, A.pair_counts(aligned), most).collect()
        assert Counter((*(r[c] for c in COLUMNS[:-1]), hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in rows) == wanted
    aligned.unpersist()


def test_a_full_cache_starts_anew(libraries):
    small = A.Aligner(*PATHS, cache_chars=10)
    texts = ["one two three", "four five", "one six " * 20, None, ""]
    found = [small.batch([t]) for t in texts]
    assert [tuple(f[0][0].tolist()) for f in found] == [(a, b, len(g)) for a, b, g, _ in brute(libraries, texts)]
    assert small.held < 120


def test_odd_rows_and_empty_table(odd, nothing):
    found = A.aligned_with_counts(odd, *PATHS)
    assert found.count() == odd.count()
    assert A.aligned_with_counts(nothing, *PATHS, digest=True).collect() == []
