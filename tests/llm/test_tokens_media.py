import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslode.llm import sentencepiece_scan, tiff, token_counts, token_files
from corpuslode.llm.queries import QUERIES

MODEL, BPE = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
PARTS = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "'s", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "你", "벨", "word", "  x", ".", "\x00", "😀", "\x1c", " ", "9"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def lzw_plain(data):
    """The codes one by one from a string of bits, with a table of tuples (prefix code, last byte)."""
    bits = "".join(f"{x:08b}" for x in data)
    at, width, out, table, before = 0, 9, [], None, None

    def spell(code):
        s = []
        while code >= 258:
            code, last = table[code - 258]
            s.append(last)
        return [code, *reversed(s)]

    while at + width <= len(bits):
        code, at = int(bits[at : at + width], 2), at + width
        if code == 257:
            break
        if code == 256:
            table, width, before = [], 9, None
            continue
        if before is not None:
            table.append((before, spell(code)[0] if code - 258 < len(table) else spell(before)[0]))
        out += spell(code)
        before = code
        width = next(w for w in (9, 10, 11, 12) if len(table) + 258 + 1 < 1 << w or w == 12)
    return bytes(out)


def packbits_plain(data):
    out, it = [], iter(data)
    for n in it:
        if n < 128:
            out += [next(it) for _ in range(n + 1)]
        elif n > 128:
            out += [next(it)] * (257 - n)
    return bytes(out)


def plain_tiff(data):
    """(form, samples) of each page of a little-endian file, byte by byte and without the module's reader."""
    u = lambda at, n: int.from_bytes(data[at : at + n], "little")
    assert data[:4] == b"II*\0"
    at = u(4, 4)
    while at:
        tags = {}
        for i in range(u(at, 2)):
            e = at + 2 + 12 * i
            assert u(e + 2, 2) == 4
            n = u(e + 4, 4)
            tags[u(e, 2)] = [u((e + 8 if n == 1 else u(e + 8, 4)) + 4 * k, 4) for k in range(n)]
        at = u(at + 2 + 12 * u(at, 2), 4)
        (w,), (h,), (how,), (predict,) = tags[256], tags[257], tags[259], tags[317]
        tiled = 322 in tags
        tw, th = (tags[322][0], tags[323][0]) if tiled else (w, tags[278][0])
        page = [[0] * w for _ in range(h)]
        places = [(x, y) for y in range(0, h, th) for x in range(0, w, tw)]
        for (x, y), o, n in zip(places, tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True):
            raw = {1: bytes, 5: lzw_plain, 8: zlib.decompress, 32773: packbits_plain}[how](data[o : o + n])
            for j in range(len(raw) // tw):
                row, left = [], 0
                for v in raw[j * tw : (j + 1) * tw]:
                    left = (v + left) % 256 if predict == 2 else v
                    row.append(left)
                for i, v in enumerate(row):
                    if y + j < h and x + i < w:
                        page[y + j][x + i] = v
        yield (how, predict == 2, tiled), bytes(v for row in page for v in row)


def test_op3(spark, sf_dir, docs):
    """The whole query against a reader of its own: payload, stored form and feature."""
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in tiff.text_media(docs, with_media=True).collect()}
    forms, several = {}, 0
    for r in QUERIES["op3_tiff"](spark, sf_dir).collect():
        raw = texts[r["doc_id"]].encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        m = media[r["doc_id"]]
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())
        found = list(plain_tiff(m)) if len(m) < 20_000 else []
        if found:
            assert b"".join(s for _, s in found) == p and r["n_pages"] == len(found)
            n = np.bincount(np.frombuffer(p, np.uint8), minlength=256)
            want = f"pages={len(found)};rows={len(p) // 576};mean={int((n * np.arange(256)).sum()) * 1000 // len(p)};shades={(n > 0).sum()};top={n.argmax()}"
            assert r["feature"] == want
        several += r["n_pages"] > 1
        for f, _ in found:
            forms[f] = forms.get(f, 0) + 1
    assert set(forms) == set(tiff.FORMS) and min(forms.values()) >= 5 and several >= 50


def test_op3_very_long_text(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(3_000_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = tiff.text_media(docs).collect()
    p = text.encode() + b"\xff" * (-len(text) % 576)
    assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["n_pages"] == -(-len(p) // 576 // tiff.PAGE_ROWS)


def damaged(tags, tail=b""):
    fields = b"".join(struct.pack("<HHII", t, 4, n, v) for t, n, v in tags)
    return b"II*\0\x08\0\0\0" + struct.pack("<H", len(tags)) + fields + b"\0\0\0\0" + tail


def test_damaged_pages_are_error_rows(spark):
    sizes = [(256, 1, 4), (257, 1, 4), (258, 1, 8), (259, 1, 1)]
    good = tiff.store_text("some text")[1]
    files = {
        "no counts": damaged([*sizes, (273, 1, 8)]),
        "empty counts": damaged([*sizes, (273, 1, 8), (279, 0, 0)]),
        "empty width": damaged([(256, 0, 0), *sizes[1:], (273, 1, 8), (279, 1, 16)]),
        "a width of zero": damaged([(256, 1, 0), *sizes[1:], (273, 1, 8), (279, 1, 16)]),
        "far too large": damaged([(256, 1, 4 * 10**9), (257, 1, 4 * 10**9), *sizes[2:], (273, 1, 8), (279, 1, 16)]),
        "large tiles": damaged([*sizes, (322, 1, 4 * 10**9), (323, 1, 4 * 10**9), (324, 1, 8), (325, 1, 8)]),
        "behind the end": damaged([*sizes, (273, 1, 8), (279, 1, 10**6)]),
        "too short": damaged([*sizes, (273, 1, 8), (279, 1, 15)]),
        "another compression": damaged([*sizes[:3], (259, 1, 7), (273, 1, 8), (279, 1, 16)]),
        "no directory": b"II*\0\xff\0\0\0",
        "cut": good[:-40],
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("null", None), ("none", bytearray(b"")), ("good", bytearray(good))], "id string, data binary")
    got = {r["id"]: r for r in tiff.pages(df, "id", "data").collect()}
    assert set(got) == {*files, "good"}
    assert got.pop("good")["error"] is None and all(r["error"] and r["samples"] is None for r in got.values())
    rng = random.Random(5)
    for _ in range(2000):  # any damage gives rows, never a crash
        b = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        list(tiff.read(bytes(b)))


def test_op3_odd(odd, nothing):
    got = tiff.text_media(odd, with_media=True)
    rows = got.collect()
    assert len(rows) == 11 and all(hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] for r in rows)
    assert len({r["media_sha256"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert {(r["n_bytes"], r["payload_bytes"]) for r in rows if r["doc_id"] in (1, 2)} == {(0, 576)}
    assert tiff.text_media(nothing).count() == 0
    pages = tiff.pages(got, "doc_id", "media")
    assert pages.where("error IS NOT NULL").count() == 0 and pages.groupBy("id").agg(F.sum(F.length("samples")).alias("n")).where("id = 9").first()["n"] == 576 * -(-150_000 // 576)


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predict", [False, True])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_forms(how, predict, tiled):
    rng = np.random.default_rng(how)
    pages = [np.repeat(rng.integers(0, 9, (300, 192), dtype=np.uint8), 3, axis=1), rng.integers(0, 256, (70, 50), dtype=np.uint8)]
    found = list(tiff.read(tiff.write([(p, how, predict, tiled) for p in pages])))
    assert [(n, w, h, s, e) for n, w, h, s, e in found] == [(i, p.shape[1], p.shape[0], p.tobytes(), None) for i, p in enumerate(pages)]


def test_tiff_packers():
    rng = random.Random(2)
    for n in [0, 1, 2, 3, 127, 128, 129, 255, 5000, 40_000]:
        for kinds in (1, 2, 256):
            data = bytes(rng.choices(range(kinds), k=n))
            assert tiff.unpack_bits(tiff.pack_bits(data), n) == data and tiff.unpack_lzw(tiff.pack_lzw(data), n) == data


def test_tiff_damage(spark):
    good = tiff.write([(np.zeros((10, 10), np.uint8), tiff.DEFLATE, False, False)])
    assert list(tiff.read(b"II*\0")) == list(tiff.read(None)) == list(tiff.read(b"no file at all")) == []
    bad = bytearray(good)
    bad[8:12] = b"\xff" * 4
    assert list(tiff.read(bytes(bad)))[0][3] is None
    files = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(bad)), (3, None)], "k long, f binary")
    assert {(r["id"], r["error"] is None) for r in tiff.pages(files, "k", "f").collect()} == {(1, True), (2, False)}


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "string", "date", "decimal(9,2)", "binary"])
def test_tiff_ids_of_any_type(spark, kind):
    files = spark.createDataFrame([("1", bytearray(tiff.encode(b"a" * 5760))), (None, bytearray(tiff.encode(b"b" * 576)))], "k string, f binary")
    files = files.selectExpr("date'2020-01-01' AS k" if kind == "date" else f"CAST(k AS {kind}) AS k", "f")
    got = tiff.pages(files, "k", "f")
    assert dict(got.dtypes)["id"] == kind and got.where("error IS NULL").count() == 4


def test_tiff_big_endian():
    """A hand-made big-endian file: short tags, two samples a pixel, no compression."""
    import struct

    tags = [(256, 3, 1, 2), (257, 3, 1, 1), (258, 3, 2, 8 << 16 | 8), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 2), (279, 4, 1, 4)]
    ifd = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">I", v) if k == 4 or n == 2 else struct.pack(">HH", v, 0)) for t, k, n, v in tags)
    data = b"MM\0*" + struct.pack(">I", 12) + bytes((1, 2, 3, 4)) + ifd + b"\0\0\0\0"
    assert list(tiff.read(data)) == [(0, 2, 1, bytes((1, 2, 3, 4)), None)]


def test_op6(spark, sf_dir, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in QUERIES["op6_token_counts"](spark, sf_dir).collect():
        t = texts[r["doc_id"]]
        n = len(sp.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)


def test_op6_odd(odd, nothing):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    count = token_counts.Counter(sp, token_counts.prove_whole(sp), cache_units=20_000)
    for t in odd_texts(4000):
        assert count(t) == len(sp.encode(t)), t
    got = token_counts.count_tokens(odd, MODEL).collect()
    assert len(got) == 11 and all((r["n_bytes"], r["n_tokens"]) == (0, 0) for r in got if r["doc_id"] in (1, 2))
    assert token_counts.count_tokens(nothing, MODEL).count() == 0


def test_op7_is_the_library():
    v = sentencepiece_scan.load(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_proto=v.as_unigram(MODEL))
    encode = sentencepiece_scan.Encoder(MODEL, cache_units=50)
    for t in odd_texts(3000, 4):
        assert encode(t).tolist() == sp.encode(t), t
        assert encode.decode(encode(t)) == t.replace("▁", " ")


def test_op7_query(spark, sf_dir, docs, monkeypatch):
    """The whole query against the library's unigram model of the same file; many documents are cut into chunks and spans here."""
    monkeypatch.setattr(sentencepiece_scan, "CHUNK", 700)
    monkeypatch.setattr(sentencepiece_scan, "SPAN", 3)
    v = sentencepiece_scan.load(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_proto=v.as_unigram(MODEL))
    score = lambda ids: int(v.score_at[ids].sum())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in QUERIES["op7_sentencepiece"](spark, sf_dir).collect()}
    coded = {r["doc_id"]: r["ids"] for r in sentencepiece_scan.encode(docs, MODEL).collect()}
    assert set(got) == set(texts) and sum(len(t) > 700 * 3 * 4 for t in texts.values()) > 3
    for d, t in texts.items():
        ids = sp.encode(t)
        if ids != coded[d]:  # the library adds up in 32 bits: in a long text it can take a path that is worse by a few units
            assert len(t) > 8000 and 0 < score(coded[d]) - score(ids) < 20
            ids = coded[d]
        assert (got[d]["n_tokens"], got[d]["ids_crc32"], got[d]["round_trip"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    assert sum(sp.encode(t) == coded[d] for d, t in texts.items()) >= 0.98 * len(texts)


def test_op7_decode_ids(spark, odd):
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    ids = sentencepiece_scan.encode(odd, MODEL).withColumn("ids ", F.lit(1))
    got = sentencepiece_scan.decode_ids(ids, MODEL, text_col="text").collect()
    assert len(got) == 11 and all(r["text"] == (text[r["doc_id"]] or "").replace("▁", " ") and r["ids "] == 1 for r in got)
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in sentencepiece_scan.decode_ids(none, MODEL).collect()} == {1: None, 2: ""}
    with pytest.raises(ValueError):
        sentencepiece_scan.decode_ids(none, MODEL, text_col="ids")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_op7_trees(n):
    """Prefix products and exit states in a tree are those of one pass."""
    rng = np.random.default_rng(n)
    k = 4
    matrices = [np.where(rng.random((k, k)) < 0.2, sentencepiece_scan.NONE, rng.integers(-9, 0, (k, k))) for _ in range(n)]
    state = np.array([0, *[sentencepiece_scan.NONE] * (k - 1)])
    at = sentencepiece_scan.entries(matrices, state)
    for m, e in zip(matrices, at, strict=True):
        assert (e == state).all()
        state = sentencepiece_scan.times(state, m)
    maps = [rng.integers(0, k, k) for _ in range(n)]
    leave, want = 2, []
    for f in reversed(maps):
        want.insert(0, leave)
        leave = int(f[leave])
    assert sentencepiece_scan.leaves(maps, 2) == want


def test_op7_products_are_associative():
    e = sentencepiece_scan.Encoder(MODEL)
    v = e.v
    text = "▁the▁word" + "ation" * 9 + "▁of▁the▁words"
    cuts = [(0, 11), (11, 37), (37, len(text))]
    a, b, c = (sentencepiece_scan.transfer(e, text[i : j + v.longest], j - i) for i, j in cuts)
    left, right = sentencepiece_scan.times(sentencepiece_scan.times(a, b), c), sentencepiece_scan.times(a, sentencepiece_scan.times(b, c))
    assert (left == right).all()
    path = sentencepiece_scan.Path(len(text))
    path.best[0] = 0
    assert left[0, 0] == path.relax(v, text, 0, len(text)).best[-1]


def test_op7_chunks_do_not_show(spark, odd, nothing, monkeypatch):
    monkeypatch.setattr(sentencepiece_scan, "CHUNK", 40)
    monkeypatch.setattr(sentencepiece_scan, "SPAN", 4)
    encode = sentencepiece_scan.Encoder(MODEL)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "the", " ", "é", "你", "word", "aaaa", "ing", "tion"]) for _ in range(rng.randint(0, 150)))) for i in range(60)]
    rows += [(500, None), (501, ""), (501, " " * 300), (None, "x" * 1000)]
    got = sentencepiece_scan.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()
    assert sorted(repr((r["doc_id"], list(r["ids"]))) for r in got) == sorted(repr((d, encode(t).tolist())) for d, t in rows)


def test_op7_odd(odd, nothing):
    got = sentencepiece_scan.encode(odd, MODEL, digest=True).collect()
    assert len(got) == 11 and {len(r["ids"]) for r in got if r["doc_id"] in (1, 2)} == {0} and {r["ids_crc32"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert sentencepiece_scan.encode(nothing, MODEL).count() == 0


def test_op8(spark, sf_dir, docs):
    tk = Tokenizer.from_file(BPE)
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = tk.encode(r["text"], add_special_tokens=False).ids + [0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op8_token_files"](spark, sf_dir).collect())) == want


def test_op8_odd(spark, odd, nothing, tmp_path, monkeypatch):
    tk = Tokenizer.from_file(BPE)
    encode = token_files.Encoder(BPE, 0, cache_parts=30)
    for t in odd_texts(4000, 6):
        assert np.frombuffer(encode(t), "<u2").tolist() == tk.encode(t, add_special_tokens=False).ids + [0], t
    monkeypatch.setattr(token_files, "PACK_BYTES", 100)
    token_files.write(odd, str(tmp_path / "a"), BPE, 0)
    got = token_files.read(spark, str(tmp_path / "a")).collect()
    assert len(got) == 11 and {tuple(r["ids"]) for r in got if r["doc_id"] in (1, 2)} == {(0,)}
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    assert len(token_files.fetch(spark, str(tmp_path / "a"), 5)) == 2 and token_files.fetch(spark, str(tmp_path / "a"), 77) == []
    token_files.write(nothing, str(tmp_path / "b"), BPE, 0)
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0
    with pytest.raises(ValueError):
        token_files.Pack(token_files.pack(2, 1, [b""]), b"another")
