from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslode.llm import mixing, quality_model, sentencepiece_scan
from corpuslode.llm.queries import QUERIES


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3], 300) == [50, 100, 150]
    assert mixing.targets([10, 100, 100], [3, 1, 1], 210) == [30, 90, 90]
    assert mixing.targets([0, 5], [1, 1], 5) == [0, 5] and mixing.targets([], [], 0) == []


def test_splitting_tree():
    counts = np.array([1000, 0, 7, 90])
    q = mixing.split_quotas(counts, 13, np.random.default_rng(1))
    assert q.shape == (13, 4) and (q.sum(axis=0) == counts).all() and (q >= 0).all()
    assert q.sum(axis=1).max() - q.sum(axis=1).min() <= 4


def test_op10(spark, docs):
    path = "/root/testdata/sf0.01"
    text = {r["doc_id"]: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op10_mixing"](spark, path).collect()}
    assert set(got) == set(text) and all(got[d]["size"] == len(text[d]["text"].split()) for d in got)
    sizes, taken = Counter(), Counter()
    for d, r in got.items():
        sizes[text[d]["source"]] += r["size"]
        taken[text[d]["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    names = sorted(sizes)
    goal = dict(zip(names, mixing.targets([sizes[n] for n in names], [1 + i % 3 for i in range(len(names))], sum(sizes.values())), strict=True))
    for d, r in got.items():
        assert r["source_size"] == sizes[text[d]["source"]] and r["target"] == pytest.approx(goal[text[d]["source"]])
    assert all(abs(taken[n] - goal[n]) <= 0.03 * goal[n] for n in names)
    again = {r["doc_id"]: tuple(r) for r in QUERIES["op10_mixing"](spark, path).collect()}
    assert again == {d: tuple(r) for d, r in got.items()}


def brute_mix(rows, seed=11, blocks=mixing.BLOCKS):
    """rows: (h, source, size). Times that each is taken, by the rules for one source after the other, without shards."""
    by = defaultdict(list)
    for i, (h, source, size) in enumerate(rows):
        by[source].append((h % blocks, h, size, i))
    names = sorted(by, key=lambda x: (x is None, x or ""))
    sizes = [sum(r[2] for r in by[n]) for n in names]
    out = [0] * len(rows)
    for name, n, goal in zip(names, sizes, mixing.targets(sizes, [1 + i % 3 for i in range(len(names))], sum(sizes)), strict=True):
        if not n:
            continue
        rounds = min(int(goal // n), 3)
        rest = round(goal - rounds * n)
        blocks_ = defaultdict(list)
        for r in sorted(by[name]):
            blocks_[r[0]].append(r)
            out[r[3]] += rounds
        left, open_ = rest, True
        for b in sorted(blocks_):
            if open_ and sum(r[2] for r in blocks_[b]) <= left:
                left -= sum(r[2] for r in blocks_[b])
                for r in blocks_[b]:
                    out[r[3]] += 1
                continue
            open_ = False
            for r in blocks_[b]:
                if 0 < r[2] <= left:
                    left -= r[2]
                    out[r[3]] += 1
    return out


def test_op10_brute(spark):
    """What the shards drew is what the rules say, for the whole query."""
    path = "/root/testdata/sf0.01"
    got = QUERIES["op10_mixing"](spark, path).collect()
    d = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "source", F.xxhash64(F.lit(11), "doc_id", "text").alias("h"))
    known = {r["doc_id"]: r for r in d.collect()}
    want = brute_mix([(known[r["doc_id"]]["h"], known[r["doc_id"]]["source"], r["size"]) for r in got])
    assert [r["taken"] for r in got] == [w * r["size"] for w, r in zip(want, got, strict=True)]
    assert all(len(r["shards"].split(",")) == w for w, r in zip(want, got, strict=True) if w)


def test_op10_shards(docs):
    plan = mixing.mix(docs, shards=5)
    rows = plan.rows.collect()
    assert len({(r["row"], r["turn"]) for r in rows}) == len(rows)
    per_shard = Counter(r["shard"] for r in rows)
    assert set(per_shard) == set(range(5)) and max(per_shard.values()) < 2 * min(per_shard.values())
    other = mixing.mix(docs, shards=1)
    took = lambda p: Counter(r["doc_id"] for r in p.rows.collect())
    assert took(plan) == took(other)


def test_op10_quotas_are_what_shards_hold(spark, docs):
    """Blocks of each source in each shard: those of the tree, and no block in two shards for one round."""
    plan = mixing.mix(docs, shards=7)
    blocks = plan.rows.join(docs.select("doc_id", F.xxhash64(F.lit(11), "doc_id", "text").alias("h")), "doc_id").select("s", "shard", "turn", F.pmod("h", F.lit(mixing.BLOCKS)).alias("b")).distinct().collect()
    assert len({(r["s"], r["turn"], r["b"]) for r in blocks}) == len(blocks)
    n = len({r["s"] for r in blocks})
    counts = np.array([sum(r["s"] == s for r in blocks) for s in range(n)])
    quotas = mixing.split_quotas(counts, 7, np.random.default_rng(11))
    assert all(sum(r["s"] == s and r["shard"] == k for r in blocks) == quotas[k, s] for s in range(n) for k in range(7))


def test_mixed_shards_are_partitions_in_an_order_of_their_own(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "PART_WORDS", 5000)
    out = mixing.mixed(docs, shards=5, shard_col="shard").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).collect()
    parts = defaultdict(set)
    for r in out:
        parts[r["part"]].add(r["shard"])
    assert all(len(p) == 1 for p in parts.values()) and len(parts) > 5
    order = [r["shard"] for r in sorted(out, key=lambda r: r["at"])]
    assert order == sorted(order)
    ids = [r["doc_id"] for r in sorted(out, key=lambda r: r["at"])]
    assert ids != sorted(ids)
    sources = [r["source"] for r in out if r["shard"] == 0]
    assert sources != sorted(sources, key=str)


def test_mixed_rows_of_one_id(spark):
    """Repeated rows, repeated ids and null ids: planned rows are returned rows, and no source exceeds its target."""
    rows = [(1, "a b c", "s", 0)] * 5 + [(1, "a b", "s", 1), (None, "x y z", "s", 2), (None, "x y z", "t", 3), (2, "k " * 4, "t", 4)] + [(i, "w " * 3, "u", 5) for i in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __row int")
    plan = mixing.mix(docs)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == plan.rows.count() > 0
    sizes = {r["row"]: r for r in plan.sizes.collect()}
    taken = Counter()
    for r in plan.rows.collect():
        taken[sizes[r["row"]]["target"]] += r["size"]
    assert len(sizes) == len(rows) and all(n <= t + 1 for t, n in taken.items())
    assert max(Counter(r["row"] for r in plan.rows.collect()).values()) <= 3


def test_many_copies_of_one_row(spark):
    """Copies that do not all fit: as many of them as do."""
    docs = spark.createDataFrame([(7, "a b c", "s")] * 400 + [(i, "w " * 3, "t") for i in range(1000, 1200)], "doc_id long, text string, source string")
    plan = mixing.mix(docs, weights=(1.0, 5.0))
    size = {r["doc_id"]: r for r in plan.sizes.collect()}[7]
    got = plan.rows.where("doc_id = 7").count()
    assert 0 <= size["target"] - 3 * got < 3


def test_op10_odd(odd, nothing):
    plan = mixing.mix(odd)
    sizes = plan.sizes.collect()
    assert len(sizes) == 11 and {r["size"] for r in sizes if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mixed(odd).count() == plan.rows.count() >= 1
    empty = mixing.mix(nothing)
    assert empty.sizes.count() == 0 and empty.rows.count() == 0 and mixing.mixed(nothing).count() == 0


def brute_stages(docs, labels):
    """What each stage may do, by plain rules over its own input."""
    model = quality_model.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return {r["doc_id"] for r in quality_model.score(docs, model).where(F.col("score") >= 0.3).collect()}


def test_pipeline_stages(spark, docs, sf_dir):
    from test_dedup import brute_spans
    from test_near_copies import compare

    kept = {}
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf_dir).cache()
        assert d.columns == docs.columns and dict(d.dtypes) == dict(docs.dtypes)
        kept[name] = d.collect()
    first, second, third, fourth = kept.values()
    assert {r["doc_id"] for r in first} == brute_stages(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    at = {r["doc_id"]: i for i, r in enumerate(first)}
    had, went = compare([(r["doc_id"], r["text"]) for r in first], {at[r["doc_id"]] for r in second})
    assert 0.9 * had <= went <= had
    want = brute_spans([r["text"].encode() for r in second])
    new = {r["doc_id"]: r["text"] for r in third}
    for r, (n, gone, spans, _) in zip(second, want, strict=True):
        assert 0 <= len(new[r["doc_id"]].encode()) - (n - gone) <= 6 * spans
        assert spans or new[r["doc_id"]] == r["text"]
    per = defaultdict(int)
    for r in fourth:
        assert new[r["doc_id"]] == r["text"]
        per[r["doc_id"]] += 1
    assert max(per.values()) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, d, sf_dir).collect()
    assert len(last) == len(fourth)
    encode = sentencepiece_scan.Encoder(sentencepiece_scan_model())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in last) == Counter((r["doc_id"], tuple(encode(r["text"]).tolist())) for r in fourth)


def sentencepiece_scan_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_pipeline_odd(spark, odd, nothing, tmp_path):
    labels = spark.createDataFrame([(4, 1), (5, 1), (9, 1), (10, 1)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, nothing):
        d = docs
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, str(tmp_path))
        assert set(d.columns) == {"doc_id", "ids"} and (d.count() > 0) == (docs is odd)
