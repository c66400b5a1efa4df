"""Near duplicates by SimHash, with pigeonring candidate filtering.

Fingerprints. A text's bytes with A-Z lower-cased are cut at space and the
controls 9 to 13 into words, and the words into shingles; a bit of the 64-bit
fingerprint is 1 if it is set in over half of the shingles' XXH64 values. A
text of fewer words than a shingle has one shingle, all its words; one without
a word, null included, has fingerprint zero, which links like any other.

Links. Equal fingerprints are one node. A fingerprint is a ring of four
segments of 16 bits. If two differ in at most three bits, some segment starts
a chain in which, for every length l, the first l segments differ in at most
3l/4 bits together: 0, 1, 2, 3. The first two steps are an index: a node is
found under (start, segment, next segment), and looks under the 17 forms of
its next segment that differ in at most one bit. The third step and the whole
distance are checked on what is found, and a pair counts only at the first
start that has a chain. Only different fingerprints of one exact index entry,
32 equal bits, meet.

An entry that more than ``HOT`` nodes share is not joined row by row: its nodes
are dealt into groups of ``BLOCK``, and each pair of groups is one task's work.
``links`` returns a spanning forest of what a pair of groups links. So links
never grow with the square of a group, no group is gathered whole, and none is
cut.

Similar texts. ``keep_one`` joins texts whose five-word shingle sets have a
Jaccard similarity of ``SIMILARITY`` or more. Of the five-word fingerprints of
such a pair few are within three bits, so here a text has ``RINGS`` independent
fingerprints of 48 bits of its different words (an edit changes one word, but
five shingles), a pair within three bits in any of them is a candidate, and each
candidate is then decided exactly by its shingle sets: nothing else goes, but a
pair that differs in one long run of words may be missed. Texts of equal words are
one node, so exact copies never meet. Nodes of one exact entry first meet that
entry's first node, and what this joins looks things up as one. The candidate
components that come out are then decided, each in one place: its shingle sets
travel there once, and pairs that are within three bits and not joined yet are
compared, the texts with most neighbours first, so that a large group of copies
costs little more than its size. A component of more than ``CELL`` shingles is
dealt into groups: each is decided within itself and with one text of all, and
then the texts that are still apart meet every group.

Rows have a key of their own in ``keep_one``: exactly one row of each component
stays, that of the smallest id, null ids last, whether ids repeat or are null,
and a different text under a dropped row's id stays. In ``near_duplicates`` rows
that share an id get a result each; a component without any id has none. Ties
need no rule: a component's name is its smallest document id. Texts are read
whole, whatever their length. Empty tables give empty results. Other columns may
have any names; they are not read, and pass ``keep_one`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import bounded_batches, cut, free_name, keyed, slices, tidy
from corpuslode.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS, WIDTH = 4, 16
#: Nodes of one index entry above which it is compared in blocks.
HOT = 32
#: Nodes in one block of such an entry.
BLOCK = 2048
#: Hot entries that are broadcast at most.
FEW_ENTRIES = 200_000
#: Row keys that are broadcast at most.
FEW_ROWS = 500_000
#: Words of a shingle and Jaccard similarity, in per cent, of texts that ``keep_one`` joins.
WORDS, SIMILARITY = 5, 80
#: Fingerprints of a text for ``keep_one``, and bits of a segment of theirs.
RINGS, RING_WIDTH = 4, 12
#: Shingles in a group of texts that are compared in one task.
CELL = 1 << 19
#: What a text counts beside its shingles there.
NODE = 64

_LOW = 2 * RING_WIDTH + 4  # bits of an index entry behind its key

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    rows = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in rows), np.uint64)
    count = np.concatenate([np.bincount(b, minlength=256) @ _BITS for b in h.astype("<u8").view(np.uint8).reshape(-1, 8).T])
    return int.from_bytes(np.packbits(2 * count > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each document."""
    bounded_batches(docs.sparkSession)
    d = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS string) AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, fp long")


def _segment(fp: Column, i: int, width: int = WIDTH) -> Column:
    return F.shiftrightunsigned(fp, width * (i % SEGMENTS)).bitwiseAND((1 << width) - 1)


def _differ(a: Column, b: Column, i: int, length: int) -> Column:
    """Bits in which ``length`` segments from ``i`` on differ."""
    x = a.bitwiseXOR(b)
    mask = sum(0xFFFF << (WIDTH * ((i + k) % SEGMENTS)) for k in range(length))
    return F.bit_count(x.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")))


def _chain(a: Column, b: Column, i: int) -> Column:
    """Whether each prefix of the chain that starts at segment i keeps its share of the distance."""
    found = F.lit(True)
    for length in range(1, SEGMENTS + 1):
        found = found & (_differ(a, b, i, length) <= DISTANCE * length // SEGMENTS)
    return found


def _key(i: int, segment: Column, following: Column) -> Column:
    return F.lit(i << 32).cast("long").bitwiseOR(F.shiftleft(segment, WIDTH)).bitwiseOR(following)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links between values of ``a`` and of ``b`` at most DISTANCE bits apart: enough of them to join what they join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    out = []
    right = b.view(np.uint64)
    for x in a.view(np.uint64):
        near = right[np.bitwise_count(right ^ x) <= DISTANCE]
        for y in near.tolist():
            r, s = root(int(x)), root(y)
            if r != s:
                parent[max(r, s)] = min(r, s)
                out.append((int(x), y))
    return out


def links(fps: DataFrame) -> DataFrame:
    """``fps``: different fingerprints in a column fp. Returns pairs (a, b) whose closure is that of all pairs within DISTANCE."""
    one = F.col("fp")
    entries = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _key(i, _segment(one, i), _segment(one, i + 1)).alias("key")) for i in range(SEGMENTS)])).alias("e"))
    entries = entries.select("fp", "e.*")
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"))
    # Spark sizes an explode like what goes into it, and would broadcast millions of rows: where one is joined, the join is a merge
    entries = cut(entries.join(sizes.hint("merge"), "key"), "simhash-index")
    look = [F.lit(0), *[F.lit(1 << b) for b in range(WIDTH)]]
    looks = F.flatten(F.array(*[F.array(*[_key(i, _segment(one, i), _segment(one, i + 1).bitwiseXOR(x)) for x in look]) for i in range(SEGMENTS)]))
    asked = fps.select(one.alias("a"), F.explode(looks).alias("key"))
    a, b = F.col("a"), F.col("fp")
    # the first start that has a chain
    at = F.shiftright("key", 32)
    first = F.coalesce(*[F.when(_chain(a, b, i), F.lit(i)) for i in range(SEGMENTS)])
    few = asked.join(entries.where(F.col("n") <= HOT).select("key", "fp").hint("merge"), "key").where((a < b) & (first == at)).select("a", F.col("fp").alias("b"))

    # entries that many share: those found under any of the 17 forms of a hot key meet its own fingerprints, block by block
    hot = entries.where(F.col("n") > HOT).select("key", "fp", "n")
    hot_keys, some = _hot(hot)
    if not some:
        return few
    guests = asked.join(hot_keys, "key").select("key", "n", F.col("a").alias("fp"))
    met = _blocks(hot, guests, "fp")

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = p.loc[p["own"], "fp"].to_numpy(), p.loc[~p["own"], "fp"].to_numpy()
        found = np.array(forest(np.sort(mine), np.sort(theirs)), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    many = met.groupBy("key", "p", "q").applyInPandas(compare, "a long, b long")
    return few.union(many.where("a != b"))


def _hot(entries: DataFrame) -> tuple[DataFrame, bool]:
    """The keys of entries (key, n) and whether there are any; broadcast if they are few, so that what does not look there is not shuffled, else merged."""
    keys = cut(entries.groupBy("key").agg(F.first("n").alias("n")), "simhash-hot")
    n = keys.count()
    return (F.broadcast(keys) if n <= FEW_ENTRIES else keys.hint("merge")), n > 0


def _blocks(own: DataFrame, guests: DataFrame, by: str) -> DataFrame:
    """``own`` and ``guests`` (key, n and others) dealt into groups p and q of about BLOCK rows of a key, each own group beside each group of guests."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = F.pmod(F.xxhash64(by), parts).cast("int")
    all_ = F.explode(F.sequence(F.lit(0), parts - 1))
    own = own.withColumn("p", dealt).withColumn("q", all_).withColumn("own", F.lit(True))
    guests = guests.withColumn("q", dealt).withColumn("p", all_).withColumn("own", F.lit(False))
    return own.unionByName(guests).drop("n")


def classes(prints: DataFrame) -> DataFrame:
    """``prints``: doc_id, fp. Adds component_id: the smallest doc_id that is reached over links."""
    with tidy(prints.sparkSession):
        nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
        found = components(links(nodes.select("fp")))
        roots = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
        names = roots.groupBy("root").agg(F.min("first").alias("component_id"))
        named = cut(roots.join(names, "root").select("fp", "component_id"), "simhash-named", keep=True)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id of each document."""
    return classes(cut(fingerprints(docs, id_col, text_col, shingle), "simhash-prints"))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def shingles(words: list[bytes]) -> np.ndarray:
    """The different shingles of ``WORDS`` words, as sorted unsigned values."""
    if not words:
        return np.zeros(0, np.uint64)
    rows = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in rows), np.uint64))


def ring_prints(words: list[bytes]) -> np.ndarray:
    """``RINGS`` independent fingerprints of the different words."""
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in set(words)), np.uint64)
    out = np.zeros(RINGS, np.int64)
    for r in range(RINGS if len(h) else 0):
        x = h + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[r] = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h), bitorder="little").view(np.int64)[0]
    return out & ((1 << SEGMENTS * RING_WIDTH) - 1)


def _nodes(rows: DataFrame) -> DataFrame:
    """``rows``: row, doc_id, text. One row for all texts of equal words: node (one of their rows), its fingerprints, and the rank of the row to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            same, prints = [], []
            for t in b.column("text").to_pylist():
                words = _words(t)
                same.append(xxhash.xxh3_128_digest(b" ".join(words), SEED))
                prints.append(ring_prints(words))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(same, pa.binary()), pa.array(prints, pa.list_(pa.int64()))], ["row", "doc_id", "same", "prints"])

    prints = rows.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {dict(rows.dtypes)['doc_id']}, same binary, prints array<long>")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    found = prints.groupBy("same").agg(F.min(rank).alias("rank"), F.min("row").alias("node"), F.first("prints").alias("prints"))
    return found.select("node", "rank", "prints")


def _index(nodes: DataFrame, forms: int) -> DataFrame:
    """node, and as ``at`` each of its index entries: ring, start, segment and next segment, the latter in ``forms`` forms; behind these
    _LOW bits of the other two segments and the form."""
    fp, w = F.col("fp"), RING_WIDTH
    prints = nodes.select("node", F.posexplode("prints").alias("ring", "fp"))

    def entry(i: int, form: int) -> Column:
        key = F.shiftleft(F.col("ring").cast("long"), 2).bitwiseOR(F.lit(i))
        for x in (_segment(fp, i, w), _segment(fp, i + 1, w).bitwiseXOR(F.lit(1 << form >> 1)), _segment(fp, i + 2, w), _segment(fp, i + 3, w)):
            key = F.shiftleft(key, w).bitwiseOR(x)
        return F.shiftleft(key, 4).bitwiseOR(F.lit(form))

    return prints.select("node", F.explode(F.array(*[entry(i, f) for i in range(SEGMENTS) for f in range(forms)])).alias("at"))


def _near(f: str, g: str) -> Column:
    """Whether two entries of one key have a chain: the first three segments within two bits, all within three. Only f may be in another form."""
    x, first = F.col(f).bitwiseXOR(F.col(g)), (F.col(f).bitwiseAND(F.lit(15)) > 0).cast("int")
    segment = lambda at: F.bit_count(F.shiftright(x, at).bitwiseAND((1 << RING_WIDTH) - 1))
    third, fourth = segment(4 + RING_WIDTH), segment(4)
    return (first + third <= DISTANCE * 3 // SEGMENTS) & (first + third + fourth <= DISTANCE)


def _candidates(nodes: DataFrame) -> DataFrame:
    """node and part: components of nodes (node, prints) with a chain in some ring, those of one node left out."""
    key = F.shiftright("at", _LOW)
    # nodes of one exact entry meet its first one: what this joins is one node for the rest, so a large group is looked up once
    entries = cut(_index(nodes, 1).withColumn("key", key), "copies-entries")
    star = entries.groupBy("key").agg(F.min(F.struct("node", "at")).alias("s"), F.count("*").alias("n")).where("n > 1")
    met = entries.join(star.select("key", F.col("s.node").alias("a"), F.col("s.at").alias("g")), "key")
    first = components(met.where((F.col("node") != F.col("a")) & _near("at", "g")).select("a", F.col("node").alias("b")))
    joined = nodes.join(first.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    joined = cut(joined.select("node", F.coalesce("component", "node").alias("of"), "prints"), "copies-joined")

    whole = joined.select(F.col("of").alias("node"), "prints")
    entries = _index(whole, 1).distinct().withColumn("key", key)
    entries = cut(entries.join(entries.groupBy("key").agg(F.count("*").alias("n")).hint("merge"), "key"), "copies-index")
    asked = _index(whole, RING_WIDTH + 1)
    many = max(HOT, 8 * whole.count() >> 2 * RING_WIDTH)  # a key of 2 * RING_WIDTH bits that is no exception in a large table either
    few = entries.where(F.col("n") <= many).select("key", F.col("node").alias("b"), F.col("at").alias("g"))
    few = asked.select(F.col("node").alias("a"), F.col("at").alias("f")).join(few.hint("merge"), (F.shiftright("f", _LOW) == F.col("key")) & (F.col("a") < F.col("b")) & _near("f", "g"))
    links = few.select("a", "b")
    hot = entries.where(F.col("n") > many)
    keys, some = _hot(hot)
    if some:
        guests = asked.distinct().withColumn("key", key).join(keys, "key").select("key", "n", "node", "at")
        met = _blocks(hot.select("key", "n", "node", "at"), guests, "at")
        links = links.union(met.groupBy("key", "p", "q").applyInPandas(_forest_of_entries, "a long, b long"))
    second = components(links).select(F.col("node").alias("from"), F.col("component").alias("to"))
    parts = joined.join(second, F.col("of") == F.col("from"), "left").select("node", F.coalesce("to", "of").alias("part"))
    several = parts.groupBy("part").count().where("count > 1").select("part")
    return cut(parts.join(several, "part").select("node", "part"), "copies-parts")


def _forest_of_entries(p: pd.DataFrame) -> pd.DataFrame:
    """Links between nodes of a hot entry and those who look there: enough of them to join what they join."""
    mine, theirs = p[p["own"]], p[~p["own"]]
    node, at = theirs["node"].to_numpy(), theirs["at"].to_numpy()
    first, rest, low = (at & 15 > 0).astype(np.uint8), at >> 4, (1 << (_LOW - 4)) - 1
    group, out = dict.fromkeys([*mine["node"].tolist(), *node.tolist()]), []

    def root(x: int) -> int:
        while (up := group[x]) is not None:
            x = up
        return x

    for x, f in zip(mine["node"].tolist(), (mine["at"].to_numpy() >> 4).tolist(), strict=True):
        for y in np.unique(node[first + np.bitwise_count((rest ^ f) & low) <= DISTANCE]).tolist():
            if (r := root(x)) != (s := root(y)):
                group[max(r, s)] = min(r, s)
                out.append((x, y))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _checked(mine: pd.DataFrame, theirs: pd.DataFrame, label: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what similar pairs of ``mine`` and ``theirs`` join, beyond ``label``, the component of each of ``theirs``.

    Rows (row, prints, set, label) within DISTANCE in a ring are compared by their sets, the rows with most neighbours first, and no
    pair that is joined already.
    """
    prints, sets, rows = np.stack(theirs["prints"].to_numpy()), theirs["set"].tolist(), theirs["row"].tolist()
    sizes = np.array([len(x) for x in sets])

    def near(p: np.ndarray, n: int) -> np.ndarray:
        close = (np.bitwise_count((prints ^ p).view(np.uint64)) <= DISTANCE).any(axis=1)
        return close & (100 * np.minimum(sizes, n) >= SIMILARITY * np.maximum(sizes, n))

    own = list(zip(mine["row"].tolist(), mine["prints"], mine["set"], mine["label"].tolist(), strict=True))
    order = np.argsort([-int(near(p, len(s)).sum()) for _, p, s, _ in own], kind="stable")
    out, now = [], {x: x for x in set(label.tolist()) | {c for *_, c in own}}
    for i in order.tolist():
        row, p, x, c = own[i]
        c = now[c]
        for j in np.flatnonzero(near(p, len(x)) & (label != c)).tolist():
            if label[j] == c:
                continue
            y = sets[j]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= SIMILARITY * (len(x) + len(y) - both):
                out.append((row, rows[j]))
                gone = label[j]
                label[label == gone] = c
                now = {k: c if v == gone else v for k, v in now.items()} if len(now) < 64 else _renamed(now, gone, c)
    return out


def _renamed(now: dict[int, int], gone: int, c: int) -> dict[int, int]:
    for k, v in now.items():
        if v == gone:
            now[k] = c
    return now


def _alike(nodes: DataFrame, parts: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) of similar texts within each candidate component; a shingle set travels once, but for components above CELL."""
    spark = rows.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shingles(_words(t)).view(np.int64) for t in b.column("text").to_pylist()]
            columns = [b.column("row"), b.column("part"), b.column("prints"), pa.array([len(x) + NODE for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "part", "prints", "n", "set"])

    asked = cut(parts.join(nodes, "node").select(F.col("node").alias("row"), "part", "prints"), "copies-asked")
    asked = F.broadcast(asked) if asked.count() <= FEW_ROWS else asked  # so that the texts are not shuffled
    held = cut(rows.select("row", "text").join(asked, "row").select("row", "part", "prints", "text").mapInArrow(sets, "row long, part long, prints array<long>, n long, set array<long>"), "copies-sets")
    sizes = cut(held.groupBy("part").agg(F.sum("n").alias("n"), F.min("row").alias("center")), "copies-sizes")
    cells = -(-(sizes.agg(F.sum("n")).first()[0] or 1) // CELL)
    large = sizes.where(F.col("n") > CELL).select("part", "center", F.ceil(F.col("n") / CELL).cast("int").alias("k"))
    kind = "a long, b long"

    def within(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, one in p.drop_duplicates("row").groupby("part"):
            one = one.assign(label=np.arange(len(one)))
            out += _checked(one, one, one["label"].to_numpy().copy())
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    small = held.join(F.broadcast(large), "part", "left_anti").withColumn("cell", F.pmod(F.xxhash64("part"), F.lit(cells)))
    links = small.groupBy("cell").applyInPandas(within, kind)
    if large.isEmpty():
        return cut(links, "copies-links")

    # a component of several groups: each group within itself and with one text of all, then what is still apart with every group
    dealt = held.join(F.broadcast(large), "part")  # at most one row per CELL shingles
    block = F.pmod(F.xxhash64("row"), F.col("k")).cast("int")
    inside = dealt.withColumn("g", block).unionByName(dealt.where("row = center").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("k") - 1))))
    links = cut(links.union(inside.groupBy("part", "g").applyInPandas(within, kind)), "copies-links")
    found = components(links).withColumnRenamed("node", "member")
    dealt = dealt.join(found, F.col("row") == F.col("member"), "left").withColumn("label", F.coalesce("component", "row")).drop("member", "component")
    main = dealt.groupBy("part", "label").agg(F.count("*").alias("c")).groupBy("part").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    dealt = cut(dealt.join(F.broadcast(main), "part"), "copies-dealt")  # a row per large component
    away = dealt.where("label != main")
    k = away.groupBy("part").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("j"))
    dealt = dealt.join(F.broadcast(k), "part")
    one = dealt.where("label != main").withColumn("p", F.pmod(F.xxhash64("row"), F.col("j")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("own", F.lit(True))
    other = dealt.withColumn("q", block).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("j") - 1))).withColumn("own", F.lit(False))

    def between(p: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = p[p["own"]], p[~p["own"]]
        out = _checked(mine, theirs, theirs["label"].to_numpy().copy()) if len(mine) and len(theirs) else []
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    more = one.unionByName(other).groupBy("part", "p", "q").applyInPandas(between, kind)
    return cut(links.union(more), "copies-links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of similar texts one row, that of the smallest id, with all its columns."""
    bounded_batches(docs.sparkSession)
    key = free_name("row", docs)
    with tidy(docs.sparkSession):
        whole = keyed(docs, key, "copies-rows", keep=True)
        rows = whole.select(F.col(key).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        nodes = cut(_nodes(rows), "copies-nodes")
        ranks, nodes = nodes.select("node", "rank"), nodes.select("node", "prints")
        found = components(_alike(nodes, _candidates(nodes), rows)).withColumnRenamed("node", "member")
        ranked = ranks.join(found, F.col("node") == F.col("member"), "left")
        stay = ranked.groupBy(F.coalesce("component", "node").alias("part")).agg(F.min("rank").alias("rank"))
        stay = cut(stay.select(F.col("rank.row").alias(key)), "copies-stay", keep=True)
    return whole.join(stay, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
