"""Mixing sources to target weights by permuted blocks and a multivariate-hypergeometric splitting tree.

Targets. The sources, by code point with null last, have given weights and
share the wanted total in their proportion; a source stops at ``MAX_REPEATS``
times its size, and what it leaves goes to the others by weight until none is
above.

Blocks. A hash of (seed, id, text) deals each source's rows into at most
``BLOCKS`` blocks in a random order. A mix takes a source whole as many times
as its target holds it, and of one further round the first blocks in that
order up to the target. Of all other blocks, in the order of blocks and hashes,
each document that still fits is taken, so a source ends short of its target by
less than the smallest document that it leaves out; what fitted of a block
counts as one block.

Shards. These block counts are the sources' quotas. A tree recursively splits
them exactly among the output shards: each node divides its shards in halves
and draws how many blocks of each source go left from the multivariate
hypergeometric distribution. Each shard then draws as many blocks as its quota
says from a permutation of the source's blocks, disjoint from those of all
other shards, and what it drew is what is taken. In ``mixed`` each shard is a
run of output partitions of its own, as many as its words need, and its rows
are shuffled among them.

Only sizes by source, words by shard and quotas pass through the driver, as
weights do: a row per source and shard. Null text has size 0 and null sources
form one source. A source of size 0 has target 0 and none of it is taken.
Documents of size 0 are taken as the blocks they are in. Rows are told apart by
a key of their own, so rows with repeated or null ids are planned and taken one
by one; copies of one row, however many, are counted and taken by number. Texts
are read whole, whatever their length. An empty table gives an empty mix. Other
columns may have any names: ``mix`` does not read them, ``mixed`` passes them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslode.llm.common import cut, free_name, keyed, tidy

MAX_REPEATS = 3
BLOCKS = 65_536
#: Different documents of a source that one task tries one by one; of more, blocks are summed first.
GATHER = 50_000
WEIGHTS = (1.0, 2.0, 3.0)
SHARDS = 64
#: Words in one partition of a shard.
PART_WORDS = 20_000_000


def targets(sizes: list[int], weights: list[float], total: float, most: float = MAX_REPEATS) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size."""
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0 and weights[i] > 0]
    left = float(total)
    while open_ and left > 0:
        per = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if per * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in full]
    return out


def split_quotas(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); the columns add up to ``counts``."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    # as many blocks on the left as its part of the shards
    take = total * left // shards
    drawn = rng.multivariate_hypergeometric(counts, take, method="marginals") if total else counts * 0
    return np.concatenate([split_quotas(drawn, left, rng), split_quotas(counts - drawn, shards - left, rng)])


@dataclass
class Mix:
    """``sizes``: each row with its key, id, size and its source's size and target. ``rows``: what the shards drew, one row per
    row key and round, with its shard, its random place there (0 to 2^63) and its output partition; ``parts``: how many of these."""

    sizes: DataFrame
    rows: DataFrame
    parts: int


def _fill(sized: DataFrame, found: DataFrame) -> DataFrame:
    """(s, block, h, size, m, n): behind the whole blocks, in the order of blocks and hashes, each that fits what is left is taken.

    Copies of one document are one row here: n of them, of which m fit. A round
    takes, of the documents no larger than what is left, the blocks that fit
    whole and tries those of the next block one by one. It goes on behind that
    block, until no document that follows fits. Where at most ``GATHER``
    documents of a source still fit, one task tries them all.
    """
    spark = sized.sparkSession
    edges = found.groupBy("s", "rest").agg(F.max(F.when(F.col("whole"), F.col("block"))).alias("at"), F.coalesce(F.max(F.when(F.col("whole"), F.col("upto"))), F.lit(0)).alias("used"))
    # a row per source: the block behind which it goes on and the words that are left
    state = {r["s"]: (-1 if r["at"] is None else r["at"], r["rest"] - r["used"]) for r in edges.collect()}
    state = {s: x for s, x in state.items() if x[1] > 0}
    order = Window.partitionBy("s").orderBy("block")
    kind = "s int, block long, h long, size long, m long, n long"

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["block", "h", "size"])
        left, take = int(p["left"].iloc[0] - p["before"].iloc[0]), []
        for size, n in zip(p["size"].tolist(), p["n"].tolist(), strict=True):
            take.append(min(n, left // size))
            left -= size * take[-1]
        p = p.assign(m=np.array(take, np.int64))
        return p.loc[p["m"] > 0, ["s", "block", "h", "size", "m", "n"]]

    def goes_on(units: DataFrame) -> DataFrame:
        now = F.broadcast(spark.createDataFrame([(s, *x) for s, x in state.items()], "s int, at long, left long"))
        return units.join(now, "s").where("block > at AND size > 0 AND size <= left")

    if not state:
        return spark.createDataFrame([], kind)
    taken = None
    sized = cut(goes_on(sized).groupBy("s", "block", "h", "size").agg(F.count("*").alias("n")), "mix-fill")
    while state:
        still = goes_on(sized)
        counts = {r["s"]: r["count"] for r in still.groupBy("s").count().collect()}
        few, many = [s for s, n in counts.items() if n <= GATHER], [s for s, n in counts.items() if n > GATHER]
        if few:
            last = still.where(F.col("s").isin(few)).withColumn("before", F.lit(0).cast("long"))
            new = cut(last.groupBy("s").applyInPandas(fit, kind), "mix-filled")
            taken = new if taken is None else taken.union(new)
        state = {s: state[s] for s in many}
        if not many:
            break
        still = cut(still.where(F.col("s").isin(many)), "mix-fill")
        sized = still.drop("at", "left")
        sums = still.groupBy("s", "left", "block").agg(F.sum(F.col("size") * F.col("n")).alias("words")).withColumn("upto", F.sum("words").over(order))
        sums = cut(sums, "mix-fill-blocks")
        # the block that does not fit whole, one per source
        edge = sums.where("upto > left").groupBy("s").agg(F.min(F.struct("block", (F.col("upto") - F.col("words")).alias("before"))).alias("e")).select("s", "e.*")
        whole = sized.join(sums.where("upto <= left").select("s", "block"), ["s", "block"]).select("s", "block", "h", "size", F.col("n").alias("m"), "n")
        tried = still.join(F.broadcast(edge), ["s", "block"]).groupBy("s").applyInPandas(fit, kind)
        new = cut(whole.union(tried), "mix-filled")
        taken = new if taken is None else taken.union(new)
        used = {r["s"]: r["n"] for r in new.groupBy("s").agg(F.sum(F.col("size") * F.col("m")).alias("n")).collect()}
        state = {r["s"]: (r["block"], state[r["s"]][1] - used.get(r["s"], 0)) for r in edge.collect()}
        state = {s: x for s, x in state.items() if x[1] > 0}
    return spark.createDataFrame([], kind) if taken is None else taken


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    key_col: str | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    shards: int = SHARDS,
    seed: int = 11,
    blocks: int = BLOCKS,
) -> Mix:
    """``key_col``: a column that tells all rows apart; without one each row gets a number of its own."""
    spark = docs.sparkSession
    with tidy(spark):
        sized = docs.select(
            (F.monotonically_increasing_id() if key_col is None else F.col(key_col)).alias("row"),
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.expr(rf"regexp_count(CAST(`{text_col}` AS string), '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col).cast("string")).alias("h"),
        )
        sized = cut(sized.withColumn("block", F.pmod("h", F.lit(blocks))), "mix-sizes", keep=True)
        by_source = sorted(((r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
        goals = targets([n for _, n in by_source], [weights[i % len(weights)] for i in range(len(by_source))], sum(n for _, n in by_source))
        plan = []
        for i, ((source, n), goal) in enumerate(zip(by_source, goals, strict=True)):
            rounds = min(int(goal // n), MAX_REPEATS) if n else 0
            plan.append((i, source, n, goal, rounds, int(round(goal - rounds * n)) if n else 0))
        wanted = F.broadcast(spark.createDataFrame(plan, "s int, source string, source_size long, target double, rounds int, rest long"))  # a row per source
        sized = sized.join(wanted, sized["source"].eqNullSafe(wanted["source"])).drop(wanted["source"])

        # the partial round: whole blocks in order, then what fits of all others
        found = sized.groupBy("s", "rest", "rounds", "block").agg(F.sum("size").alias("words"))
        found = found.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("block")))
        found = cut(found.withColumn("whole", F.col("upto") <= F.col("rest")), "mix-blocks")
        fitted = cut(_fill(sized.select("s", "block", "h", "size"), found), "mix-fitted")

        # the quotas: blocks that are taken, with a number for each round of each; what fitted of a block counts as one
        again = "CASE WHEN rounds + CAST(whole AS int) > 0 THEN sequence(1, rounds + CAST(whole AS int)) END"
        turns = found.select("s", "block", "words", F.explode(F.expr(again)).alias("turn"), F.lit(False).alias("part"))
        parts = fitted.groupBy("s", "block").agg(F.sum(F.col("size") * F.col("m")).alias("words")).select("s", "block", "words", F.lit(0).alias("turn"), F.lit(True).alias("part"))
        taken = cut(turns.unionByName(parts).withColumn("r", F.xxhash64(F.lit(seed + 1), "s", "block", "turn")), "mix-taken")
        counts = np.zeros(len(plan), np.int64)
        for r in taken.groupBy("s").count().collect():
            counts[r["s"]] = r["count"]
        quotas = split_quotas(counts, shards, np.random.default_rng(seed)) if len(plan) else np.zeros((shards, 0), np.int64)
        # each shard draws its quota of each source's permuted blocks
        ends = np.cumsum(quotas, axis=0)
        draws = [(s, k, int(ends[k, s] - quotas[k, s]), int(ends[k, s])) for s in range(len(plan)) for k in range(shards) if quotas[k, s]]
        draws = F.broadcast(spark.createDataFrame(draws, "s int, shard int, low long, high long"))  # sources times shards
        drawn = taken.withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy("r", "block", "turn")) - 1).join(draws, "s")
        drawn = cut(drawn.where((F.col("i") >= F.col("low")) & (F.col("i") < F.col("high"))).select("s", "block", "words", "turn", "part", "shard"), "mix-drawn")

        # a shard's partitions follow each other, as many as its words need
        words = {r["shard"]: r["n"] for r in drawn.groupBy("shard").agg(F.sum("words").alias("n")).collect()}
        room = [-(-max(words.get(k, 0), 1) // PART_WORDS) for k in range(shards)]
        first = np.cumsum([0, *room]).tolist()
        places = F.broadcast(spark.createDataFrame([(k, first[k], room[k]) for k in range(shards)], "shard int, first int, room int"))

        rows = sized.select("row", "s", "block", "h", "doc_id", "size").join(drawn.where("NOT part").select("s", "block", "turn", "shard"), ["s", "block"])
        some = sized.select("row", "s", "block", "h", "doc_id", "size").join(fitted, ["s", "block", "h", "size"])
        # of copies that do not all fit as many as do
        copies = Window.partitionBy("s", "block", "h", "size").orderBy("row")
        most = some.where("m < n").withColumn("k", F.row_number().over(copies)).where("k <= m")
        some = some.where("m = n").select("row", "s", "block", "h", "doc_id", "size").union(most.select("row", "s", "block", "h", "doc_id", "size"))
        rows = rows.unionByName(some.join(drawn.where("part").select("s", "block", "turn", "shard"), ["s", "block"]))
        place = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), "shard", "h", "turn", "row"), 1)
        rows = rows.select("row", "doc_id", "size", "s", "turn", "shard", place.alias("place")).join(places, "shard")
        rows = rows.withColumn("part", (F.col("first") + F.shiftright(F.shiftright("place", 32) * F.col("room"), 31)).cast("int")).drop("first", "room")
        rows = cut(rows, "mix-rows", keep=True)
    return Mix(sized.select("row", "doc_id", "size", "source_size", "target"), rows, first[-1])


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_col: str | None = None, **options) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, with the columns of ``docs`` and, if named, the shard.

    Each shard is a run of partitions of its own, which hold it in a random
    order. Rows have a key that each read gives again, so that what is planned
    is what is returned. ``options``: those of ``mix``.
    """
    key, shard, place, part = (free_name(c, docs) for c in ("row", "shard", "place", "part"))
    whole = keyed(docs, key, "mix-keyed")
    plan = mix(whole, id_col, text_col, source_col, key, **options)
    rows = plan.rows.select(F.col("row").alias(key), F.col("shard").alias(shard), F.col("place").alias(place), F.col("part").alias(part))
    out = whole.join(rows, key).repartitionById(plan.parts, part).sortWithinPartitions(place)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *([F.col(shard).alias(shard_col)] if shard_col else []))
