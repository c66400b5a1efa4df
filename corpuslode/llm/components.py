"""Connected components of a graph of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import cut, tidy


#: Links in one file of a round's table.
FILE_LINKS = 1_000_000


def components(links: DataFrame, kind: str = "long") -> DataFrame:
    """``links``: columns a, b. Returns node and component, its smallest node, for each node with a link to another one.

    In a large-star round each node points its larger neighbours at its
    smallest neighbour; in a small-star round it points the smaller ones and
    itself. The rounds end when nothing changes: then each node points at the
    root of its component. Each round is written to the shared folder. No list
    of neighbours is ever built: a node's smallest neighbour is an aggregate,
    joined back to its links.
    """
    links = links.select(F.least("a", "b").cast(kind).alias("a"), F.greatest("a", "b").cast(kind).alias("b")).where("a < b").distinct()
    before = now = None
    with tidy(links.sparkSession):
        links = cut(links, "links")
        # links never become more than twice as many: a small table stays in few files, and one of one file is one task's work, without shuffles
        files = max(1, 2 * links.count() // FILE_LINKS)
        links = links.coalesce(1) if files == 1 else links
        while now is None or now != before:
            before = now
            both = links.union(links.select("b", "a")).toDF("u", "v")
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
            # links now go from a smaller to a larger node; each node keeps its smallest one and points the others there
            large = large.distinct()
            low = large.groupBy("b").agg(F.min("a").alias("m"))
            small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("l"))
            links = cut(small.select("l.*").where("a < b").distinct().coalesce(files), "links")
            links = links.coalesce(1) if files == 1 else links
            now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return cut(links.select(F.col("b").alias("node"), F.col("a").alias("component")), "components", keep=True)
