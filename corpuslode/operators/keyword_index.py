"""A stored keyword index: postings in blocks with their largest share, and exact top-k that leaves blocks shut.

``write`` counts the documents once. Documents are dealt into groups: by the
octave of their number of tokens, since the share of a term in a document, its
weight's first factor, is large in short ones, and within an octave by a hash,
so that a group has about ``GROUP_DOCS`` documents. A block holds a term's
postings in a group, so it is bounded and no term is a hot key. Stored are the
blocks (with the largest share, read without the postings), how many documents
have each term, and the number of documents. Texts are shuffled by group and
counted there, in the row; then only blocks are, by their term.

``search`` bounds a query in a group by the sum over its terms of the weight that
the block's largest share gives. It opens the groups of largest bound for each
query first, whose scores are exact, as a document's postings are all in its
group. The k-th of them is what a document must reach: a group whose bound is
below is never opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslode.functions.keywords import counted, tokens
from corpuslode.operators.ranking import top

#: Documents of a group, about; and folders that terms are dealt into.
GROUP_DOCS, FOLDERS = 512, 32
#: Tokens of a task, about.
TASK_TOKENS = 4_000_000
#: Groups opened for a query before there is a score to reach.
FIRST_GROUPS = 2
#: A bound is this much wider than what it bounds, for sums in another order.
SLACK = 1e-7
#: Terms up to which a search names them to the scan.
NAMED_TERMS = 10_000


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def write(docs: DataFrame, path: str, key: str = "node_id", text: str = "text") -> None:
    """Write the index of docs; ids are unique. Documents without a token count, but have no postings. Null text has none."""
    spark = docs.sparkSession
    words = tokens(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("n", F.size(words))
    # an octave's number of documents and tokens: a row for each octave
    octave = F.when(F.col("n") > 0, F.floor(F.log2("n"))).otherwise(-1).cast("int")
    found = rows.groupBy(octave.alias("o")).agg(F.count("*").alias("m"), F.sum("n").alias("all")).collect()
    sizes = {r["o"]: r["m"] for r in found}
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(r["all"] for r in found) // TASK_TOKENS))
    salts = F.coalesce(*[F.when(octave == o, F.lit(-(-m // GROUP_DOCS))) for o, m in sizes.items()], F.lit(1)).cast("long")
    group = octave.cast("long") * F.lit(1 << 40) + F.pmod(F.xxhash64("id"), salts)
    # all documents of a group are in one task, so its terms meet there
    grouped = rows.where("n > 0").select("id", "text", "n", group.alias("g")).repartition(tasks, "g")
    tf = grouped.select("id", "n", "g", F.explode(counted(words)).alias("x")).select("x.term", "g", "id", "n", "x.c")
    share = F.col("c") / F.col("n")
    blocks = tf.groupBy("term", "g").agg(F.max(share).alias("most"), F.count("*").alias("docs"), F.collect_list(F.struct("id", "c", "n")).alias("postings"))
    blocks = blocks.withColumn("folder", _folder(F.col("term")))
    # a folder's terms are dealt to as many tasks as its share of the tokens needs
    part = F.pmod(F.hash("term"), F.lit(-(-tasks // FOLDERS)))
    blocks.repartition(max(FOLDERS, tasks), "folder", part).sortWithinPartitions("folder", "term", "g").write.partitionBy("folder").parquet(f"{path}/blocks")
    spark.range(1).select(F.lit(sum(sizes.values())).cast("long").alias("total"), F.lit(dict(docs.dtypes)[key]).alias("kind")).write.parquet(f"{path}/total")
    _blocks(spark, path).groupBy("term").agg(F.sum("docs").alias("df")).write.parquet(f"{path}/terms")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The stored blocks; an index of no postings has no file that tells their schema."""
    kind = spark.read.parquet(f"{path}/total").first()["kind"]
    return spark.read.schema(f"term string, g long, most double, docs long, postings array<struct<id:{kind},c:long,n:int>>, folder int").parquet(f"{path}/blocks")


def _plan(spark: SparkSession, path: str, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queries' terms with their weight's second factor, the stored blocks, and the bound of each query in each group."""
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    total = spark.read.parquet(f"{path}/total").first()["total"]
    terms = spark.read.parquet(f"{path}/terms").join(asked.select("term").distinct(), "term", "left_semi")
    idf = terms.select("term", F.log(F.lit(total) / (F.col("df") + 1)).alias("idf"))
    asked = asked.join(idf, "term")
    blocks = _blocks(spark, path)
    # few terms are named, so that folders and row groups without them are not read
    named = [r[0] for r in asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    if len(named) <= NAMED_TERMS:
        folders = [r[0] for r in spark.createDataFrame([(t,) for t in named], "term string").select(_folder(F.col("term"))).distinct().collect()] if named else []
        blocks = blocks.where(F.col("folder").isin(folders) & F.col("term").isin(named))
    # a document of the group may lack a term: a negative weight bounds nothing
    most = F.greatest(F.lit(0.0), F.col("times") * F.col("most") * F.col("idf"))
    bounds = asked.join(blocks.select("term", "g", "most"), "term").groupBy("query_id", "g").agg((F.sum(most) + SLACK).alias("bound"))
    return asked, blocks, bounds


def _opened(asked: DataFrame, blocks: DataFrame, chosen: DataFrame, digits: int) -> DataFrame:
    """Exact scores of all documents of the chosen groups (query_id, g)."""
    met = asked.join(blocks.select("term", "g", "postings"), "term").join(chosen, ["query_id", "g"])
    each = met.select("query_id", "times", "idf", F.explode("postings").alias("p")).select("query_id", F.col("p.id").alias("id"), (F.col("times") * (F.col("p.c") / F.col("p.n") * F.col("idf"))).alias("w"))
    return each.groupBy("query_id", "id").agg(F.round(F.sum("w"), digits).alias("score"))


def choose(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, digits: int = 8) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The queries' terms, the blocks, the bounds, and of these those that are opened (query_id, g)."""
    asked, blocks, bounds = _plan(spark, path, queries)
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "g")
    first = bounds.withColumn("i", F.row_number().over(order)).where(F.col("i") <= FIRST_GROUPS).select("query_id", "g")
    reached = top(_opened(asked, blocks, first, digits), k, key="id", by=["query_id"]).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # queries that have not found k documents yet open all groups
    chosen = bounds.join(reached, "query_id", "left").where("least IS NULL OR bound >= least").select("query_id", "g")
    return asked, blocks, bounds, chosen


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, key: str = "node_id", digits: int = 8) -> DataFrame:
    """For each query (query_id, query) the k documents of largest summed weight, as ``ranking.keyword_search`` finds them."""
    asked, blocks, _, chosen = choose(spark, path, queries, k, digits)
    return top(_opened(asked, blocks, chosen, digits).withColumnRenamed("id", key), k, key=key, by=["query_id"])


def opened(spark: SparkSession, path: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """Of each query the blocks of its terms, and those that a search opens."""
    asked, blocks, _, chosen = choose(spark, path, queries, k)
    met = asked.join(blocks.select("term", "g"), "term").select("query_id", "g")
    return met.join(chosen.withColumn("open", F.lit(1)), ["query_id", "g"], "left").groupBy("query_id").agg(F.count("*").alias("blocks"), F.count("open").alias("opened"))
