"""The registered corpus queries: thin digests of the operators' outputs, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslode.llm import alignment, language, main_text, mixing, periodic_runs, quality_model, quality_rules, sentencepiece_scan, simhash, suffix_dedup, tiff, token_counts, token_files
from corpuslode.llm.common import WORD, documents, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, w.text, len(words)::BIGINT AS n_words,
         length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * len(string_split(text, chr(10)))
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 4 * word_chars
            OR 2 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words) AS kept
FROM b
"""


@query("op1_quality_rules", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir))


def remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(remainder(4) != 2))
    found = language.predict(docs, model)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op9_quality_model")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.fit(docs, labels.where(remainder(5) != 0))
    found = quality_model.score(docs, model)
    predicted = (F.col("score") >= quality_model.THRESHOLD).cast("int")
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", predicted.alias("predicted"))


@query("op3_tiff")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(documents(spark, sf_dir))


@query("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(documents(spark, sf_dir))
    drawn = plan.rows.groupBy("row").agg(F.sum("size").alias("taken"), F.concat_ws(",", F.sort_array(F.collect_list("shard"))).alias("shards"))
    return plan.sizes.join(drawn, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"))


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read(spark, path, with_ids=False)


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(documents(spark, sf_dir), with_spans=False)


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = sentencepiece_scan.decode_ids(sentencepiece_scan.encode(documents(spark, sf_dir), path, digest=True), path)
    text = F.translate(F.coalesce("text", F.lit("")), sentencepiece_scan.SPACE, " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", (F.col("decoded") == text).alias("round_trip"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and the words of each text; every tenth text by the hash of its id repeats itself from a word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("w"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("hit"))
    d = d.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return d.select("doc_id", F.when(F.col("hit") & (F.col("n") > 0), again).otherwise(F.col("w")).alias("words"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted(documents(spark, sf_dir)), words="words")
    # the greatest length first, then the smallest start and period
    key = lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"])
    best = F.array_min(F.transform("runs", key))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(listed, "\n"), F.lit("\n"))).otherwise("")
    d = found.withColumn("best", best).withColumn("length", -F.col("best.l"))
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), "length", F.col("best.period").alias("period"),
        F.expr("length * 1000 DIV best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.aligned_with_counts(documents(spark, sf_dir), a, b, digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_main_text")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = main_text.main_text(pages, main_text.fit(spark))
    return found.withColumn("n_chars", F.length("text").cast("long"))
