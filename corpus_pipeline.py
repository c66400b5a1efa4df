"""The corpus pipeline: STAGES in order, each over all rows that the one before it kept.

Every stage but the last returns the columns of its input. Nulls, empty and
very long texts, repeated rows and empty tables have the results that the
operators' docstrings give; each stage reads ``doc_id``, ``text`` and
``source`` and passes other columns on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslode.llm import mixing, quality_model, sentencepiece_scan, simhash, suffix_dedup
from corpuslode.llm.common import remove, scratch, stored, tidy


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on four fifths of the labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return quality_model.keep_good(docs, quality_model.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the row with the smallest id."""
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that stand elsewhere too."""
    return suffix_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, by the weights of their sources."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each row."""
    return sentencepiece_scan.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: No SQL for fitted models, fingerprints and token ids: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other. A stage's scratch goes once its rows are written, and these once the next ones are."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        rows = scratch(spark, f"stage-{i}")
        with tidy(spark):
            docs = stored(stage(spark, docs, sf_dir), rows)
        if before is not None:
            remove(spark, before)
        before = rows
    return STAGES[-1][1](spark, docs, sf_dir)
