"""From raw documents to token ids: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from textlabels.llm import bpe, decontaminate, line_dedup, quality, simhash
from textlabels.llm.common import materialize, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "quality")
    return quality.keep_good(docs, "text", model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that stand earlier (three lines, or 50 words); those of which nothing is left go."""
    left = line_dedup.remove_repeated_lines(docs, "doc_id", "text", min_words=line_dedup.MIN_WORDS)
    left = left.where("_n_removed = 0 or text <> ''")
    return left.withColumn("n_chars", F.when(F.col("_n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text"))
                           .cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest doc_id."""
    return simhash.keep_first(docs, "doc_id", "text")


def not_in_the_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages."""
    return decontaminate.drop_contaminated(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the token ids of every document, and the digest of what they decode to."""
    coded = bpe.encode_decode(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", not_in_the_benchmark),
    ("bpe_encoding", as_tokens),
]
ORACLE_SQL = None      # the trained classifier has no SQL form; tests compare the rest with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
