"""A corpus from ``documents``: five stages, each over all that the one before it kept."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskboard.llm import bpe, copies, decontaminate, langid, suffix
from riskboard.llm.store import discard, saved, small_batches

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main language is known and makes up at least half of the text."""
    return langid.keep_known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 or more of their five-word shingles
    in common, by fingerprints compared with exclusive-or and bit counts."""
    return copies.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur more than once; ``n_chars`` is
    the new length."""
    return suffix.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(
        *docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and the digest of what they decode to."""
    coded = bpe.encoded(docs, bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))



def _modest(stage):
    """The stage, with texts in small batches: stages share their executors' memory."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)
    return run


STAGES = [(stage.__name__, _modest(stage)) for stage in (language, near_copies, repeats, benchmarks, tokens)]

# edit matching, mixture inference and BPE have no SQL form; tests hold brute force against them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = saved(stage(spark, docs, sf_dir), name)
        discard(docs)  # what the stage read is not asked for again
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
