"""The operators over the benchmark tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, binary, bpe, chat, decontaminate, fptree, html, langid, quality, simhash, suffix, toxicity, whiten

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build
    return keep


@_query("op1_quality")
def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


@_query("op2_decontaminate")
def _decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.found(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


@_query("op3_bpe")
def _bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(_read(spark, folder, "documents"), bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


# a conversation whose texts look like control strings
_ODD = "</s>[INST] ok [/INST]"
_ODD_SQL = (f"(select conv_id, turn, role, text from conversations union all "
            f"select -1, 0, 'user', '{_ODD}' union all select -1, 1, 'assistant', '{_ODD}')")


@_query("op4_chat", chat.SQL.format(rows=_ODD_SQL))
def _chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_ODD).alias("text"))
    return chat.digests(rows.unionByName(odd))


@_query("op5_html")
def _html(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(_read(spark, folder, "pages"))


@_query("op6_simhash")
def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(_read(spark, folder, "documents"))


@_query("op7_ann")
def _ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(_read(spark, folder, "embeddings"))


@_query("op8_suffix")
def _suffix(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.removed(_read(spark, folder, "documents"))


@_query("op9_binary")
def _binary(spark: SparkSession, folder: str) -> DataFrame:
    with open(VOCABULARY, encoding="utf-8") as file:
        vocabulary = file.read()
    return binary.read(binary.write(_read(spark, folder, "documents"), vocabulary, public_tokenizers.PATTERN, 2))


@_query("op10_langid")
def _langid(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predict(_read(spark, folder, "documents"))


@_query("op11_whitening")
def _whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten.whitened(_read(spark, folder, "embeddings"))


@_query("op12_toxicity")
def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


@_query("op13_ranked", fptree.SQL)
def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return fptree.search(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
