"""Rosters, replay lists, file fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.keys import roster_names

_ROW = r"^\|\s*`([^`]+)`\s*\|\s*([0-9]+)\s*\|\s*`([0-9a-f]{64})`\s*\|"


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Company names, one full name per line."""
    return roster_names(spark.read.text(path))


def write_replay(chosen: DataFrame, path: str, column: str = "name") -> None:
    """Write the chosen names as a roster file."""
    chosen.select(F.col(column).cast("string").alias("value")).distinct().write.mode(
        "overwrite").text(path)


def fingerprint(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Size and SHA-256 of every file below a folder, by its path relative to it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    root = re.escape(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", path).rstrip("/"))
    return reader.load(path).select(
        F.regexp_replace("path", f"^([A-Za-z][A-Za-z0-9+.-]*:)?/*{root}/", "").alias("path"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Markdown manifest table: file, bytes, hash."""
    got = lambda i: F.regexp_extract("value", _ROW, i)
    return spark.read.text(path).filter(F.col("value").rlike(_ROW)).select(
        got(1).alias("path"), got(2).cast("bigint").alias("bytes"), got(3).alias("sha256"))


def check_manifest(measured: DataFrame, manifest: DataFrame) -> DataFrame:
    """State of every path: ok, changed, missing (only recorded), extra (only measured)."""
    have = measured.select("path", F.struct("bytes", "sha256").alias("_have"))
    want = manifest.select("path", F.struct("bytes", "sha256").alias("_want"))
    state = (F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "extra")
             .when(F.col("_have") == F.col("_want"), "ok").otherwise("changed"))
    return have.join(want, "path", "full").select("path", state.alias("state"))
