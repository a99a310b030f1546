"""Registered carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import CARRIER_KINDS
from ..functions.text import first_filled, index_of, norm_name


def _by_kind() -> list:
    return [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in CARRIER_KINDS]


def lookup_carriers(roster: DataFrame, registry: DataFrame) -> DataFrame:
    """Carrier counts for every roster company, matched by normalised name; a company
    without carriers stays with zeros. The registry is counted per name before the join."""
    found = (registry.select(norm_name(F.col("registered_name")).alias("_key"), "kind").filter("_key <> ''")
             .groupBy("_key").agg(*_by_kind()))
    counts = [F.coalesce(F.col(f"n_{k}"), F.lit(0)).alias(f"n_{k}") for k in CARRIER_KINDS]
    return (roster.withColumn("_key", norm_name(F.col("name"))).join(found, "_key", "left")
            .select("company_id", "name", *counts))


def carrier_counts(carrier: DataFrame) -> DataFrame:
    return carrier.groupBy("company_id").agg(*_by_kind(), F.count(F.lit(1)).alias("n_total"))


def carrier_listing(carrier: DataFrame) -> DataFrame:
    """Listing lines; order them by ``kind_idx, pos``."""
    record = F.to_json(F.struct("domain", "name"))
    shown = F.coalesce(first_filled(F.col("domain"), F.col("name"), record), record)
    return carrier.select(
        "company_id", index_of(F.col("kind"), CARRIER_KINDS).alias("kind_idx"), "pos",
        F.concat(F.lit("["), "kind", F.lit("] "), shown).alias("line"))
