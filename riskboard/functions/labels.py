"""Code to label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import fixed
from .text import first_filled, pick


def label(group: str, code: Column) -> Column:
    """Label of a code; an unlisted code shows itself, an empty one shows "other"."""
    return F.coalesce(pick(code, fixed.LABELS[group]), first_filled(code, F.lit(fixed.OTHER)))


def label_dim(spark: SparkSession) -> DataFrame:
    """The fixed labels as rows ``grp, code, label``."""
    rows = [F.struct(F.lit(g).alias("grp"), F.lit(c).alias("code"), F.lit(t).alias("label"))
            for g, codes in fixed.LABELS.items() for c, t in codes.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def decode(df: DataFrame, dim: DataFrame, group: str = "grp", code: str = "code") -> DataFrame:
    """Add ``label`` from a label table on ``(group, code)``.

    The table is joined without a hint: Spark measures it and broadcasts it when small.
    """
    hit = df.join(dim.select(F.col("grp").alias(group), F.col("code").alias(code), "label"),
                  [group, code], "left")
    return hit.withColumn("label", F.coalesce(
        "label", first_filled(F.col(code), F.lit(fixed.OTHER))))


def verdict_label(risk: Column) -> Column:
    """Three-way verdict: risk, none found, undecided."""
    v = fixed.VERDICT
    return F.when(risk, v["risk"]).when(~risk, v["none"]).otherwise(v["open"])


def found_label(flag: Column, texts: dict[str, str] = fixed.FOUND) -> Column:
    return F.when(flag, texts["yes"]).when(~flag, texts["no"]).otherwise(texts["open"])


def evidence_label(grade: Column) -> Column:
    return F.coalesce(pick(grade, fixed.EVIDENCE_LABEL), F.lit(fixed.EVIDENCE_MISSING))


def is_degraded(mode: Column) -> Column:
    return F.coalesce(mode == fixed.MODE_FALLBACK, F.lit(False))


def stage_shown(status: Column, phase: Column) -> Column:
    """Done once closed, else the live phase, else undecided."""
    live = phase.isNotNull() & ~phase.isin("", fixed.NO_TEXT, fixed.UNDECIDED)
    return (F.when(status == "CLOSED", fixed.DONE)
            .when(live, label("phase", phase)).otherwise(fixed.UNDECIDED))
