"""Alerts from data, routing, log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import is_degraded

# Alert texts.
LOADED = "加载离线快照，共 {} 家企业"
MISSING = "{}：备案/官网数据缺失，结论已降级为“待核实”"
DEGRADED = "{}：LLM 不可用，自动降级为本地关键词规则"
PENDING = "待人工复核 {} 家"
# Words that make an error critical.
CRITICAL_WORDS = ["API key", "companies"]


def _fill(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def derive_alerts(company: DataFrame, pending: DataFrame, run_time: Column) -> DataFrame:
    """Load note, one warning per company (missing data hides degradation), review note,
    all stamped with the run's time.

    ``company`` needs ``company_id, name, has_data, analysis_mode``.
    """
    short = F.substring_index("name", "｜", 1)
    no_data = ~F.col("has_data")
    weak = is_degraded(F.col("analysis_mode"))
    none = F.lit(None).cast("string")
    warn = company.filter(no_data | weak).select(
        F.lit("warning").alias("level"),
        F.when(no_data, "data_missing").otherwise("degraded").alias("code"),
        F.col("company_id").cast("string").alias("company_id"),
        F.when(no_data, _fill(MISSING, short)).otherwise(_fill(DEGRADED, short)).alias("text"))
    note = lambda df, code, template: df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("info").alias("level"), F.lit(code).alias("code"), none.alias("company_id"),
        _fill(template, F.col("n")).alias("text"))
    rows = (note(company, "loaded", LOADED).unionByName(warn)
            .unionByName(note(pending, "pending", PENDING)))
    return rows.select(run_time.alias("time"), "level", "code", "company_id", "text")


def route_alerts(alert: DataFrame, text: str = "text") -> DataFrame:
    """Critical when the error speaks of the key or the roster, else a warning; alerts
    without text are not shown."""
    grave = F.lit(False)
    for word in CRITICAL_WORDS:
        grave = grave | F.contains(text, F.lit(word))
    return alert.filter(~F.coalesce(F.col(text) == "", F.lit(True))).withColumn(
        "level", F.when(grave, "critical").otherwise("warning"))


def log_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Log text line by line, empty lines dropped; ``pos`` counts from zero."""
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter(
        F.col("line") != "")


