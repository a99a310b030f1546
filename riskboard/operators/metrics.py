"""Counts and key figures of the board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.labels import is_degraded
from ..functions.text import number_or_zero, round_half_up


def companies_by_status(company: DataFrame) -> DataFrame:
    return company.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def tasks_by_phase_status(task: DataFrame) -> DataFrame:
    """Tasks per phase and status; the row with two nulls is the grand total."""
    return _with_totals(task, "phase", "status", [])


def _with_totals(df: DataFrame, a: str, b: str, *totals: list[str]) -> DataFrame:
    """Counts per ``(a, b)`` and the named totals; the totals add up the counts, so the
    rows themselves are not multiplied by the number of totals."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    sets = [[F.col(c) for c in names] for names in ([a, b], *totals)]
    return cells.groupingSets(sets, F.col(a), F.col(b)).agg(F.sum("n").alias("n")).select(a, b, "n")


def audit_by_status(task: DataFrame) -> DataFrame:
    """Counts of the four audited statuses, zeros included."""
    counted = task.agg(*[F.count_if(F.col("status") == s).alias(s) for s in fixed.AUDIT_STATUSES])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in fixed.AUDIT_STATUSES])))


def _success(total: Column, good: Column) -> Column:
    return F.when(total > 0, round_half_up(good / total * 100))


def kpi_board(company: DataFrame, task: DataFrame, plan: DataFrame) -> DataFrame:
    """The five key figures in one row; every input is aggregated on its own and the
    one-row results meet as scalar subqueries."""
    s = F.col("status")
    t = task.agg(F.struct(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "FAILED").alias("failed"),
        F.count_if(s == "RETRY_WAIT").alias("retry"), F.count_if(s == "RUNNING").alias("running"),
        F.count_if(s == "PENDING").alias("pending")).alias("t"))
    c = company.agg(F.struct(
        F.count_if(s == "CLOSED").alias("closed"), F.count_if(s == "OPEN").alias("open"),
        F.count_if(is_degraded(F.col("analysis_mode"))).alias("degraded")).alias("c"))
    p = plan.agg(F.struct(
        F.count_if(F.col("action") == "HISTORY_REUSE").alias("reused"),
        F.count_if(F.col("action") == "PROCESS").alias("processed")).alias("p"))
    one = company.sparkSession.range(1).select(
        t.scalar().alias("t"), c.scalar().alias("c"), p.scalar().alias("p"))
    total = F.col("t.total")
    waiting = F.col("t.retry") + F.col("t.running") + F.col("t.pending")
    return one.select(
        F.col("c.closed").alias("done"), (F.col("c.closed") + F.col("c.open")).alias("companies"),
        (total - waiting).alias("terminal"), total.alias("tasks"), waiting.alias("unfinished"),
        _success(total, total - F.col("t.failed") - waiting).alias("success_pct"),
        (F.col("t.failed") + F.col("t.retry")).alias("abnormal"),
        F.col("p.reused").alias("reused"), F.col("p.processed").alias("processed"),
        F.col("c.degraded").alias("degraded"))


def kpi_from_counts(counts: DataFrame) -> DataFrame:
    """The published formula on stored counts ``closed, open, tasks, failed, retry,
    running, pending, reused, processed``, numbers or text, a missing one counting as
    zero; here ``pending`` may count reviews."""
    c = lambda name: number_or_zero(F.col(name)).cast("bigint")
    waiting = c("retry") + c("running") + c("pending")
    good = c("tasks") - c("failed") - waiting
    return counts.select(
        c("closed").alias("done"), (c("closed") + c("open")).alias("companies"),
        (c("tasks") - waiting).alias("terminal"), c("tasks").alias("tasks"), waiting.alias("unfinished"),
        _success(c("tasks"), good).alias("success_pct"), good.alias("succeeded"),
        (c("failed") + c("retry")).alias("abnormal"), c("reused").alias("reused"), c("processed").alias("processed"))


def degraded_count(company: DataFrame) -> DataFrame:
    return company.agg(F.count_if(is_degraded(F.col("analysis_mode"))).alias("n"),
                       F.count(F.lit(1)).alias("total"))


def file_index(process_file: DataFrame) -> DataFrame:
    """Files per company and kind, per kind (null company), and in all (both null)."""
    return _with_totals(process_file, "company_id", "kind", ["kind"], [])


def screenshots(process_file: DataFrame) -> DataFrame:
    return process_file.filter(F.col("kind") == fixed.SCREENSHOT)
