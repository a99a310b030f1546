"""Task state, reruns, reuse, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.labels import label
from ..functions.scale import latest_by, lookup
from ..functions.text import first_filled, indented_json, nth

ALL_PHASES = (1 << len(fixed.PHASES)) - 1
SCREENING = fixed.PHASES.index("KEYWORD")
FINISHED = ["OK", "TERMINAL"]


def settled(fields: list[str]) -> Column:
    """Aggregate: the record that counts for a task. Nothing follows an end, so the first
    TERMINAL one counts, whatever is told later; else the latest."""
    value, order = F.struct(*fields), F.struct("ts", "event_id")
    return F.coalesce(F.min_by(value, F.when(F.col("status") == "TERMINAL", order)), F.max_by(value, order))


def task_state(task_event: DataFrame) -> DataFrame:
    """State of every task (company, phase, folder) with its number of tries."""
    best = settled(["status", "error_code", "event_id"])
    tries = F.count_if(F.col("status").isin("FAILED", "RETRY_WAIT"))
    return (task_event.groupBy("company_id", "phase_idx", "task_dir")
            .agg(best.alias("_best"), tries.alias("attempts"))
            .select("company_id", nth(fixed.PHASES, F.col("phase_idx")).alias("phase"),
                    "phase_idx", "task_dir", "_best.*", "attempts"))


def open_phases() -> Column:
    """Aggregate: bit set of the phases a company has not finished. A phase is finished
    when it has tasks and all of them are OK or TERMINAL; a phase without tasks is open."""
    bit = F.call_function("shiftleft", F.lit(1), F.col("phase_idx").cast("int"))
    seen = F.coalesce(F.bit_or(bit), F.lit(0))
    left = F.coalesce(F.bit_or(F.when(~F.col("status").isin(FINISHED), bit)), F.lit(0))
    return F.bitwise_not(seen).bitwiseAND(F.lit(ALL_PHASES)).bitwiseOR(left)


def company_task_stats(task: DataFrame) -> DataFrame:
    """Totals per company, the first open phase, whether the run is over, and whether
    its texts were screened.

    The run is over when no phase is open; a task that ended without a result (TERMINAL)
    counts as finished, neither ok nor failed. ``screened`` holds only if the keyword phase
    has tasks and all of them are OK.
    """
    s = F.col("status")
    stats = task.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "OK").alias("ok"),
        F.count_if(s == "FAILED").alias("failed"), F.count_if(s == "RUNNING").alias("running"),
        open_phases().alias("_open"),
        F.coalesce(F.bool_and(F.when(F.col("phase_idx") == SCREENING, s == "OK")), F.lit(False)).alias("screened"))
    first = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(len(fixed.PHASES) - 1)),
                                 lambda i: F.getbit("_open", i) == 1))
    closed = F.col("_open") == 0
    current = F.when(closed, fixed.NO_TEXT).otherwise(nth(fixed.PHASES, first))
    return stats.select("company_id", "total", "ok", "failed", "running",
                        current.alias("current_phase"), closed.alias("closed"), "screened")


def live_rows(task: DataFrame) -> DataFrame:
    """Progress rows: one per company with its live status."""
    return company_task_stats(task).withColumn(
        "status", F.when(F.col("closed"), "CLOSED").otherwise("OPEN"))


def error_attribution(task: DataFrame) -> DataFrame:
    """Failed and retrying tasks by error code."""
    bad = task.filter(F.col("status").isin("FAILED", "RETRY_WAIT"))
    return bad.groupBy("error_code").agg(F.count(F.lit(1)).alias("n")).select(
        "error_code", label("error", F.col("error_code")).alias("label"), "n")


def select_replay(roster: DataFrame, chosen: DataFrame, key: str = "company_id") -> DataFrame:
    """Roster rows of the chosen companies; choosing nothing is an error."""
    if chosen.isEmpty():
        raise ValueError("choose at least one company")
    return roster.join(chosen.select(key).distinct(), key, "left_semi")


def split_reuse(plan: DataFrame, done: DataFrame, keys: list[str], spread: list[str],
                order: list[str] | None = None) -> DataFrame:
    """Mark planned tasks whose input already succeeded.

    With ``order`` only a success that lies earlier than the planned task counts. The
    successes shrink to one row per key before the join; ``spread`` names the columns
    that tell planned tasks of one key apart.
    """
    first = F.min(F.struct(*order)) if order else F.lit(True)
    ok = done.groupBy(*keys).agg(first.alias("_ok"))
    known = F.col("_ok") < F.struct(*order) if order else F.col("_ok")
    return lookup(plan, ok, keys, spread).withColumn(
        "action", F.when(known, "HISTORY_REUSE").otherwise("PROCESS")).drop("_ok")


def task_cards(task: DataFrame) -> DataFrame:
    """Card per task: best title, status label, the summary's first 1,000 characters."""
    part = lambda k: F.try_element_at(F.col("summary"), F.lit(k))
    title = first_filled(part("title"), part("url"), part("domain"), part("name"),
                         F.col("task_dir"), F.lit(fixed.UNNAMED_TASK))
    return task.select(
        *[c for c in task.columns if c != "summary"], title.alias("title"),
        label("taskStatus", F.col("status")).alias("status_label"),
        F.substring(F.coalesce(indented_json(F.col("summary")), F.lit("{}")), 1, 1000).alias("detail"))


def phase_results(task: DataFrame, company: int | str | None = None,
                  phase: str = "RISK_ANALYSIS") -> DataFrame:
    """Tasks of one phase, of one company or of all."""
    rows = task.filter(F.col("phase") == phase)
    return rows if company is None else rows.filter(F.col("company_id") == company)


def latest_events(task_event: DataFrame) -> DataFrame:
    """Last event of every company."""
    return latest_by(task_event, ["company_id"], ["ts", "event_id"],
                     ["status", "phase", "event_id"])
