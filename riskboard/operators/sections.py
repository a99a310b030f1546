"""Sections of a company: payloads, fallback, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.scale import lookup
from ..functions.text import pick

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _counts(icp: str):
    return F.struct(*[F.coalesce(F.array_size(f"{icp}.{k}"), F.lit(0)).alias(k)
                      for k in fixed.CARRIER_KINDS])


def _sources_by_id(sources: str):
    return F.map_from_entries(F.transform(sources, lambda s: F.struct(s["id"], s)))


def company_sections(snapshot: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Every section of every company as a JSON payload: ``company, section, payload``.

    ``latest`` (``company_id`` = name, review fields) replaces the review record in the
    risk and evidence sections before they are written out.
    """
    c = snapshot.select("sources", F.explode("companies").alias("c")).select("sources", "c.*")
    risk = F.col("risk")
    if latest is not None:
        fields = ["status", "reviewer", "decision", "note", "reviewed_at"]
        new = latest.select(F.col("company_id").alias("name"), F.struct(
            *[F.col(f).cast("string").alias(f) for f in fields]).alias("_new"))
        c = c.join(new, "name", "left")
        old = F.col("risk.human_review")
        risk = F.when(old.isNotNull() & F.col("_new").isNotNull(),
                      risk.withField("human_review", F.col("_new"))).otherwise(risk)
    c = c.withColumn("risk", risk)
    mode = F.col("risk.analysis_mode").alias("analysis_mode")
    parts = {
        "icp": [_counts("icp").alias("icp_counts"), F.col("icp").alias("icp_carriers"), mode],
        "website": [F.col("website_search"), F.col("website_crawl"), mode],
        "social": [F.col("social").alias("social_account_verifications"), mode],
        "risk": [F.col("risk").alias("risk"), mode],
        "evidence": [F.col("risk.executive_summary"), F.col("risk.evidence"),
                     F.col("risk.inferences"), F.col("risk.uncertainties"),
                     F.col("risk.change_conditions"), F.col("risk.human_review"), mode,
                     _sources_by_id("sources").alias("sources")],
    }
    rows = [F.struct(F.lit(name).alias("section"),
                     F.to_json(F.struct(*cols), _KEEP_NULLS).alias("payload"))
            for name, cols in parts.items()]
    return c.select(F.col("name").alias("company"), F.inline(F.array(*rows)))


def phase_payloads(task: DataFrame) -> DataFrame:
    """Every task as a JSON payload of its company and phase, one row per task."""
    body = [c for c in task.columns if c not in ("run_id", "company_id", "phase")]
    return task.select("company_id", "phase", F.to_json(F.struct(*body), _KEEP_NULLS).alias("payload"))


def section(sections: DataFrame, company: str, name: str = "risk") -> DataFrame:
    """One section; an unknown company or section gives no row."""
    return sections.filter((F.col("company") == company) & (F.col("section") == name))


def section_or_phase(sections: DataFrame, tasks: DataFrame) -> DataFrame:
    """Exported sections, and for a company without the section the task results of the
    phase behind it: ``company_id, section, origin, phase, task_dir, status, n``.

    ``sections`` is ``company_id, section, n``, one row each. A section's row has no task;
    a stand-in row is one task with ``n`` 1.
    """
    by_phase = {phase: name for name, phase in fixed.SECTION_PHASE.items()}
    none = F.lit(None).cast("string")
    stood_in = (tasks.withColumn("section", pick(F.col("phase"), by_phase)).filter(F.col("section").isNotNull())
                .select("company_id", "section", F.lit("phase").alias("origin"), "phase", "task_dir", "status",
                        F.lit(1).cast("bigint").alias("n")))
    own = sections.select("company_id", "section", F.lit("section").alias("origin"), none.alias("phase"),
                          none.alias("task_dir"), none.alias("status"), "n")
    have = sections.select("company_id", "section").distinct()
    return own.unionByName(lookup(stood_in, have, ["company_id", "section"], ["task_dir"], "left_anti"))


def section_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows per company of every named part, in long form ``company_id, section, n``;
    the parts are stacked first and counted in one aggregate."""
    tagged = [df.select("company_id", F.lit(name).alias("section")) for name, df in parts.items()]
    stacked = reduce(DataFrame.unionByName, tagged)
    return stacked.groupBy("company_id", "section").agg(F.count(F.lit(1)).alias("n"))
