"""One run from snapshot to published board."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import alerts, board, metrics, sections
from ..operators import evidence as ev
from ..operators.tasks import company_task_stats
from ..sources import publish, snapshot as snap


def run_tables(document: DataFrame, tasks: DataFrame | None = None, files: DataFrame | None = None,
               reviews: DataFrame | None = None) -> dict[str, DataFrame]:
    """All published tables of a run; ``tasks`` is the task table, ``files`` the process
    files, ``reviews`` the latest reviews keyed by company name."""
    t = snap.normalise(document)
    firms = t["company"]
    carriers = t["carrier"].groupBy("company_id").agg(F.count(F.lit(1)).alias("_c"))
    pages = t["seen_url"].groupBy("company_id").agg(F.count(F.lit(1)).alias("_p"))
    known = (firms.join(carriers, "company_id", "left").join(pages, "company_id", "left")
             .withColumn("has_data", F.col("_c").isNotNull() | F.col("_p").isNotNull()))
    pending = t["review"].filter(F.col("status") == "待复核")
    stats = None
    if tasks is not None:
        stats = company_task_stats(tasks)
    out = {
        "company_rows": board.company_rows(document),
        "progress": board.progress_rows(firms, stats),
        "sections": sections.company_sections(document, reviews),
        "alerts": alerts.derive_alerts(
            known, pending, document.agg(F.max("meta.generated_at").alias("t")).scalar()),
        "companies_by_status": metrics.companies_by_status(firms),
        "evidence": ev.evidence_with_source(
            t["evidence"].drop("run_id"), t["source"].select("source_id", "name", "url")),
    }
    if tasks is not None:
        out["tasks_by_phase_status"] = metrics.tasks_by_phase_status(tasks)
        out["audit_by_status"] = metrics.audit_by_status(tasks)
        out["phases"] = sections.phase_payloads(tasks)
    if files is not None:
        out["process_files"] = metrics.file_index(files)
    return out


def _map(df: DataFrame, key: str) -> DataFrame:
    """A short count table as one JSON object."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(key, F.lit("")).alias("k"), "n"))))
    return df.agg(F.to_json(pairs).alias("payload"))


def dashboard(tables: dict[str, DataFrame], firms: DataFrame, tasks: DataFrame | None = None,
              files: DataFrame | None = None, plan: DataFrame | None = None) -> DataFrame:
    """The run's dashboard, ``part, payload``: status counts, execution summary and audit
    as one row each; alerts and process files one row an item, since there can be any
    number of them. ``plan`` has an ``action`` per planned task."""
    line = lambda df: df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("payload"))
    parts = {"company_status": _map(tables["companies_by_status"], "status"), "alert": line(tables["alerts"])}
    if tasks is not None:
        none = tasks.limit(0).select(F.lit("").alias("action"))
        parts["execution_summary"] = line(metrics.kpi_board(firms, tasks, none if plan is None else plan))
        parts["task_audit"] = _map(tables["audit_by_status"], "status")
    if plan is not None:
        parts["plan_summary"] = _map(plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")), "action")
    if files is not None:
        parts["process_file"] = line(files.select("company_id", "kind", "path"))
    rows = [df.select(F.lit(name).alias("part"), "payload") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def publish_run(spark: SparkSession, path: str, folder: str, run_id: str,
                tasks: DataFrame | None = None, files: DataFrame | None = None,
                reviews: DataFrame | None = None, plan: DataFrame | None = None) -> None:
    """Read a snapshot, write its tables and the JSON of its dashboard, progress, sections
    and phases."""
    document = snap.read_snapshot(spark, path)
    tables = run_tables(document, tasks, files, reviews)
    firms = snap.normalise(document)["company"]
    progress = tables["progress"]
    tables["dashboard"] = dashboard(tables, firms, tasks, files, plan)
    publish.publish_tables(tables, f"{folder}/tables", run_id)
    for name in ("sections", "phases"):
        if name in tables:
            publish.publish_json(tables[name], f"{folder}/json/{name}", run_id)
    publish.publish_json(tables["dashboard"], f"{folder}/json/dashboard", run_id)
    body = F.to_json(F.struct(*[c for c in progress.columns if c != "company_id"]), {"ignoreNullFields": "false"})
    publish.publish_json(progress.select("company_id", body.alias("payload")), f"{folder}/json/progress", run_id)
