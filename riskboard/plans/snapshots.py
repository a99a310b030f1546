"""Run snapshots written as long documents and read back by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scale import lookup
from ..session import work_folder
from ..sources import publish
from ..sources import snapshot as snap
from ..sources import tables as tb
from ..sources.tables import Tables
from .registry import query
from .sql import rows_with

RUN = "run-1"


def documents(t: Tables) -> DataFrame:
    """A company object for each piece of evidence, as JSON."""
    firms = t.read("customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"))
    rows = lookup(tb.evidence(t), firms, ["company_id"], ["evidence_id"], "inner")
    evidence = F.struct(F.concat(F.lit("E"), F.col("evidence_id").cast("string")).alias("id"), F.col("scope").alias("claim"),
                        "source_id", F.col("content").alias("excerpt"), F.lit("2024-01-02T03:04:05+08:00").alias("observed_at"),
                        "origin_url", F.when(F.col("n_chars") > 0, "verified").otherwise("unavailable").alias("status"))
    web = F.struct(F.concat(F.lit("c"), F.col("company_id").cast("string"), F.lit(".example.com")).alias("domain"), "name")
    risk = F.struct(F.array(evidence).alias("evidence"), F.array(F.col("source_id")).alias("uncertainties"))
    return rows.select(F.to_json(F.struct("name", F.struct(F.array(web).alias("web")).alias("icp"), risk.alias("risk"))).alias("value"))


def _read(t: Tables) -> dict[str, DataFrame]:
    folder = work_folder(t.spark, "snapshot")
    publish.write_documents(documents(t), folder, RUN)
    return snap.normalise_long(t.spark, folder)


_OWNED = "owned AS (SELECT e.*, c_name AS name FROM evidence e JOIN customer ON c_custkey = company_id)"


@query("snapshot_evidence", rows_with("evidence", f"""
SELECT '{RUN}' AS run_id, name, 'E' || evidence_id AS evidence_id, scope AS claim, source_id, content AS excerpt, origin_url,
  CASE WHEN n_chars > 0 THEN 'verified' ELSE 'unavailable' END AS status FROM owned""", _OWNED))
def snapshot_evidence(t: Tables) -> DataFrame:
    """The evidence table of a snapshot, with its company's name."""
    tables = _read(t)
    names = tables["company"].groupBy("company_id").agg(F.min("name").alias("name"))
    return lookup(tables["evidence"], names, ["company_id"], ["evidence_id"], "inner").select(
        "run_id", "name", "evidence_id", "claim", "source_id", "excerpt", "origin_url", "status")


@query("snapshot_tables", rows_with("evidence", """
SELECT 'company' AS name, count(*) AS n, count(DISTINCT name) AS n_companies FROM owned UNION ALL
SELECT 'carrier', count(*), count(DISTINCT name) FROM owned UNION ALL
SELECT 'evidence', count(*), count(DISTINCT name) FROM owned UNION ALL
SELECT 'uncertainty', count(*), count(DISTINCT name) FROM owned UNION ALL
SELECT 'review', count(*), count(DISTINCT name) FROM owned UNION ALL
SELECT n, 0, 0 FROM (VALUES ('site_candidate'), ('seen_url'), ('domain_activity'), ('account'), ('keyword_finding'), ('scenario'),
  ('inference'), ('inference_basis'), ('change_condition')) AS v(n)""", _OWNED))
def snapshot_tables(t: Tables) -> DataFrame:
    """Rows and companies of each long table of a snapshot."""
    tables, out = _read(t), None
    for name, df in tables.items():
        if name == "source":  # belongs to no company
            continue
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct("company_id").alias("n_companies"))
        out = row if out is None else out.unionByName(row)
    return out
