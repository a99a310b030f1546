"""Run snapshots: nested read and the long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixed import CARRIER_KINDS, LOCAL_ZONE
from ..functions.scale import lookup
from ..schemas import COMPANY, META, SNAPSHOT, SOURCE
from ..session import shared_folder
from .longjson import elements


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents, one row each, from one file or a folder of files."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)


def _instant(c: str) -> Column:
    return F.try_to_timestamp(F.nullif(F.col(c), F.lit("")))


def normalise(snapshot: DataFrame) -> dict[str, DataFrame]:
    """The fifteen long tables of documents read as one row each."""
    return _tables(snapshot.select("meta.run_id", F.explode("companies").alias("c")),
                   snapshot.select("meta.run_id", F.explode("sources").alias("s")))


def normalise_long(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The fifteen long tables of documents that may be larger than a task should hold:
    each is read by as many tasks as it has splits, element by element."""
    shared_folder(spark)
    found = elements(spark, path).checkpoint()
    run = found.filter("name = 'meta'").groupBy("path").agg(F.min(F.from_json("value", META)["run_id"]).alias("run_id"))

    def part(name: str, schema: str, alias: str) -> DataFrame:
        rows = found.filter(F.col("name") == name).select("path", "seq", F.from_json("value", schema).alias(alias))
        return lookup(rows, run, ["path"], ["seq"]).select("run_id", alias)
    return _tables(part("companies", COMPANY, "c"), part("sources", SOURCE, "s"))


def _tables(companies: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """A company's id is its name's hash, so it needs no numbering pass and is the same in
    every run."""
    c = companies.select("run_id", F.xxhash64("c.name").alias("company_id"), "c.*")
    key = ["run_id", "company_id"]

    def unnest(path: str) -> DataFrame:
        return c.select(*key, F.posexplode(path).alias("pos", "r"))

    carriers = F.concat(*[
        F.transform(F.coalesce(f"icp.{k}", F.array().cast("array<struct<name string>>")
                               if k != "web" else
                               F.array().cast("array<struct<domain string, name string>>")),
                    _carrier(k)) for k in CARRIER_KINDS])
    inference = unnest("risk.inferences").select(
        *key, F.col("pos").alias("inference_id"), "r.text", "r.confidence", "r.basis")
    return {
        "company": c.select(
            *key, "name", "status", "current_phase", "risk.analysis_mode",
            F.col("risk.overall_risk_found").alias("risk"),
            F.col("risk.gold_buyback.present").alias("buyback"),
            F.col("risk.executive_summary").alias("summary")),
        "source": sources.select(
            "run_id", F.col("s.id").alias("source_id"), "s.name", "s.type", "s.url",
            _instant("s.observed_at").alias("observed_at")),
        "carrier": c.select(*key, F.inline(carriers)),
        "site_candidate": unnest("website_search.candidates").select(*key, "r.domain"),
        "seen_url": unnest("website_crawl.seen_urls").select(*key, "pos", F.col("r").alias("url")),
        "domain_activity": unnest("domain_activity").select(*key, "r.*"),
        "account": unnest("social.accounts").select(*key, "r.*"),
        "keyword_finding": unnest("risk.risk_keyword_findings").select(
            *key, "pos", "r.keywords", F.col("r.where").alias("location")),
        "scenario": unnest("risk.risk_scenarios").select(*key, "pos", "r.*"),
        "evidence": unnest("risk.evidence").select(
            *key, F.col("r.id").alias("evidence_id"), "r.claim", "r.source_id", "r.excerpt",
            _instant("r.observed_at").alias("observed_at"), "r.origin_url", "r.status"),
        "inference": inference.drop("basis"),
        "inference_basis": inference.select(
            *key, "inference_id", F.explode("basis").alias("evidence_id")),
        "uncertainty": unnest("risk.uncertainties").select(*key, "pos", F.col("r").alias("text")),
        "change_condition": unnest("risk.change_conditions").select(
            *key, "pos", F.col("r").alias("text")),
        "review": c.select(*key, "risk.human_review.*").withColumn(
            "reviewed_at", _instant("reviewed_at")),
    }


def _carrier(kind: str):
    domain = (lambda r: r["domain"]) if kind == "web" else (lambda r: F.lit(None).cast("string"))
    return lambda r, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"),
                                 domain(r).alias("domain"), r["name"].alias("name"))


def generated_at(snapshot: DataFrame) -> DataFrame:
    """Run time: written without a zone, meant in the local one."""
    local = F.to_timestamp_ntz("meta.generated_at")
    return snapshot.select("meta.run_id", F.convert_timezone(
        F.lit(LOCAL_ZONE), F.lit("UTC"), local).alias("generated_at_utc"))
