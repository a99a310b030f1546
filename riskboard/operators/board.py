"""The company board: wide rows, live merge, shown columns, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.labels import label, stage_shown, verdict_label
from ..functions.scale import slice_sorted
from ..functions.text import first_filled


def company_rows(snapshot: DataFrame) -> DataFrame:
    """Sixteen-column rows from nested company records (missing values are null)."""
    c = snapshot.select(F.col("meta.generated_at").alias("generated_at"),
                        F.explode("companies").alias("c"))
    size = lambda path: F.coalesce(F.array_size(path), F.lit(0))
    active = F.transform(F.filter("c.domain_activity", lambda d: d["is_active"]),
                         lambda d: d["domain"])
    words = F.flatten(F.transform("c.risk.risk_keyword_findings", lambda f: f["keywords"]))
    joined = lambda a: F.nullif(F.array_join(a, ","), F.lit(""))
    return c.select(
        F.col("c.name").alias("企业"), F.col("c.status").alias("状态"),
        size("c.icp.web").alias("ICP网站数"), size("c.icp.mapp").alias("ICP小程序数"),
        size("c.icp.app").alias("ICP应用数"), size("c.icp.kapp").alias("ICP快应用数"),
        size("c.website_search.candidates").alias("搜索候选官网数"),
        size("c.domain_activity").alias("互联网载体候选数"),
        size("c.website_crawl.seen_urls").alias("官网域名数"),
        joined(active).alias("活跃域名"),
        F.coalesce("c.social.count", F.lit(0)).alias("社媒账号数"),
        F.col("c.risk.overall_risk_found").alias("有风险"),
        F.col("c.risk.gold_buyback.present").alias("回购线索"),
        joined(words).alias("风险词"), F.col("c.risk.analysis_mode").alias("分析模式"),
        F.col("generated_at").alias("生成时间"))


def with_dash(df: DataFrame, *cols: str) -> DataFrame:
    """Write ``-`` for missing text, as the published rows do."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(fixed.NO_TEXT)) for c in cols})


def progress_rows(company: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Progress per company: status, current phase (``-`` once closed), task counts when
    there is a task table."""
    phase = F.when(F.col("status") == "CLOSED", fixed.NO_TEXT).otherwise(F.col("current_phase"))
    rows = company.select("company_id", "name", "status", phase.alias("current_phase"))
    if stats is None:
        return rows
    counts = stats.select("company_id", "total", "ok", "failed", "running")
    return rows.join(counts, "company_id", "left")


def company_facts(company: DataFrame, carriers: DataFrame, candidates: DataFrame, pages: DataFrame,
                  accounts: DataFrame, words: DataFrame) -> DataFrame:
    """The same row from long tables: each side is counted per company first, so the
    joins meet unique keys only."""
    per = lambda df, name: df.groupBy("company_id").agg(F.count(F.lit(1)).alias(name))
    kinds = carriers.groupBy("company_id").agg(*[
        F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in fixed.CARRIER_KINDS])
    out = company
    for side in (kinds, per(candidates, "n_candidates"), per(pages, "n_pages"),
                 per(accounts, "n_accounts")):
        out = out.join(side, "company_id", "left")
    out = out.join(words, "company_id", "left")
    counts = [f"n_{k}" for k in fixed.CARRIER_KINDS] + ["n_candidates", "n_pages", "n_accounts"]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def merge_live(complete: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Complete rows with live progress: the live status wins, then the complete
    one, then "unknown". Both sides hold a key once, so the full join is one to one."""
    full = complete.withColumn("_full", F.lit(True))
    live = live.select(key, *[F.col(c).alias(f"live_{c}") for c in live.columns if c != key])
    status = first_filled(F.col("live_status"), F.col("status"), F.lit(fixed.UNKNOWN))
    return (full.join(live, key, "full")
            .withColumn("status", F.coalesce(status, F.lit(fixed.UNKNOWN)))
            .withColumn("has_full", F.coalesce("_full", F.lit(False))).drop("_full", "live_status"))


def shown(board: DataFrame, key: str = "company_id") -> DataFrame:
    """Board columns as displayed."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return board.select(
        key, "name", "status", label("companyStatus", F.col("status")).alias("status_label"),
        stage_shown(F.col("status"), F.col("live_current_phase")).alias("stage"),
        verdict_label(F.col("risk")).alias("verdict_label"),
        F.coalesce("risk_words", F.lit(fixed.NO_VALUE)).alias("risk_words"),
        n("live_total").alias("n_tasks"), n("live_ok").alias("n_ok"),
        n("live_failed").alias("n_failed"), n("live_running").alias("n_running"), "has_full")


def overview(board: DataFrame, facts: DataFrame, shots: DataFrame) -> DataFrame:
    """Overview card: carrier total, page and account counts (a dash without a complete
    row), words, task progress when there are tasks, screenshots."""
    total = sum((F.col(f"n_{k}") for k in fixed.CARRIER_KINDS[1:]), F.col("n_web"))
    n_shots = shots.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_shots"))
    known = lambda c: F.when(F.col("has_full"), c.cast("string")).otherwise(fixed.NO_VALUE)
    progress = F.when(F.col("live_total") > 0, F.concat(
        F.col("live_ok").cast("string"), F.lit("成功 / "), F.col("live_failed").cast("string"),
        F.lit("失败 / "), F.col("live_running").cast("string"), F.lit("运行中")))
    cols = facts.select("company_id", *[f"n_{k}" for k in fixed.CARRIER_KINDS], "n_pages", "n_accounts")
    return (board.join(cols, "company_id", "left").join(n_shots, "company_id", "left").select(
        "company_id", known(total).alias("carriers"),
        known(F.col("n_pages")).alias("pages"), known(F.col("n_accounts")).alias("accounts"),
        F.coalesce("risk_words", F.lit(fixed.NO_VALUE)).alias("risk_words"),
        progress.alias("progress"), F.coalesce("n_shots", F.lit(0)).alias("n_shots")))


def page(df: DataFrame, order: list[str | Column], number: int, size: int = 20) -> DataFrame:
    """One page of the sorted board; ``order`` must end in a unique column. A number
    past the end shows the last page, as the board does."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    found = slice_sorted(df, cols, (number - 1) * size, size)
    if number == 1 or not found.isEmpty():
        return found
    total = df.count()  # only past the end
    return slice_sorted(df, cols, (max(1, -(-total // size)) - 1) * size, size)


def page_count(df: DataFrame, size: int = 20) -> DataFrame:
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("bigint").alias("pages"))


def result_count(before: DataFrame, predicate: Column) -> DataFrame:
    """Rows shown and rows in all, in one pass."""
    return before.agg(F.count_if(predicate).alias("shown"), F.count(F.lit(1)).alias("total"))
