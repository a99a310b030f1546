"""Quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4))


def recall(flagged: DataFrame, label: DataFrame, key: str = "company_id") -> DataFrame:
    """True positives, misses and recall over labelled-risk items: companies, flagged by
    their verdict. Both sides shrink to distinct keys before the join."""
    hit = flagged.select(key).distinct().withColumn("_hit", F.lit(True))
    risky = label.filter("risky").select(key).distinct()
    tp = F.count("_hit")
    return risky.join(hit, key, "left").agg(
        tp.alias("tp"), (F.count(F.lit(1)) - tp).alias("fn"),
        _share(tp, F.count(F.lit(1))).alias("recall"))


def quality_kpis(support: DataFrame, recall_row: DataFrame, publishable: DataFrame,
                 reviewed: DataFrame) -> DataFrame:
    """Citation completeness, share of conclusions without verified evidence, recall of
    labelled risk, review coverage of publishable companies; one row per figure."""
    n = F.count(F.lit(1))
    basis = support.agg(F.struct(
        _share(F.count_if(F.col("n_resolved") == F.col("n_basis")), n).alias("complete"),
        _share(F.count_if(F.col("n_verified") == 0), n).alias("unsupported")).alias("b"))
    seen = reviewed.select("company_id").distinct().withColumn("_r", F.lit(True))
    cover = publishable.join(seen, "company_id", "left").agg(_share(F.count("_r"), n).alias("c"))
    one = support.sparkSession.range(1).select(
        basis.scalar().alias("b"), recall_row.select("recall").scalar().alias("recall"),
        cover.scalar().alias("cover"))
    row = lambda name, c: F.struct(F.lit(name).alias("metric"), F.col(c).alias("value"))
    return one.select(F.inline(F.array(
        row("citation_completeness", "b.complete"), row("unsupported_rate", "b.unsupported"),
        row("high_risk_recall", "recall"), row("review_coverage", "cover"))))
