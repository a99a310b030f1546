"""Human review: latest decision, overlay, queue, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.scale import as_of, latest_by, lookup

FIELDS = ["status", "reviewer", "decision", "note", "reviewed_at"]


def valid_reviews(review_event: DataFrame) -> DataFrame:
    """Reviews that name a company; an absent decision counts as accepted."""
    decision = F.coalesce(F.nullif(F.col("decision"), F.lit("")), F.lit(fixed.DEFAULT_DECISION))
    return review_event.filter(F.col("company_id").isNotNull()).withColumns(
        {"decision": decision, "note": F.coalesce("note", F.lit(""))})


def latest_review(review_event: DataFrame) -> DataFrame:
    """The last review of every company replaces earlier ones."""
    return latest_by(valid_reviews(review_event), ["company_id"], ["reviewed_at", "event_id"],
                     FIELDS + ["event_id"])


def overlay_review(section: DataFrame, latest: DataFrame, key: str = "company_id") -> DataFrame:
    """A stored review replaces the section's whole review record, where it has one."""
    new = latest.select(key, F.struct(*FIELDS).alias("_new"))
    has = F.col("human_review").isNotNull() & F.col("_new").isNotNull()
    return (section.join(new, key, "left")
            .withColumn("human_review", F.when(has, F.col("_new")).otherwise(F.col("human_review")))
            .drop("_new"))


def display_state(risk: Column, decision: Column) -> Column:
    """How the verdict is shown after review; the verdict itself is left alone."""
    return (F.when(decision == "标记误报", "dismissed").when(decision == "转人工", "escalated")
            .when(risk, "risk").when(~risk, "none").otherwise("undecided"))


def review_queue(verdict: DataFrame, latest: DataFrame) -> DataFrame:
    """Companies nobody has reviewed, risk first, then undecided, then clear ones."""
    done = latest.filter(F.col("status") == fixed.REVIEWED).select("company_id")
    risk = F.col("risk")
    return verdict.join(done, "company_id", "left_anti").select(
        "company_id", "risk", F.when(risk, 1).when(risk.isNull(), 2).otherwise(3).alias("priority"))


def feedback_set(verdict: DataFrame, review_event: DataFrame) -> DataFrame:
    """Corrected and false-alarm reviews with the verdict they speak about."""
    told = valid_reviews(review_event).filter(F.col("decision").isin("修改", "标记误报"))
    spoken = verdict.select("company_id", F.col("risk").alias("verdict"))
    return lookup(told, spoken, ["company_id"], ["event_id"], "inner").select(
        "event_id", "company_id", "verdict", "decision", "note")


def feedback_as_of(history: DataFrame, review_event: DataFrame) -> DataFrame:
    """Corrected and false-alarm reviews with the verdict as it stood when they were given.
    ``history``: ``company_id, ts, event_id, risk, status``, one row for each time the
    verdict was told anew. A review before the first one speaks about no verdict."""
    told = valid_reviews(review_event).filter(F.col("decision").isin("修改", "标记误报"))
    spoken = as_of(told, history.withColumnRenamed("event_id", "_told"), ["company_id"], "reviewed_at", "ts",
                   ["risk"], ["_told"])
    return spoken.select("event_id", "company_id", F.col("risk").alias("verdict"), "decision", "note")


def reviewed_history(history: DataFrame, review_event: DataFrame) -> DataFrame:
    """Each step of a verdict's history with the review that stood at its time, and the
    state shown then."""
    reviews = valid_reviews(review_event).select("company_id", "reviewed_at", F.col("event_id").alias("_review"), "decision")
    return as_of(history, reviews, ["company_id"], "ts", "reviewed_at", ["decision"], ["_review"]).select(
        "event_id", "company_id", "risk", "decision", display_state(F.col("risk"), F.col("decision")).alias("state"))


def review_mix(latest: DataFrame, n_companies: Column) -> DataFrame:
    """Reviews by decision, and the share of all companies each covers."""
    mix = latest.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    return mix.withColumn("share", F.round(F.col("n") / n_companies, 4))
