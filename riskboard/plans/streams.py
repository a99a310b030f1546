"""Streaming jobs run to the end of their input; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import taken, work_folder
from ..sources.tables import Tables
from ..streaming import jobs, machine, sinks, sources
from .people import ROUTED, error_texts
from .registry import query
from .sql import rows_with
from .texts import LOG_SQL


# how late a feed may deliver an event again: the whole of the benchmark's month
LATENESS = "60 days"


@query("stream_latest_state", rows_with("te", """
SELECT company_id, status, phase, event_id FROM (SELECT *, row_number() OVER (
  PARTITION BY company_id ORDER BY ts DESC, event_id DESC) AS rn FROM te) WHERE rn = 1"""))
def stream_latest_state(t: Tables) -> DataFrame:
    out = work_folder(t.spark, "live")
    sinks.drain(jobs.live_state(sources.task_events(t.spark, t.folder)), out, mode="update")
    return taken(sinks.current(t.spark, out, ["company_id"]), out)


@query("stream_phase_machine", rows_with("te task stats", """
SELECT t.company_id, phase, task_dir, status, attempts, closed FROM task t JOIN stats s ON s.company_id = t.company_id"""))
def stream_phase_machine(t: Tables) -> DataFrame:
    out = work_folder(t.spark, "phases")
    sinks.drain(jobs.phase_progress(sources.task_events(t.spark, t.folder), LATENESS), out, mode="update")
    return taken(jobs.phase_machine(t.spark, out), out)


@query("stream_live_board", rows_with("te review latest", """,
last AS (SELECT company_id, status, phase FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM te) WHERE rn = 1)
SELECT coalesce(l.company_id, r.company_id) AS company_id, l.status, phase, decision, reviewer
FROM last l FULL OUTER JOIN latest r ON r.company_id = l.company_id"""))
def stream_live_board(t: Tables) -> DataFrame:
    out = work_folder(t.spark, "live-board")
    events, reviews = sources.task_events(t.spark, t.folder), sources.review_events(t.spark, t.folder)
    sinks.drain(jobs.live_board(events, reviews), out, mode="update")
    return taken(sinks.current(t.spark, out, ["company_id"]), out)


# hours a retry may wait, days an event may come late
WAIT_HOURS, LATE_DAYS = 24, 3

_STEP = " ".join(f"WHEN '{old}' THEN new IN ({', '.join(map(repr, to)) or 'NULL'})" for old, to in machine.ALLOWED.items())


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("stream_task_machine", _recursive(rows_with("te", f"""
SELECT company_id, phase, task_dir, CASE WHEN over THEN 'FAILED' ELSE status END AS status,
  CASE WHEN over THEN since + {WAIT_HOURS * 3600} * 1000000::BIGINT ELSE since END AS since, attempts, refused,
  CASE WHEN over THEN expired + 1 ELSE expired END AS expired
FROM (SELECT *, status = 'RETRY_WAIT' AND since + {WAIT_HOURS * 3600} * 1000000::BIGINT <=
    (SELECT max(epoch_us(ts)) // 1000 * 1000 - {LATE_DAYS * 86400} * 1000000::BIGINT FROM events) AS over,
  row_number() OVER (PARTITION BY company_id, task_dir ORDER BY rn DESC) AS back FROM fold) WHERE back = 1""", f"""e AS MATERIALIZED (
  SELECT company_id, phase, task_dir, epoch_us(ts) AS us, status AS new,
    row_number() OVER (PARTITION BY company_id, task_dir ORDER BY ts, event_id) AS rn FROM te)""", f"""fold AS (
  SELECT company_id, phase, task_dir, rn, new AS status, us AS since, CAST(new IN ('FAILED', 'RETRY_WAIT') AS BIGINT) AS attempts,
    0::BIGINT AS refused, 0::BIGINT AS expired FROM e WHERE rn = 1
  UNION ALL
  SELECT company_id, phase, task_dir, rn, CASE WHEN ok THEN new ELSE old END,
    CASE WHEN ok AND new <> old THEN us WHEN over THEN since + {WAIT_HOURS * 3600} * 1000000::BIGINT ELSE since END,
    attempts + CAST(ok AND new <> old AND new IN ('FAILED', 'RETRY_WAIT') AS BIGINT),
    refused + CAST(NOT ok AS BIGINT), expired + CAST(over AS BIGINT)
  FROM (SELECT *, new = old OR coalesce(CASE old {_STEP} END, false) AS ok FROM (
    SELECT *, CASE WHEN over THEN 'FAILED' ELSE status END AS old FROM (
      SELECT f.*, e.us, e.new, f.status = 'RETRY_WAIT' AND f.since + {WAIT_HOURS * 3600} * 1000000::BIGINT <= e.us AS over
      FROM (SELECT company_id, phase, task_dir, rn + 1 AS rn, status, since, attempts, refused, expired FROM fold) f
      JOIN e ON e.company_id = f.company_id AND e.task_dir = f.task_dir AND e.rn = f.rn))))""")))
def stream_task_machine(t: Tables) -> DataFrame:
    out, own = work_folder(t.spark, "machine"), machine.session(t.spark)
    state = machine.task_machine(sources.task_events(own, t.folder), f"{LATE_DAYS} days", WAIT_HOURS * 3600)
    sinks.drain(state, out, mode="update")
    rows = taken(sinks.current(t.spark, out, machine.KEYS), out)
    return machine.current_tasks(rows).withColumn("since", F.unix_micros("since"))


def _reviews(t: Tables) -> str:
    feed = sources.once(sources.review_events(t.spark, t.folder), "event_id", "reviewed_at", LATENESS)
    return sinks.drain(feed, work_folder(t.spark, "reviews"), split=jobs.review_outputs())


@query("stream_review_upsert", rows_with("review latest", """
SELECT company_id, status, reviewer, decision, note, event_id FROM latest"""))
def stream_review_upsert(t: Tables) -> DataFrame:
    out = _reviews(t)
    return taken(jobs.current_reviews(t.spark, out).drop("reviewed_at"), out)


@query("stream_review_audit", rows_with("review", """
SELECT event_id, company_id, status, reviewer, decision, note FROM review"""))
def stream_review_audit(t: Tables) -> DataFrame:
    out = _reviews(t)
    return taken(sinks.rows(t.spark, out, "audit").drop("reviewed_at", "batch_id"), out)


@query("stream_post_upsert", "SELECT conv_id, turn, role, text FROM conversations")
def stream_post_upsert(t: Tables) -> DataFrame:
    # a post is known by conversation and turn; a later delivery is its newer version, and
    # posts of one delivery have no order: none of them takes another's place
    keys, out = ["conv_id", "turn"], work_folder(t.spark, "posts")
    sinks.drain(sources.posts(t.spark, t.folder), out, split=jobs.post_outputs(keys))
    return taken(jobs.current_posts(t.spark, out, keys), out)


@query("stream_log_lines", LOG_SQL)
def stream_log_lines(t: Tables) -> DataFrame:
    out = work_folder(t.spark, "log")
    posts = sources.posts(t.spark, t.folder).select("conv_id", "turn", "text")
    sinks.drain(jobs.stream_log_lines(posts, "text", ["conv_id", "turn"]), out)
    return taken(sinks.rows(t.spark, out).drop("batch_id"), out)


@query("stream_alert_routing", ROUTED)
def stream_alert_routing(t: Tables) -> DataFrame:
    out = work_folder(t.spark, "alerts")
    sinks.drain(jobs.stream_alerts(error_texts(sources.task_events(t.spark, t.folder))), out)
    return taken(sinks.rows(t.spark, out).drop("batch_id"), out)
