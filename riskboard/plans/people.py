"""Carriers, accounts, reviews, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.labels import found_label
from ..operators import alerts as al
from ..operators import carriers as ca
from ..operators import entities as en
from ..operators import review as rv
from ..sources import tables as tb
from ..sources.tables import Tables
from .boards import BOARD, board
from .evidence import VERDICT, verdict
from .registry import query
from .sql import NORM, owner, rows_with


@query("carrier_lookup", rows_with("page carrier", f"""
SELECT c_custkey AS company_id, c_name AS name, coalesce(n_web, 0) AS n_web, coalesce(n_mapp, 0) AS n_mapp,
  0::BIGINT AS n_app, 0::BIGINT AS n_kapp FROM customer LEFT JOIN (SELECT {NORM.format("'customer  #' || lpad(CAST(company_id AS VARCHAR), 9, '0') || ' '")} AS key,
    count(*) FILTER (WHERE kind = 'web') AS n_web, count(*) FILTER (WHERE kind = 'mapp') AS n_mapp
  FROM carrier GROUP BY 1) r ON r.key = {NORM.format('c_name')}"""))
def carrier_lookup(t: Tables) -> DataFrame:
    roster = t.read("customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"))
    return ca.lookup_carriers(roster, tb.registry(t))


@query("carrier_counts", rows_with("page carrier", """
SELECT company_id, count(*) FILTER (WHERE kind = 'web') AS n_web, count(*) FILTER (WHERE kind = 'mapp') AS n_mapp,
  count(*) FILTER (WHERE kind = 'app') AS n_app, count(*) FILTER (WHERE kind = 'kapp') AS n_kapp,
  count(*) AS n_total FROM carrier GROUP BY 1"""))
def carrier_counts(t: Tables) -> DataFrame:
    return ca.carrier_counts(tb.carrier(t))


@query("carrier_listing", rows_with("page carrier", """
SELECT company_id, CASE kind WHEN 'web' THEN 0 ELSE 1 END AS kind_idx, pos, '[' || kind || '] ' || domain AS line
FROM carrier"""))
def carrier_listing(t: Tables) -> DataFrame:
    return ca.carrier_listing(tb.carrier(t))


@query("similar_accounts", rows_with("page account", """,
firm AS (SELECT site AS name, min(domain) AS domain, count(DISTINCT domain) AS n FROM page WHERE site <> '' GROUP BY 1)
SELECT company_id, platform, a.name AS account, domain AS like_company_id, f.name AS like_name, n AS n_like,
  CAST(levenshtein(a.name, f.name) AS INT) AS dist FROM account a JOIN firm f
ON levenshtein(a.name, f.name) <= 1 WHERE a.name <> ''"""))
def similar_accounts(t: Tables) -> DataFrame:
    firms = tb.page_host(t).select(F.col("domain").alias("company_id"), F.col("site").alias("name")).distinct()
    return en.similar_accounts(tb.account(t), firms, 1)


@query("account_top_k", rows_with("page account", """
SELECT company_id, platform, name, score, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY company_id
  ORDER BY score DESC, name, platform) AS rn FROM account) WHERE rn <= 2"""))
def account_top_k(t: Tables) -> DataFrame:
    return en.rank_accounts(tb.account(t), 2)


_DECIDED = """decided AS (
  SELECT a.*, CASE WHEN coalesce(b.status, '') <> 'CLOSED'
      OR NOT EXISTS (SELECT 1 FROM carrier c WHERE c.company_id = a.company_id) THEN '待复核'
    WHEN official_status = '未认证' THEN '非官方' ELSE '疑似官方' END AS decision
  FROM account a LEFT JOIN board b ON b.company_id = a.company_id)"""


def decided(t: Tables) -> DataFrame:
    return en.decide_accounts(tb.account(t), board(t), tb.carrier(t))


@query("account_decision", rows_with(BOARD + " page account carrier", """
SELECT company_id, platform, name, official_status, decision FROM decided""", _DECIDED))
def account_decision(t: Tables) -> DataFrame:
    return decided(t).select("company_id", "platform", "name", "official_status", "decision")


@query("account_listing", rows_with(BOARD + " page account carrier", """
SELECT company_id, '[' || platform || '] ' || name || ' · ' || decision || ' · ' || official_status AS line
FROM decided""", _DECIDED))
def account_listing(t: Tables) -> DataFrame:
    return en.account_listing(decided(t))


@query("section_listing", rows_with(BOARD + " page account carrier evidence hits verdict", """
SELECT company_id, 'icp' AS section, '[' || kind || '] ' || domain AS line FROM carrier
UNION ALL SELECT company_id, 'website', url FROM page
UNION ALL SELECT company_id, 'social', '[' || platform || '] ' || name || ' · ' || decision || ' · ' || official_status FROM decided
UNION ALL SELECT company_id, 'risk', CASE WHEN risk THEN '是' WHEN NOT risk THEN '否' ELSE '待判定' END || ' · ' || reason FROM verdict""", _DECIDED))
def section_listing(t: Tables) -> DataFrame:
    """Lines of the four sections beside evidence, from the long tables."""
    part = lambda df, name, line: df.select("company_id", F.lit(name).alias("section"), line.alias("line"))
    risk = F.concat(found_label(F.col("risk")), F.lit(" · "), F.col("reason"))
    return (part(ca.carrier_listing(tb.carrier(t)), "icp", F.col("line"))
            .unionByName(part(tb.page_host(t), "website", F.col("url")))
            .unionByName(part(en.account_listing(decided(t)), "social", F.col("line")))
            .unionByName(part(verdict(t), "risk", risk)))


@query("entity_alignment", rows_with("page", """
SELECT domain, min(domain) OVER (PARTITION BY CASE WHEN site = '' THEN 'domain ' || domain ELSE 'name ' || site END) AS entity_id
FROM (SELECT DISTINCT domain, site FROM page)"""))
def entity_alignment(t: Tables) -> DataFrame:
    return en.align_entities(tb.page_host(t).select("domain", F.col("site").alias("name")))


@query("latest_review", rows_with("review latest", """
SELECT company_id, status, reviewer, decision, note, event_id FROM latest"""))
def latest_review(t: Tables) -> DataFrame:
    return rv.latest_review(tb.review_event(t)).drop("reviewed_at")


@query("review_overlay", rows_with(VERDICT + " review latest", f""",
old AS (SELECT {owner('doc_id')} AS company_id, max(quality) AS q FROM labels GROUP BY 1)
SELECT o.company_id, coalesce(l.status, CASE WHEN q = 1 THEN '已复核' ELSE '待复核' END) AS status,
  coalesce(l.reviewer, 'base') AS reviewer, coalesce(l.decision, CASE WHEN q = 1 THEN '采纳' ELSE '' END) AS decision,
  coalesce(l.note, '') AS note, CASE coalesce(l.decision, '') WHEN '标记误报' THEN 'dismissed' WHEN '转人工' THEN 'escalated'
    ELSE CASE WHEN v.risk THEN 'risk' WHEN NOT v.risk THEN 'none' ELSE 'undecided' END END AS display_state
FROM old o LEFT JOIN latest l ON l.company_id = o.company_id LEFT JOIN verdict v ON v.company_id = o.company_id"""))
def review_overlay(t: Tables) -> DataFrame:
    good = F.max("quality") == 1
    record = F.struct(
        F.when(good, fixed.REVIEWED).otherwise(fixed.PENDING_REVIEW).alias("status"),
        F.lit("base").alias("reviewer"), F.when(good, "采纳").otherwise("").alias("decision"),
        F.lit("").alias("note"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"))
    section = t.read("labels").groupBy(t.owner("doc_id").alias("company_id")).agg(record.alias("human_review"))
    shown = rv.overlay_review(section, rv.latest_review(tb.review_event(t)))
    return shown.join(verdict(t).select("company_id", "risk"), "company_id", "left").select(
        "company_id", "human_review.status", "human_review.reviewer", "human_review.decision",
        "human_review.note",
        rv.display_state(F.col("risk"), F.col("human_review.decision")).alias("display_state"))


def queue(t: Tables) -> DataFrame:
    return rv.review_queue(verdict(t), rv.latest_review(tb.review_event(t)))


@query("review_queue", rows_with(VERDICT + " review latest", """
SELECT company_id, risk, CASE WHEN risk THEN 1 WHEN risk IS NULL THEN 2 ELSE 3 END AS priority
FROM verdict WHERE company_id NOT IN (SELECT company_id FROM latest)"""))
def review_queue(t: Tables) -> DataFrame:
    return queue(t)


@query("feedback_set", rows_with(VERDICT + " review", """
SELECT event_id, r.company_id, v.risk AS verdict, decision, note FROM review r
JOIN verdict v ON v.company_id = r.company_id WHERE decision IN ('修改', '标记误报')"""))
def feedback_set(t: Tables) -> DataFrame:
    return rv.feedback_set(verdict(t), tb.review_event(t))


@query("feedback_as_of", rows_with("te history review", """
SELECT r.event_id, r.company_id, h.risk AS verdict, decision, note FROM (SELECT * FROM review WHERE decision IN ('修改', '标记误报')) r
ASOF LEFT JOIN history h ON h.company_id = r.company_id AND r.reviewed_at >= h.ts"""))
def feedback_as_of(t: Tables) -> DataFrame:
    return rv.feedback_as_of(tb.verdict_event(t), tb.review_event(t))


@query("verdict_history", rows_with("te history review", """
SELECT h.event_id, h.company_id, risk, decision, CASE WHEN decision = '标记误报' THEN 'dismissed' WHEN decision = '转人工' THEN 'escalated'
  WHEN risk THEN 'risk' WHEN NOT risk THEN 'none' ELSE 'undecided' END AS state
FROM history h ASOF LEFT JOIN (SELECT company_id, reviewed_at, decision FROM review) r
ON h.company_id = r.company_id AND h.ts >= r.reviewed_at"""))
def verdict_history(t: Tables) -> DataFrame:
    return rv.reviewed_history(tb.verdict_event(t), tb.review_event(t))


@query("review_mix", rows_with("review latest", """
SELECT decision, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE), 4) AS share
FROM latest GROUP BY 1"""))
def review_mix(t: Tables) -> DataFrame:
    firms = t.read("customer").agg(F.count(F.lit(1)).alias("n")).scalar()
    return rv.review_mix(rv.latest_review(tb.review_event(t)), firms)


@query("alerts", rows_with(VERDICT + " review latest", """,
a AS (SELECT c.company_id, name, analysis_mode, EXISTS (SELECT 1 FROM carrier k WHERE k.company_id = c.company_id) AS has_data
  FROM company c)
SELECT (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events) AS time, * FROM (
SELECT 'info' AS level, 'loaded' AS code, CAST(NULL AS VARCHAR) AS company_id, '加载离线快照，共 ' || count(*) || ' 家企业' AS text FROM company
UNION ALL SELECT 'warning', CASE WHEN has_data THEN 'degraded' ELSE 'data_missing' END, CAST(company_id AS VARCHAR),
  name || CASE WHEN has_data THEN '：LLM 不可用，自动降级为本地关键词规则' ELSE '：备案/官网数据缺失，结论已降级为“待核实”' END
  FROM a WHERE NOT has_data OR analysis_mode = 'conservative_local_fallback'
UNION ALL SELECT 'info', 'pending', NULL, '待人工复核 ' || count(*) || ' 家' FROM verdict
  WHERE company_id NOT IN (SELECT company_id FROM latest))"""))
def alerts(t: Tables) -> DataFrame:
    data = tb.carrier(t).select("company_id").distinct().withColumn("_d", F.lit(True))
    firms = tb.company(t).select("company_id", "name", "analysis_mode").join(data, "company_id", "left")
    firms = firms.withColumn("has_data", F.coalesce("_d", F.lit(False)))
    last = t.read("events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("t"))
    return al.derive_alerts(firms, queue(t), last.scalar())


_ERRORS = """errors AS (
  SELECT event_id, CASE k % 4 WHEN 0 THEN 'API key missing' WHEN 1 THEN 'companies list is empty'
    WHEN 2 THEN error_code ELSE '' END AS text FROM te WHERE status = 'FAILED')"""


def error_texts(events: DataFrame) -> DataFrame:
    """Error texts of failed tasks."""
    k = F.col("k") % 4
    return events.filter(F.col("status") == "FAILED").select(
        "event_id", F.when(k == 0, "API key missing").when(k == 1, "companies list is empty")
        .when(k == 2, F.col("error_code")).otherwise("").alias("text"))


ROUTED = rows_with("te", """
SELECT event_id, text, CASE WHEN contains(text, 'API key') OR contains(text, 'companies') THEN 'critical'
  ELSE 'warning' END AS level FROM errors WHERE text <> ''""", _ERRORS)


@query("alert_routing", ROUTED)
def alert_routing(t: Tables) -> DataFrame:
    return al.route_alerts(error_texts(tb.task_event(t)))
