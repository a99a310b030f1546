"""Board, progress, metrics, tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.labels import decode, label as label_of, label_dim
from ..functions.text import last_part
from ..operators import board as bd
from ..operators import chain, keys, metrics, review, screening, search
from ..operators import sections as sec
from ..operators import tasks as tk
from ..sources import files, tables as tb
from ..sources.tables import Tables
from .registry import query
from .sql import label, rows_with

BOARD = "te task stats live company board"


def task(t: Tables) -> DataFrame:
    return tk.task_state(tb.task_event(t))


def board(t: Tables) -> DataFrame:
    return bd.merge_live(tb.company(t), tk.live_rows(task(t)), "company_id")


@query("company_board", rows_with(BOARD, f"""
SELECT company_id, name, status, {label('companyStatus', 'status')} AS status_label,
  CASE WHEN status = 'CLOSED' THEN '已完成'
    WHEN current_phase IS NOT NULL AND current_phase NOT IN ('', '-', '待判定')
      THEN {label('phase', 'current_phase')} ELSE '待判定' END AS stage,
  CASE WHEN risk THEN '有风险' WHEN NOT risk THEN '未发现' ELSE '待判定' END AS verdict_label,
  coalesce(risk_words, '—') AS risk_words, coalesce(total, 0) AS n_tasks, coalesce(ok, 0) AS n_ok,
  coalesce(failed, 0) AS n_failed, coalesce(running, 0) AS n_running, has_full FROM board"""))
def company_board(t: Tables) -> DataFrame:
    return bd.shown(board(t))


@query("latest_state", rows_with("te", """
SELECT company_id, status, phase, event_id FROM (SELECT *, row_number() OVER (
  PARTITION BY company_id ORDER BY ts DESC, event_id DESC) AS rn FROM te) WHERE rn = 1"""))
def latest_state(t: Tables) -> DataFrame:
    return tk.latest_events(tb.task_event(t))


@query("company_task_stats", rows_with("te task stats live", """
SELECT company_id, total, ok, failed, running, current_phase, closed, screened FROM live"""))
def company_task_stats(t: Tables) -> DataFrame:
    return tk.company_task_stats(task(t))


@query("companies_by_status", rows_with(BOARD, "SELECT status, count(*) AS n FROM board GROUP BY 1"))
def companies_by_status(t: Tables) -> DataFrame:
    return metrics.companies_by_status(board(t))


@query("tasks_by_phase_status", rows_with("te task", """
SELECT phase, status, count(*) AS n FROM task GROUP BY GROUPING SETS ((phase, status), ())"""))
def tasks_by_phase_status(t: Tables) -> DataFrame:
    return metrics.tasks_by_phase_status(task(t))


@query("audit_by_status", rows_with("te task", """
SELECT s.status, count(t.status) AS n
FROM (VALUES ('FAILED'), ('RETRY_WAIT'), ('RUNNING'), ('PENDING')) AS s(status)
LEFT JOIN task t ON t.status = s.status GROUP BY 1"""))
def audit_by_status(t: Tables) -> DataFrame:
    return metrics.audit_by_status(task(t))


_REUSE = """plan AS (
  SELECT event_id, company_id, phase, input_sha, CASE WHEN EXISTS (SELECT 1 FROM te d
      WHERE d.status = 'OK' AND d.company_id = te.company_id AND d.phase_idx = te.phase_idx
        AND d.input_sha = te.input_sha AND (d.ts < te.ts OR (d.ts = te.ts AND d.event_id < te.event_id)))
    THEN 'HISTORY_REUSE' ELSE 'PROCESS' END AS action FROM te)"""


def reuse_plan(t: Tables) -> DataFrame:
    plan = tb.task_event(t).select("event_id", "ts", "company_id", "phase", "input_sha", "status")
    done = plan.filter(F.col("status") == "OK")
    return tk.split_reuse(plan, done, ["company_id", "phase", "input_sha"], ["event_id"],
                          ["ts", "event_id"])


@query("history_reuse", rows_with("te", """
SELECT event_id, company_id, phase, input_sha, action FROM plan""", _REUSE))
def history_reuse(t: Tables) -> DataFrame:
    return reuse_plan(t).select("event_id", "company_id", "phase", "input_sha", "action")


@query("kpi_board", rows_with(BOARD, """,
a AS (SELECT count(*) AS tasks, count(*) FILTER (WHERE status = 'FAILED') AS f,
    count(*) FILTER (WHERE status = 'RETRY_WAIT') AS r,
    count(*) FILTER (WHERE status IN ('RETRY_WAIT', 'RUNNING', 'PENDING')) AS w FROM task),
b AS (SELECT count(*) FILTER (WHERE status = 'CLOSED') AS done,
    count(*) FILTER (WHERE status IN ('CLOSED', 'OPEN')) AS companies,
    count(*) FILTER (WHERE analysis_mode = 'conservative_local_fallback') AS degraded FROM board),
p AS (SELECT count(*) FILTER (WHERE action = 'HISTORY_REUSE') AS reused,
    count(*) FILTER (WHERE action = 'PROCESS') AS processed FROM plan)
SELECT done, companies, tasks - w AS terminal, tasks, w AS unfinished,
  CAST(floor((tasks - f - w) / CAST(tasks AS DOUBLE) * 100 + 0.5) AS BIGINT) AS success_pct,
  f + r AS abnormal, reused, processed, degraded FROM a, b, p""", _REUSE))
def kpi_board(t: Tables) -> DataFrame:
    return metrics.kpi_board(board(t), task(t), reuse_plan(t))


@query("published_kpis", rows_with(BOARD + " review latest", """
SELECT done, companies, tasks - w AS terminal, tasks, w AS unfinished,
  CASE WHEN tasks > 0 THEN CAST(floor((tasks - f - w) / CAST(tasks AS DOUBLE) * 100 + 0.5) AS BIGINT) END AS success_pct,
  tasks - f - w AS succeeded, f + r AS abnormal, 0::BIGINT AS reused, tasks AS processed
FROM (SELECT count(*) FILTER (WHERE status = 'CLOSED') AS done, count(*) AS companies FROM live),
  (SELECT count(*) AS tasks, count(*) FILTER (WHERE status = 'FAILED') AS f, count(*) FILTER (WHERE status = 'RETRY_WAIT') AS r,
     count(*) FILTER (WHERE status IN ('RETRY_WAIT', 'RUNNING'))
     + (SELECT count(*) FROM live l WHERE l.company_id NOT IN (SELECT company_id FROM latest)) AS w FROM task)"""))
def published_kpis(t: Tables) -> DataFrame:
    """The published formula over counts kept as text, where ``pending`` counts reviews
    still open; a missing count is zero."""
    rows = task(t)
    live = tk.live_rows(rows)
    reviewed = review.latest_review(tb.review_event(t)).select("company_id")
    counts = rows.agg(F.count(F.lit(1)).alias("tasks"), *[
        F.count_if(F.col("status") == code).alias(name) for code, name in (("FAILED", "failed"), ("RETRY_WAIT", "retry"), ("RUNNING", "running"))])
    runs = live.agg(F.struct(F.count_if(F.col("closed")).alias("closed"), F.count_if(~F.col("closed")).alias("open")).alias("r"))
    pending = live.join(reviewed, "company_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    row = counts.select("*", runs.scalar().alias("r"), pending.scalar().alias("pending"))
    kept = {c: F.col(c).cast("string") for c in ("tasks", "failed", "retry", "running", "pending")}
    stored = row.select(*[v.alias(k) for k, v in kept.items()], F.col("r.closed").cast("string").alias("closed"),
                        F.col("r.open").cast("string").alias("open"), F.lit("").alias("reused"), F.col("tasks").alias("processed"))
    return metrics.kpi_from_counts(stored)


@query("error_attribution", rows_with("te task", f"""
SELECT error_code, {label('error', 'error_code')} AS label, count(*) AS n FROM task
WHERE status IN ('FAILED', 'RETRY_WAIT') GROUP BY ALL"""))
def error_attribution(t: Tables) -> DataFrame:
    return tk.error_attribution(task(t))


@query("degraded_share", rows_with("company", """
SELECT count(*) FILTER (WHERE analysis_mode = 'conservative_local_fallback') AS n,
  count(*) AS total FROM company"""))
def degraded_share(t: Tables) -> DataFrame:
    return metrics.degraded_count(tb.company(t))


_SHOWN = "SELECT company_id, name, status, risk, risk_words FROM board"
_HAY = "lower(concat_ws(' ', coalesce(name, ''), coalesce(risk_words, ''), coalesce(active_domains, '')))"


def _cols(df: DataFrame) -> DataFrame:
    return df.select("company_id", "name", "status", "risk", "risk_words")


@query("board_search", rows_with(BOARD, f"{_SHOWN} WHERE contains({_HAY}, 'machinery')"))
def board_search(t: Tables) -> DataFrame:
    return _cols(search.search(board(t), "　 Machinery "))


@query("status_filter", rows_with(BOARD, f"{_SHOWN} WHERE status = 'CLOSED'"))
def status_filter(t: Tables) -> DataFrame:
    return _cols(search.search(board(t), status="CLOSED"))


@query("risk_filter", rows_with(BOARD, f"{_SHOWN} WHERE risk OR trim(coalesce(risk_words, '')) <> ''"))
def risk_filter(t: Tables) -> DataFrame:
    return _cols(search.search(board(t), risk_only=True))


@query("board_page", rows_with(BOARD, f"{_SHOWN} ORDER BY name, company_id LIMIT 20 OFFSET 40"))
def board_page(t: Tables) -> DataFrame:
    return bd.page(_cols(board(t)), ["name", "company_id"], 3, 20)


@query("page_count", rows_with(BOARD, "SELECT CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS pages FROM board"))
def page_count(t: Tables) -> DataFrame:
    return bd.page_count(board(t), 50)


@query("result_count", rows_with(BOARD, f"""
SELECT count(*) FILTER (WHERE contains({_HAY}, 'machinery')) AS shown, count(*) AS total FROM board"""))
def result_count(t: Tables) -> DataFrame:
    return bd.result_count(board(t), search.text_match("machinery"))


@query("union_names", """
SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer
  UNION ALL SELECT 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') FROM events)""")
def union_names(t: Tables) -> DataFrame:
    live = t.read("events").select(F.format_string("Customer#%09d", "user_id").alias("name"))
    return keys.union_names(t.read("customer").select(F.col("c_name").alias("name")), live)


@query("roster_names", r"""
SELECT DISTINCT name FROM (SELECT regexp_replace(line, '^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$', '', 'g') AS name
  FROM (SELECT '  ' || s_name || chr(12288) AS line FROM supplier UNION ALL SELECT c_name FROM customer
    UNION ALL SELECT ' ' FROM nation)) WHERE name <> ''""")
def roster_names(t: Tables) -> DataFrame:
    lines = (t.read("supplier").select(F.concat(F.lit("  "), "s_name", F.lit("　")).alias("value"))
             .union(t.read("customer").select("c_name")).union(t.read("nation").select(F.lit(" "))))
    return keys.roster_names(lines)


@query("last_by_key", """
SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def last_by_key(t: Tables) -> DataFrame:
    rows = t.read("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    last = keys.last_by_key(rows, "o_custkey", ["o_orderdate", "o_orderkey"])
    return last.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("replay_selection", rows_with("te task company", """
SELECT company_id, name FROM company
WHERE company_id IN (SELECT company_id FROM task WHERE status = 'FAILED')"""))
def replay_selection(t: Tables) -> DataFrame:
    failed = task(t).filter(F.col("status") == "FAILED")
    return tk.select_replay(tb.company(t).select("company_id", "name"), failed)


@query("label_decode", f"""
WITH codes AS (SELECT 'taskStatus' AS grp, CASE event_type WHEN 'purchase' THEN 'OK'
    WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN '' ELSE event_type END AS code FROM events
  UNION ALL SELECT 'companyStatus', o_orderstatus FROM orders
  UNION ALL SELECT 'companyStatus', 'CLOSED' FROM orders WHERE o_orderstatus = 'F')
SELECT grp, code, count(*) AS n, CASE WHEN grp = 'taskStatus' THEN {label('taskStatus', 'code')}
  ELSE {label('companyStatus', 'code')} END AS label FROM codes GROUP BY grp, code""")
def label_decode(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    codes = t.read("events").select(
        F.lit("taskStatus").alias("grp"), F.when(kind == "purchase", "OK").when(kind == "error", "FAILED")
        .when(kind == "signup", "").otherwise(kind).alias("code"))
    orders = t.read("orders").select(F.lit("companyStatus"), "o_orderstatus")
    closed = t.read("orders").filter("o_orderstatus = 'F'").select(F.lit("companyStatus"), F.lit("CLOSED"))
    counted = codes.union(orders).union(closed).groupBy("grp", "code").agg(F.count(F.lit(1)).alias("n"))
    return decode(counted, label_dim(t.spark)).select("grp", "code", "n", "label")


@query("task_card", rows_with("te", f"""
SELECT event_id, CASE k % 3 WHEN 0 THEN 'task ' || k WHEN 1 THEN 'https://x.example.com/' || k
    ELSE task_dir END AS title,
  {label('taskStatus', 'status')} AS status_label,
  CASE k % 3 WHEN 0 THEN '{{' || chr(10) || '  "title": "task ' || k || '",' || chr(10) || '  "type": "' || event_type || '"' || chr(10) || '}}'
    WHEN 1 THEN '{{' || chr(10) || '  "url": "https://x.example.com/' || k || '"' || chr(10) || '}}'
    ELSE '{{}}' END AS detail FROM te"""))
def task_card(t: Tables) -> DataFrame:
    k = F.col("k").cast("string")
    none = F.lit(None).cast("map<string,string>")
    summary = (F.when(F.col("k") % 3 == 0, F.create_map(
        F.lit("title"), F.concat(F.lit("task "), k), F.lit("type"), F.col("event_type")))
        .when(F.col("k") % 3 == 1, F.create_map(
            F.lit("url"), F.concat(F.lit("https://x.example.com/"), k))).otherwise(none))
    rows = tb.task_event(t).select("event_id", "status", "task_dir", summary.alias("summary"))
    return tk.task_cards(rows).select("event_id", "title", "status_label", "detail")


@query("phase_results", rows_with("te task", """
SELECT company_id, phase, task_dir, status, attempts FROM task WHERE phase = 'RISK_ANALYSIS'"""))
def phase_results(t: Tables) -> DataFrame:
    return tk.phase_results(task(t)).select("company_id", "phase", "task_dir", "status", "attempts")


@query("exposure_chain", rows_with("cp", """
SELECT event_type, e.company_id, product_id, p_brand AS brand, n_events, n_lines, c / 10000.0::DOUBLE AS amount
FROM (SELECT user_id AS company_id, event_type, count(*) AS n_events FROM events GROUP BY ALL) e
JOIN cp ON cp.company_id = e.company_id LEFT JOIN part ON p_partkey = product_id"""))
def exposure_chain(t: Tables) -> DataFrame:
    return chain.exposure_chain(tb.task_event(t), t.read("orders"), t.read("lineitem"), t.read("part"))


@query("exposure_reach", """
WITH RECURSIVE links AS MATERIALIZED (
  SELECT DISTINCT 'company:' || o_custkey AS source, 'product:' || l_partkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION SELECT 'product:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
walk AS (
  SELECT start, target AS node, 1 AS hop, source AS via FROM (SELECT DISTINCT 'company:' || user_id AS start FROM events
    WHERE event_type = 'error') JOIN links ON source = start
  UNION ALL SELECT start, target, hop + 1, source FROM walk JOIN links ON source = node WHERE hop < 4)
SELECT start, node, hop, count(*) AS n_paths, min(via) AS via FROM walk GROUP BY ALL""")
def exposure_reach(t: Tables) -> DataFrame:
    """Where companies with failed tasks lead within four links."""
    failed = t.read("events").filter("event_type = 'error'").select(F.concat(F.lit("company:"), F.col("user_id").cast("string")).alias("start"))
    return chain.reach(tb.supply_link(t), failed, 4)


@query("event_exposure", rows_with("cp", """
SELECT event_id, user_id AS company_id, coalesce(n, 0) AS n_products, coalesce(l, 0) AS n_lines,
  coalesce(c / 10000.0::DOUBLE, 0.0) AS amount FROM events LEFT JOIN (SELECT company_id, count(*) AS n,
  CAST(sum(n_lines) AS BIGINT) AS l, sum(c) AS c FROM cp GROUP BY 1) x ON x.company_id = user_id"""))
def event_exposure(t: Tables) -> DataFrame:
    return chain.event_exposure(tb.task_event(t), t.read("orders"), t.read("lineitem"))


@query("file_kinds_rollup", rows_with("file", """
SELECT company_id, kind, count(*) AS n FROM file GROUP BY GROUPING SETS ((company_id, kind), (kind), ())"""))
def file_kinds_rollup(t: Tables) -> DataFrame:
    return metrics.file_index(tb.process_file(t))


@query("file_subset", rows_with("file", f"""
SELECT company_id, path, regexp_extract(path, '[^/]*$') AS name, {label('file', 'kind')} AS label FROM file WHERE kind = '截图'"""))
def file_subset(t: Tables) -> DataFrame:
    return metrics.screenshots(tb.process_file(t)).select(
        "company_id", "path", last_part(F.col("path")).alias("name"), label_of("file", F.col("kind")).alias("label"))


@query("manifest_check", rows_with("file", """,
ids AS (SELECT DISTINCT unnest([doc_id, 3 * doc_id]) AS doc_id FROM labels),
man AS (SELECT coalesce(source, 'gone') || '/' || i.doc_id AS path, n_chars AS bytes, sha256(text) AS sha256
  FROM ids i LEFT JOIN documents d ON d.doc_id = i.doc_id)
SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra'
  WHEN f.bytes = m.bytes AND f.sha256 = m.sha256 THEN 'ok' ELSE 'changed' END AS state
FROM file f FULL OUTER JOIN man m ON f.path = m.path"""))
def manifest_check(t: Tables) -> DataFrame:
    return files.check_manifest(tb.process_file(t), tb.manifest(t))


def hits(t: Tables) -> DataFrame:
    text = tb.evidence_text(t).withColumn("location", F.col("source_id"))
    return screening.screen_keywords(text, tb.STAND_IN_DICTIONARY, "content",
                                     ["company_id", "evidence_id", "location"])


_FACTS = """facts AS (
  SELECT c.company_id, c.name, risk, w.risk_words, analysis_mode,
    coalesce(k.n_web, 0) AS n_web, coalesce(k.n_mapp, 0) AS n_mapp, 0::BIGINT AS n_app, 0::BIGINT AS n_kapp,
    coalesce(d.n, 0) AS n_candidates, coalesce(p.n, 0) AS n_pages, coalesce(a.n, 0) AS n_accounts
  FROM company c
  LEFT JOIN (SELECT company_id, count(*) FILTER (WHERE kind = 'web') AS n_web,
    count(*) FILTER (WHERE kind = 'mapp') AS n_mapp FROM carrier GROUP BY 1) k ON k.company_id = c.company_id
  LEFT JOIN (SELECT company_id, count(DISTINCT domain) AS n FROM page GROUP BY 1) d ON d.company_id = c.company_id
  LEFT JOIN (SELECT company_id, count(*) AS n FROM page GROUP BY 1) p ON p.company_id = c.company_id
  LEFT JOIN (SELECT company_id, count(*) AS n FROM account GROUP BY 1) a ON a.company_id = c.company_id
  LEFT JOIN (SELECT company_id, string_agg(keyword, ',' ORDER BY keyword) AS risk_words
    FROM (SELECT DISTINCT company_id, keyword FROM hits) GROUP BY 1) w ON w.company_id = c.company_id)"""


def facts(t: Tables, **flags: Column) -> DataFrame:
    candidates = tb.page_host(t).select("company_id", "domain").distinct()
    return bd.company_facts(
        tb.company(t).select("company_id", "name", "risk", "analysis_mode"), tb.carrier(t), candidates,
        tb.page_host(t), tb.account(t), screening.company_words(hits(t), **flags))


@query("company_rows", rows_with(BOARD + " page carrier account evidence hits", """,
d AS (SELECT company_id, string_agg(domain, ',' ORDER BY domain) AS active_domains
  FROM (SELECT DISTINCT company_id, domain FROM page WHERE domain <> '') GROUP BY 1)
SELECT f.company_id, f.name, b.status, f.risk, f.risk_words, f.analysis_mode, n_web, n_mapp, n_app, n_kapp, n_candidates,
  n_pages, n_accounts, d.active_domains, CASE WHEN f.company_id IN (SELECT company_id FROM hits WHERE category = 'promise') THEN true
    WHEN f.risk IS NOT NULL THEN false END AS buyback,
  (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events) AS run_time
FROM facts f JOIN board b ON b.company_id = f.company_id LEFT JOIN d ON d.company_id = f.company_id""", _FACTS))
def company_rows(t: Tables) -> DataFrame:
    """All sixteen facts of the company row: status, carriers by kind, candidates, pages,
    active domains, accounts, risk, buyback, words, mode and time of the run."""
    domains = tb.page_host(t).filter("domain <> ''").groupBy("company_id").agg(
        F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("active_domains"))
    last = t.read("events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("t"))
    return (facts(t, _promise=F.col("category") == "promise").join(board(t).select("company_id", "status"), "company_id")
            .join(domains, "company_id", "left")
            .withColumn("buyback", F.coalesce(F.nullif("_promise", F.lit(False)), F.when(F.col("risk").isNotNull(), F.lit(False))))
            .withColumn("run_time", last.scalar()).drop("_promise"))


@query("overview_card", rows_with(BOARD + " page carrier account evidence hits file", """
SELECT b.company_id, CASE WHEN has_full THEN CAST(n_web + n_mapp + n_app + n_kapp AS VARCHAR) ELSE '—' END AS carriers,
  CASE WHEN has_full THEN CAST(n_pages AS VARCHAR) ELSE '—' END AS pages,
  CASE WHEN has_full THEN CAST(n_accounts AS VARCHAR) ELSE '—' END AS accounts,
  coalesce(b.risk_words, '—') AS risk_words,
  CASE WHEN total > 0 THEN ok || '成功 / ' || failed || '失败 / ' || running || '运行中' END AS progress,
  coalesce(s.n, 0) AS n_shots
FROM board b LEFT JOIN facts f ON f.company_id = b.company_id
LEFT JOIN (SELECT company_id, count(*) AS n FROM file WHERE kind = '截图' GROUP BY 1) s ON s.company_id = b.company_id""", _FACTS))
def overview_card(t: Tables) -> DataFrame:
    return bd.overview(board(t), facts(t), metrics.screenshots(tb.process_file(t)))


@query("section_counts", rows_with("evidence page account carrier", """
SELECT company_id, 'evidence' AS section, count(*) AS n FROM evidence GROUP BY 1
UNION ALL SELECT company_id, 'website', count(*) FROM page GROUP BY 1
UNION ALL SELECT company_id, 'social', count(*) FROM account GROUP BY 1
UNION ALL SELECT company_id, 'icp', count(*) FROM carrier GROUP BY 1"""))
def section_counts(t: Tables) -> DataFrame:
    return sec.section_counts({"evidence": tb.evidence(t), "website": tb.page_host(t),
                               "social": tb.account(t), "icp": tb.carrier(t)})


@query("section_or_phase", rows_with("te task page account carrier company evidence", """,
s AS (SELECT company_id, 'website' AS section, count(*) AS n FROM page GROUP BY 1
  UNION ALL SELECT company_id, 'social', count(*) FROM account GROUP BY 1
  UNION ALL SELECT company_id, 'icp', count(*) FROM carrier GROUP BY 1
  UNION ALL SELECT company_id, 'evidence', count(*) FROM evidence GROUP BY 1
  UNION ALL SELECT company_id, 'risk', count(*) FROM company WHERE risk IS NOT NULL GROUP BY 1),
p AS (SELECT *, CASE phase WHEN 'WEB_ICP' THEN 'icp' WHEN 'WEB_CRAWL' THEN 'website'
    WHEN 'ACCOUNT_VERIFY' THEN 'social' WHEN 'RISK_ANALYSIS' THEN 'risk' END AS section FROM task)
SELECT company_id, section, 'section' AS origin, CAST(NULL AS VARCHAR) AS phase, CAST(NULL AS VARCHAR) AS task_dir,
  CAST(NULL AS VARCHAR) AS status, n FROM s
UNION ALL SELECT company_id, section, 'phase', phase, task_dir, status, 1 FROM p WHERE section IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.company_id = p.company_id AND s.section = p.section)"""))
def section_or_phase(t: Tables) -> DataFrame:
    have = sec.section_counts({
        "website": tb.page_host(t), "social": tb.account(t), "icp": tb.carrier(t), "evidence": tb.evidence(t),
        "risk": tb.company(t).filter("risk is not null")})
    return sec.section_or_phase(have, task(t))
