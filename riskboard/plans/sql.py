"""Shared WITH clauses of the SQL forms."""

from __future__ import annotations

from ..functions import fixed
from ..functions.text import TWO_LABEL_SUFFIXES
from ..sources.tables import HOT_COMPANY, STAND_IN_DICTIONARY


def texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def decode(code: str, table: dict[str, str], other: str | None = None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {code} {whens} ELSE {other or 'NULL'} END"


def label(group: str, code: str) -> str:
    return decode(code, fixed.LABELS[group], f"coalesce(nullif({code}, ''), '{fixed.OTHER}')")


WATCHED = "(SELECT greatest(1, count(*)) FROM customer)"


def owner(key: str) -> str:
    """The company a row belongs to."""
    return (f"(CASE WHEN {key} % 10 = 7 THEN {HOT_COMPANY} % {WATCHED} WHEN {key} % 2 = 0 "
            f"THEN (({key} % {WATCHED}) * ({key} % {WATCHED})) % {WATCHED} ELSE {key} % ({WATCHED} // 20 + 1) END)")


HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1))"
SUFFIXES = "(" + "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES) + ")"
DOMAIN = rf"""CASE WHEN regexp_matches(host, '(^|\.){SUFFIXES}$') THEN regexp_extract(host, '([^.]+\.)?{SUFFIXES}$')
    ELSE regexp_extract(host, '([^.]+\.)?[^.]*$') END"""
NORM = r"regexp_replace(lower({}), '[\s\p{{Z}}\p{{P}}\x{{FEFF}}]+', '', 'g')"

CTE = {
    "te": f"""te AS (
  SELECT *, CASE WHEN status IN ('FAILED', 'RETRY_WAIT')
    THEN {texts(fixed.LABELS['error'])}[CAST(floor(value) AS INT) % 5 + 1] END AS error_code,
    {texts(fixed.PHASES)}[phase_idx + 1] AS phase,
    {texts(fixed.PHASES)}[phase_idx + 1] || '/task_' || CAST((k // 12) % 3 AS VARCHAR) AS task_dir
  FROM (SELECT event_id, ts, user_id AS company_id, event_type, value, sha256(props) AS input_sha,
    CAST(json_extract_string(props, '$.k') AS INT) AS k,
    CAST(json_extract_string(props, '$.k') AS INT) % 12 AS phase_idx,
    CASE WHEN user_id % 3 = 0 THEN CASE WHEN event_type = 'error' THEN 'TERMINAL' ELSE 'OK' END
      WHEN event_type = 'view' THEN 'PENDING' WHEN event_type = 'click' THEN 'RUNNING' WHEN event_type = 'purchase' THEN 'OK'
      WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'signup' THEN 'RETRY_WAIT' END AS status
    FROM events))""",
    "task": """task AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, task_dir ORDER BY status = 'TERMINAL' DESC,
      CASE WHEN status = 'TERMINAL' THEN -epoch_us(ts) ELSE epoch_us(ts) END DESC,
      CASE WHEN status = 'TERMINAL' THEN -event_id ELSE event_id END DESC) AS rn,
    count(*) FILTER (WHERE status IN ('FAILED', 'RETRY_WAIT'))
      OVER (PARTITION BY company_id, task_dir) AS attempts FROM te) WHERE rn = 1)""",
    "stats": """done_phase AS (
  SELECT company_id, phase_idx FROM task GROUP BY ALL HAVING bool_and(status IN ('OK', 'TERMINAL'))),
open_phase AS (
  SELECT c.company_id, min(p.i) AS cur FROM (SELECT DISTINCT company_id FROM task) c, range(0, 12) p(i)
  WHERE NOT EXISTS (SELECT 1 FROM done_phase d WHERE d.company_id = c.company_id AND d.phase_idx = p.i)
  GROUP BY 1),
stats AS (
  SELECT t.company_id, count(*) AS total, count(*) FILTER (WHERE status = 'OK') AS ok,
    count(*) FILTER (WHERE status = 'FAILED') AS failed,
    count(*) FILTER (WHERE status = 'RUNNING') AS running, any_value(cur) AS cur,
    any_value(cur) IS NULL AS closed,
    count(*) FILTER (WHERE phase = 'KEYWORD') > 0
      AND count(*) FILTER (WHERE phase = 'KEYWORD' AND status <> 'OK') = 0 AS screened
  FROM task t LEFT JOIN open_phase o ON o.company_id = t.company_id GROUP BY t.company_id)""",
    "live": f"""live AS (
  SELECT company_id, total, ok, failed, running, CASE WHEN closed THEN 'CLOSED' ELSE 'OPEN' END AS status,
    CASE WHEN closed THEN '-' ELSE {texts(fixed.PHASES)}[cur + 1] END AS current_phase, closed, screened
  FROM stats)""",
    "company": """company AS (
  SELECT c_custkey AS company_id, c_name AS name,
    CASE WHEN c_acctbal < 0 THEN true WHEN c_acctbal >= 1000 THEN false END AS risk,
    CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) END AS risk_words,
    'c' || c_custkey || '.example.com' AS active_domains,
    CASE WHEN c_nationkey % 5 = 0 THEN 'conservative_local_fallback' ELSE 'llm' END AS analysis_mode
  FROM customer)""",
    "board": """board AS (
  SELECT coalesce(c.company_id, l.company_id) AS company_id, name, risk, risk_words, active_domains,
    analysis_mode, coalesce(l.status, '未知') AS status, current_phase, total, ok, failed, running, screened,
    c.company_id IS NOT NULL AS has_full
  FROM company c FULL OUTER JOIN live l ON c.company_id = l.company_id)""",
    "source": """source AS (
  SELECT DISTINCT source AS source_id, 'Source ' || source AS name,
    ['authoritative', 'official_site', 'social', 'news'][
      CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 + 1] AS type,
    'https://' || source || '.example.com/' AS url FROM documents)""",
    "evidence": f"""evidence AS (
  SELECT {owner('doc_id')} AS company_id, doc_id AS evidence_id, source AS source_id,
    text AS content, lang AS scope, n_chars,
    'https://' || source || '.example.com/d/' || doc_id AS origin_url FROM documents)""",
    "graded": r"""graded AS (
  SELECT company_id, evidence_id, e.source_id, scope, origin_url,
    CASE WHEN content IS NULL OR content = 'empty' OR regexp_replace(content, '^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$', '', 'g') = ''
      THEN 'unavailable' WHEN type IS NULL OR type = 'social' THEN 'partial' ELSE 'verified' END AS grade
  FROM evidence e LEFT JOIN source s ON e.source_id = s.source_id)""",
    "basis": f"""basis AS (
  SELECT DISTINCT company_id, inference_id, evidence_id FROM (
    SELECT {owner('doc_id')} AS company_id, doc_id AS inference_id,
      unnest([doc_id, doc_id + 10 * ({WATCHED} // 20 + 1), 3 * doc_id]) AS evidence_id FROM labels))""",
    "support": """support AS (
  SELECT b.company_id, b.inference_id, count(*) AS n_basis, count(grade) AS n_resolved,
    count(*) FILTER (WHERE grade = 'verified') AS n_verified,
    count(*) FILTER (WHERE grade = 'partial') AS n_partial
  FROM basis b LEFT JOIN graded g ON b.evidence_id = g.evidence_id AND b.company_id = g.company_id GROUP BY ALL)""",
    "page": rf"""page AS (
  SELECT *, split_part(domain, '.', 1) AS site FROM (SELECT *, {DOMAIN} AS domain
  FROM (SELECT page_id, {owner('page_id')} AS company_id, url, {HOST} AS host FROM pages)))""",
    "carrier": """carrier AS (
  SELECT company_id, CASE WHEN host LIKE 'm.%' THEN 'mapp' ELSE 'web' END AS kind,
    host AS domain, min(page_id) AS pos, min(site) AS name FROM page WHERE host <> '' GROUP BY ALL)""",
    "account": r"""account AS (
  SELECT company_id, CASE WHEN regexp_matches(host, '^(www|blog|m)\.') THEN split_part(host, '.', 1)
      ELSE 'direct' END AS platform, site AS name, count(*) AS score,
    CASE WHEN bool_or(url LIKE 'https:%') THEN '企业认证' ELSE '未认证' END AS official_status
  FROM page GROUP BY ALL)""",
    "review": f"""review AS (
  SELECT event_id, user_id AS company_id, '已复核' AS status, 'r' || (event_id % 7) AS reviewer,
    CASE event_type WHEN 'purchase' THEN '采纳' WHEN 'click' THEN '修改'
      WHEN 'error' THEN '标记误报' WHEN 'signup' THEN '转人工' END AS decision,
    CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') ELSE '' END AS note,
    ts AS reviewed_at FROM events WHERE event_type <> 'view')""",
    "history": """history AS (
  SELECT company_id, ts, event_id, CASE WHEN status = 'OK' THEN value >= 50 END AS risk
  FROM te WHERE phase = 'RISK_ANALYSIS')""",
    "latest": """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id
    ORDER BY reviewed_at DESC, event_id DESC) AS rn FROM review) WHERE rn = 1)""",
    "verdict": """verdict AS (
  SELECT b.company_id, b.status, b.analysis_mode,
    CASE WHEN b.status <> 'CLOSED' OR (nc = 0 AND np = 0) THEN NULL WHEN nh > 0 THEN true
      WHEN screened THEN false END AS risk,
    CASE WHEN b.status <> 'CLOSED' THEN 'unfinished' WHEN nc = 0 AND np = 0 THEN '待核实'
      WHEN nh > 0 THEN 'keyword' WHEN screened THEN 'no_keyword' ELSE 'unscreened' END AS reason
  FROM (SELECT b.company_id, b.status, b.analysis_mode, coalesce(b.screened, false) AS screened,
      (SELECT count(*) FROM carrier c WHERE c.company_id = b.company_id) AS nc,
      (SELECT count(*) FROM page p WHERE p.company_id = b.company_id) AS np,
      (SELECT count(*) FROM hits h WHERE h.company_id = b.company_id) AS nh FROM board b) b)""",
    "file": f"""file AS (
  SELECT {owner('doc_id')} AS company_id, CASE lang WHEN 'en' THEN '过程文本' WHEN 'fr' THEN '截图'
      WHEN 'de' THEN 'final.json' WHEN 'es' THEN 'result.json' ELSE '其他' END AS kind,
    source || '/' || doc_id AS path, octet_length(encode(text)) AS bytes, sha256(text) AS sha256
  FROM documents)""",
    "cp": """cp AS (
  SELECT o_custkey AS company_id, l_partkey AS product_id, count(*) AS n_lines,
    sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)""",
}


def hits_from(dictionary: list[tuple[str, str]]) -> str:
    values = ", ".join(f"('{k.lower()}', '{c}')" for k, c in dictionary)
    return f"""hits AS (
  SELECT company_id, evidence_id, source_id AS location, keyword, category
  FROM evidence JOIN (VALUES {values}) AS d(keyword, category) ON contains(lower(content), keyword))"""


CTE["hits"] = hits_from(STAND_IN_DICTIONARY)


def rows_with(names: str, body: str, *more: str) -> str:
    """SQL with the named shared clauses, and ``more`` clauses, in front."""
    return "WITH " + ",\n".join([*(CTE[n] for n in names.split()), *more]) + "\n" + body
