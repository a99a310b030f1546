"""Evidence, screening, verdicts, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.labels import evidence_label
from ..operators import entities as en
from ..operators import evidence as ev
from ..operators import quality, review, screening
from ..sources import tables as tb
from ..sources.tables import Tables
from .boards import BOARD, board, hits
from .registry import query
from .sql import owner, rows_with

GRADED = "source evidence graded"
VERDICT = BOARD + " evidence hits page carrier verdict"


def graded(t: Tables) -> DataFrame:
    return ev.grade_evidence(tb.evidence(t), tb.source(t))


def verdict(t: Tables) -> DataFrame:
    return screening.rule_verdict(board(t), tb.carrier(t), tb.page_host(t), hits(t))


@query("evidence_grade", rows_with(GRADED, "SELECT company_id, evidence_id, source_id, grade FROM graded"))
def evidence_grade(t: Tables) -> DataFrame:
    return graded(t).select("company_id", "evidence_id", "source_id", "grade")


@query("evidence_with_source", rows_with("source evidence", """
SELECT company_id, evidence_id, e.source_id, name AS source_name, url AS source_url, origin_url
FROM evidence e LEFT JOIN source s ON s.source_id = e.source_id"""))
def evidence_with_source(t: Tables) -> DataFrame:
    rows = tb.evidence(t).select("company_id", "evidence_id", "source_id", "origin_url")
    return ev.evidence_with_source(rows, tb.source(t)).select(
        "company_id", "evidence_id", "source_id", "source_name", "source_url", "origin_url")


@query("section_view", rows_with(GRADED, """
SELECT company_id, 'evidence' AS section, evidence_id, name AS source_name,
  CASE grade WHEN 'verified' THEN '已验证' WHEN 'partial' THEN '部分/仅摘录' ELSE '数据缺失' END AS grade_label,
  origin_url FROM graded g LEFT JOIN source s ON s.source_id = g.source_id"""))
def section_view(t: Tables) -> DataFrame:
    rows = ev.evidence_with_source(graded(t), tb.source(t))
    return rows.select("company_id", F.lit("evidence").alias("section"), "evidence_id", "source_name",
                       evidence_label(F.col("grade")).alias("grade_label"), "origin_url")


@query("coverage_gap", rows_with("source evidence", """
SELECT c.company_id, coalesce(n, 0) AS n_covered, (SELECT count(*) FROM source) - coalesce(n, 0) AS n_missing,
  coalesce((SELECT string_agg(type, ',' ORDER BY type) FROM (SELECT DISTINCT type FROM source) k
    WHERE NOT list_contains(coalesce(h.types, []), k.type)), '') AS missing_types
FROM (SELECT c_custkey AS company_id FROM customer) c LEFT JOIN (
  SELECT company_id, count(DISTINCT e.source_id) AS n, list(DISTINCT type) AS types
  FROM evidence e JOIN source s ON s.source_id = e.source_id GROUP BY 1) h ON h.company_id = c.company_id"""))
def coverage_gap(t: Tables) -> DataFrame:
    return ev.coverage_gap(tb.company(t).select("company_id"), tb.source(t), tb.evidence(t))


@query("basis_resolved", rows_with(GRADED + " basis", """
SELECT b.company_id, b.inference_id, b.evidence_id, grade FROM basis b JOIN graded g
  ON g.evidence_id = b.evidence_id AND g.company_id = b.company_id"""))
def basis_resolved(t: Tables) -> DataFrame:
    return ev.resolve_basis(tb.inference(t), graded(t)).select(
        "company_id", "inference_id", "evidence_id", "grade")


@query("basis_dangling", rows_with("evidence basis", """
SELECT company_id, inference_id, evidence_id FROM basis b WHERE NOT EXISTS (
  SELECT 1 FROM evidence e WHERE e.evidence_id = b.evidence_id AND e.company_id = b.company_id)"""))
def basis_dangling(t: Tables) -> DataFrame:
    return ev.dangling_basis(tb.inference(t), tb.evidence(t))


def support(t: Tables) -> DataFrame:
    return ev.basis_support(tb.inference(t), graded(t))


@query("basis_support", rows_with(GRADED + " basis support", "SELECT * FROM support"))
def basis_support(t: Tables) -> DataFrame:
    return support(t)


@query("sole_partial", rows_with(GRADED + " basis support", """
SELECT company_id, inference_id, n_partial FROM support WHERE n_verified = 0 AND n_partial > 0"""))
def sole_partial(t: Tables) -> DataFrame:
    return ev.sole_partial(support(t))


RUN_TIME = "2024-01-02 12:00:00"


@query("evidence_completeness", rows_with(GRADED, f"""
SELECT * FROM (SELECT g.company_id, g.evidence_id, concat_ws(',', CASE WHEN source_id = '' THEN 'source_id' END,
    CASE WHEN ts IS NULL THEN 'observed_at' END, CASE WHEN scope = '' THEN 'scope' END,
    CASE WHEN grade = 'unavailable' THEN 'status' END, CASE WHEN ts > TIMESTAMP '{RUN_TIME}' THEN 'late' END) AS missing
  FROM graded g LEFT JOIN events e ON e.event_id = g.evidence_id) WHERE missing <> ''"""))
def evidence_completeness(t: Tables) -> DataFrame:
    grades = graded(t).select("company_id", "evidence_id", "source_id", "scope",
                              F.nullif("grade", F.lit(fixed.UNAVAILABLE)).alias("status"))
    seen = t.read("events").select(F.col("event_id").alias("evidence_id"), F.col("ts").alias("observed_at"))
    return ev.incomplete_evidence(grades.join(seen, "evidence_id", "left"), RUN_TIME)


@query("evidence_dedup", rows_with("evidence", r"""
SELECT content_key, min(evidence_id) AS evidence_id, arg_min(company_id, evidence_id) AS company_id,
  count(*) AS n_copies, count(DISTINCT source_id) AS n_sources
FROM (SELECT *, sha256(regexp_replace(lower(content), '[\s\p{Z}\p{P}\x{FEFF}]+', '', 'g')) AS content_key
  FROM evidence WHERE regexp_replace(lower(content), '[\s\p{Z}\p{P}\x{FEFF}]+', '', 'g') <> '') GROUP BY content_key"""))
def evidence_dedup(t: Tables) -> DataFrame:
    return ev.dedup_evidence(tb.evidence_text(t))


@query("evidence_conflict", rows_with("evidence", """
SELECT company_id, claim_key, evidence_id, CASE WHEN toxic = 1 THEN 'supporting' ELSE 'opposing' END AS side,
  n_supporting, n_opposing FROM (SELECT company_id, evidence_id, toxic, source_id || '/' || scope AS claim_key,
    count(*) FILTER (WHERE toxic = 1) OVER w AS n_supporting, count(*) FILTER (WHERE toxic <> 1) OVER w AS n_opposing
  FROM evidence JOIN labels ON doc_id = evidence_id
  WINDOW w AS (PARTITION BY company_id, source_id || '/' || scope)) WHERE n_supporting > 0 AND n_opposing > 0"""))
def evidence_conflict(t: Tables) -> DataFrame:
    return ev.evidence_conflict(tb.claim(t))


# fixed values: negation marks of the texts' languages
NEGATIONS = "not no never without nicht kein keine nie ohne pas ne jamais sans nunca sin ni".split()
_NEG = "[" + ", ".join(f"'{w}'" for w in NEGATIONS) + "]"


@query("claim_conflict", rows_with("evidence", rf"""
SELECT claim_key, evidence_id, CASE WHEN supports THEN 'supporting' ELSE 'opposing' END AS side, n_supporting, n_opposing FROM (
  SELECT *, count(*) FILTER (WHERE supports) OVER w AS n_supporting, count(*) FILTER (WHERE NOT supports) OVER w AS n_opposing
  FROM told JOIN signs USING (evidence_id) WINDOW w AS (PARTITION BY claim_key)) WHERE n_supporting > 0 AND n_opposing > 0""", rf"""told AS (
  SELECT evidence_id, list_distinct([x for x in w if x <> '' AND NOT list_contains({_NEG}, x)]) AS words,
    len([x for x in w if list_contains({_NEG}, x)]) % 2 = 0 AS supports
  FROM (SELECT evidence_id, regexp_split_to_array(lower(content), '[^\p{{L}}\p{{N}}]+') AS w FROM evidence))""", """each AS (
  SELECT evidence_id, unnest(words) AS word FROM told)""", """signs AS (
  SELECT evidence_id, array_to_string(list_sort((list(word ORDER BY n, word))[1:2]), ' ') AS claim_key
  FROM each JOIN (SELECT word, count(*) AS n FROM each GROUP BY 1 HAVING count(*) >= 10) USING (word) GROUP BY 1)"""))
def claim_conflict(t: Tables) -> DataFrame:
    """Evidence that speaks for and against the same claim, whatever its company."""
    text = tb.evidence_text(t).select("evidence_id", "content")
    return ev.evidence_conflict(ev.claim_groups(text, "evidence_id", "content", NEGATIONS), ("claim_key",))


@query("keyword_screen", rows_with("evidence hits", """
SELECT company_id, evidence_id, location, keyword, category FROM hits"""))
def keyword_screen(t: Tables) -> DataFrame:
    return hits(t)


@query("dictionary_screen", rows_with("evidence", r"""
SELECT company_id, evidence_id, d.keyword, category FROM evidence JOIN dictionary d ON contains(lower(content), d.keyword)""", rf"""dictionary AS (
  SELECT DISTINCT lower(keyword) AS keyword, category FROM (
    SELECT unnest([array_to_string(w[i:i + 2], ' ') for i in range(1, greatest(len(w) - 2, 1) + 1)]) AS keyword, 'phrase' AS category
      FROM (SELECT regexp_split_to_array(lower(text), '[ 	

]+') AS w FROM benchmark)
    UNION ALL SELECT p_name, 'product' FROM part UNION ALL SELECT c_name, 'company' FROM customer
    UNION ALL SELECT lang, 'language' FROM documents
    UNION ALL SELECT * FROM (VALUES {', '.join(f"('{k}', '{c}')" for k, c in tb.STAND_IN_DICTIONARY)}) AS v(keyword, category))
  WHERE keyword <> '')"""))
def dictionary_screen(t: Tables) -> DataFrame:
    return screening.screen_keywords(tb.evidence_text(t).select("company_id", "evidence_id", "content"), tb.dictionary(t), "content",
                                     ["company_id", "evidence_id"])


@query("keyword_findings", rows_with("evidence hits", """
SELECT company_id, location, string_agg(keyword, '、' ORDER BY keyword) AS keywords
FROM (SELECT DISTINCT company_id, location, keyword FROM hits) GROUP BY 1, 2"""))
def keyword_findings(t: Tables) -> DataFrame:
    return screening.keyword_findings(hits(t)).select(
        "company_id", "location", F.array_join("keywords", "、").alias("keywords"))


@query("keyword_text", rows_with("evidence hits", """
SELECT company_id, string_agg(t, '；' ORDER BY t) AS keyword_text FROM (
  SELECT DISTINCT company_id, t FROM (SELECT company_id, location, string_agg(keyword, '、' ORDER BY keyword) AS t
  FROM (SELECT DISTINCT company_id, location, keyword FROM hits) GROUP BY 1, 2)) GROUP BY 1"""))
def keyword_text(t: Tables) -> DataFrame:
    return screening.keyword_text(screening.keyword_findings(hits(t)))


@query("rule_verdict", rows_with(VERDICT, """
SELECT company_id, status, risk, reason, analysis_mode,
  analysis_mode = 'conservative_local_fallback' AS is_degraded FROM verdict"""))
def rule_verdict(t: Tables) -> DataFrame:
    return verdict(t)


_WORDING = ", ".join(f"('{p}', '{r}')" for r, ps in tb.STAND_IN_WORDING.items() for p in ps)


@query("wording_flags", rows_with("evidence", f"""
SELECT evidence_id, phrase, rule FROM evidence
JOIN (VALUES {_WORDING}) AS w(phrase, rule) ON contains(lower(content), phrase)"""))
def wording_flags(t: Tables) -> DataFrame:
    return screening.flag_wording(tb.evidence_text(t), tb.STAND_IN_WORDING, "content", ["evidence_id"])


@query("scenario_listing", """
SELECT d.doc_id, source || ': ' || '{"scenario":"' || source || '","level":"' ||
  CASE WHEN quality = 1 THEN '高' ELSE '中' END || '","note":"' || lang || '"}' AS line
FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 1""")
def scenario_listing(t: Tables) -> DataFrame:
    level = F.when(F.col("quality") == 1, "高").otherwise("中")
    risky = t.read("labels").filter("toxic = 1").select("doc_id", level.alias("level"))
    rows = t.read("documents").select(
        "doc_id", F.col("source").alias("scenario"), F.col("lang").alias("note")).join(risky, "doc_id")
    return en.scenario_listing(rows, ["doc_id"])


_RECALL = f"""(SELECT count(*) FILTER (WHERE company_id IN (SELECT company_id FROM verdict WHERE risk)) AS tp, count(*) AS n
  FROM (SELECT DISTINCT {owner('doc_id')} AS company_id FROM labels WHERE toxic = 1))"""


def recall_row(t: Tables) -> DataFrame:
    return quality.recall(verdict(t).filter("risk").select("company_id"), tb.label(t))


@query("risk_recall", rows_with(VERDICT, f"""
SELECT tp, n - tp AS fn, CASE WHEN n > 0 THEN round(tp / CAST(n AS DOUBLE), 4) END AS recall FROM {_RECALL}"""))
def risk_recall(t: Tables) -> DataFrame:
    return recall_row(t)


@query("quality_kpis", rows_with(VERDICT.replace(" evidence", " source evidence graded") + " basis support", f"""
SELECT 'citation_completeness' AS metric, round(count(*) FILTER (WHERE n_resolved = n_basis) / CAST(count(*) AS DOUBLE), 4) AS value FROM support
UNION ALL SELECT 'unsupported_rate', round(count(*) FILTER (WHERE n_verified = 0) / CAST(count(*) AS DOUBLE), 4) FROM support
UNION ALL SELECT 'high_risk_recall', CASE WHEN n > 0 THEN round(tp / CAST(n AS DOUBLE), 4) END FROM {_RECALL}
UNION ALL SELECT 'review_coverage', CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE company_id IN (
    SELECT user_id FROM events WHERE event_type <> 'view')) / CAST(count(*) AS DOUBLE), 4) END
  FROM board WHERE status = 'CLOSED'"""))
def quality_kpis(t: Tables) -> DataFrame:
    published = board(t).filter(F.col("status") == "CLOSED").select("company_id")
    reviewed = review.valid_reviews(tb.review_event(t)).filter(F.col("status") == fixed.REVIEWED)
    return quality.quality_kpis(support(t), recall_row(t), published, reviewed)
