"""Pages, masking, recall, copies, log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import domains
from ..operators import alerts as al
from ..operators import entities as en
from ..operators import pages as pg
from ..operators import privacy, search
from ..sources import tables as tb
from ..sources.tables import Tables
from .registry import query
from .sql import HOST, rows_with, texts

_EDGE = r"regexp_replace({}, '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g')"


_MARK = "chr(57344)"
_REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
_NAMES = "MAP {" + ", ".join(f"'{n}': chr({ord(c)})" for n, c in pg.NAMES.items()) + "}"


def _entities(expr: str) -> str:
    """Character references decoded in one pass: the text is cut at them."""
    code = ("CASE WHEN x LIKE '&#x%' OR x LIKE '&#X%' THEN CAST('0x' || regexp_extract(x, '([0-9a-fA-F]+);$', 1) AS BIGINT) "
            "WHEN x LIKE '&#%' THEN CAST(regexp_extract(x, '([0-9]+);$', 1) AS BIGINT) END")
    good = f"({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111"
    one = (f"CASE WHEN NOT regexp_full_match(x, '{_REFERENCE}') THEN x WHEN {good} THEN chr(CAST({code} AS INT)) "
           f"WHEN x LIKE '&#%' THEN x ELSE coalesce(names[x[2:-2]], x) END")
    return (f"array_to_string(list_transform(string_split(regexp_replace({expr}, '({_REFERENCE})', {_MARK} || '\\1' || {_MARK}, 'g'), "
            f"{_MARK}), lambda x: {one}), '')")


def _plain(expr: str) -> str:
    expr = _entities(expr)
    return _EDGE.format(rf"regexp_replace({expr}, '[\s\p{{Z}}]+', ' ', 'g')")


_BODY = (r"regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<head.*?</head>',"
         r" ' ', 'g'), '<[^>]*>', ' ', 'g')")
_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)"


@query("page_text", f"SELECT page_id, {HOST} AS host, {_plain(_TITLE)} AS title, {_plain(_BODY)} AS text FROM pages, (SELECT {_NAMES} AS names)")
def page_text(t: Tables) -> DataFrame:
    return pg.page_text(t.texts("pages", "page_id"))


_HREF = r"""(?i)<(?:a|area)\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)"""
_BARE = """regexp_replace(l[i], '^["'']|["'']$', '', 'g')"""


@query("page_links", f"""
SELECT page_id, CAST(i - 1 AS INT) AS pos, {_entities(_BARE)} AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '{_HREF}', 1) AS l FROM pages)),
  (SELECT {_NAMES} AS names)""")
def page_links(t: Tables) -> DataFrame:
    return pg.page_links(t.read("pages"))


@query("domain_activity", rows_with("page", """
SELECT c.domain, count(p.page_id) AS n_pages, count(p.page_id) > 0 AS is_active
FROM (SELECT DISTINCT unnest([domain, 'www.' || domain]) AS domain FROM page) c
LEFT JOIN page p ON p.host = c.domain GROUP BY 1"""))
def domain_activity(t: Tables) -> DataFrame:
    return pg.domain_activity(tb.site_candidate(t), tb.page_host(t))


_RULES = ", ".join(f"('{r}')" for r in tb.SUFFIX_RULES)
NAMED_HOST = f"""named_host AS (
  SELECT c_custkey AS company_id, CASE WHEN kind = {len(tb.HOST_ENDS)} THEN '10.0.' || ((c_custkey // 256) % 256) || '.' || (c_custkey % 256)
    ELSE CASE WHEN c_custkey % 2 = 0 THEN 'Shop.' ELSE '' END || 'c' || (c_custkey // 24) || '.' || {texts(tb.HOST_ENDS)}[kind + 1] END AS host
  FROM (SELECT *, CAST(c_custkey % {len(tb.HOST_ENDS) + 1} AS INT) AS kind FROM customer)
  UNION ALL SELECT company_id, host FROM page WHERE host <> '')"""
# the suffix is the longest match: an exception first, which leaves one label out
DOMAINS = f"""host AS (SELECT DISTINCT lower(host) AS host FROM named_host),
rule AS (SELECT ltrim(r, '!*.') AS stem, r LIKE '!%' AS but, r LIKE '*.%' AS wide FROM (VALUES {_RULES}) AS v(r)),
met AS (
  SELECT host, but, CASE WHEN but THEN len(string_split(stem, '.')) - 1 WHEN wide THEN len(string_split(stem, '.')) + 1
    ELSE len(string_split(stem, '.')) END AS n
  FROM host JOIN rule ON host = stem OR ends_with(host, '.' || stem)
  WHERE NOT regexp_matches(host, '^[0-9.]+$') AND (NOT wide OR host <> stem)),
best AS (SELECT host, arg_max(n, (but, n)) AS n FROM met GROUP BY 1),
domains AS (
  SELECT host, CASE WHEN ip THEN NULL ELSE array_to_string(l[len(l) - n + 1:], '.') END AS suffix,
    CASE WHEN ip THEN host ELSE array_to_string(l[greatest(len(l) - n, 1):], '.') END AS domain
  FROM (SELECT h.host, string_split(h.host, '.') AS l, coalesce(n, 1) AS n, regexp_matches(h.host, '^[0-9.]+$') AS ip
    FROM host h LEFT JOIN best b ON b.host = h.host))"""


@query("registered_domains", rows_with("page", "SELECT host, suffix, domain FROM domains", NAMED_HOST, DOMAINS))
def registered_domains(t: Tables) -> DataFrame:
    return domains.registered_domains(tb.named_host(t), tb.suffix_rules(t))


def _check(expr: str, pattern: str, valid: str, tag: str) -> str:
    parts = f"string_split(regexp_replace({expr}, '({pattern})', {_MARK} || '\\1' || {_MARK}, 'g'), {_MARK})"
    plain = "regexp_replace(translate(x, '０１２３４５６７８９ＸｘX', '0123456789xxx'), '[^0-9x]', '', 'g')"
    return (f"array_to_string(list_transform({parts}, lambda x: CASE WHEN regexp_full_match(x, '{pattern}') AND {valid.format(n=plain)} "
            f"THEN '{tag}' ELSE x END), '')")


_IDENTITY = ("(list_sum(list_transform(range(1, 18), lambda i: CAST(({n})[i] AS INT) * (CAST(pow(2, 18 - i) AS INT) % 11))) + "
             "CASE WHEN ({n})[18] = 'x' THEN 10 ELSE CAST(({n})[18] AS INT) END) % 11 = 1")
_CARD = ("list_sum(list_transform(range(1, len({n}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({n})[i] AS INT) "
         "ELSE (CAST(reverse({n})[i] AS INT) * 2) % 10 + (CAST(reverse({n})[i] AS INT) * 2) // 10 END)) % 10 = 0")


def _masked(expr: str) -> str:
    expr = _check(expr, privacy.IDENTITY, _IDENTITY, "[ID]")
    expr = _check(expr, privacy.CARD, _CARD, "[ID]")
    for pattern, tag in privacy.PATTERNS:
        expr = f"regexp_replace({expr}, '{pattern}', '{tag}', 'g')"
    return expr


@query("mask_text", f"SELECT doc_id, {_masked('text')} AS text FROM documents")
def mask_text(t: Tables) -> DataFrame:
    return privacy.mask_text(t.texts("documents", "doc_id").select("doc_id", "text"), ["text"])


@query("pseudonymise", "SELECT event_id, sha256('board' || user_id) AS user_id, event_type FROM events")
def pseudonymise(t: Tables) -> DataFrame:
    return privacy.pseudonymise(t.read("events").select("event_id", "user_id", "event_type"), ["user_id"], "board")


RECALL_QUERY = "idiot orantion whole"


@query("lexical_recall", r"""
WITH tok AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w FROM documents),
tf AS (SELECT doc_id, len([x for x in w if x = 'idiot']) AS t0, len([x for x in w if x = 'orantion']) AS t1,
  len([x for x in w if x = 'whole']) AS t2 FROM tok),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1,
  count(*) FILTER (WHERE t2 > 0) AS d2 FROM tf)
SELECT * FROM (SELECT doc_id, round(t0 * ln(CAST(1 + n AS DOUBLE) / (1 + d0)) + t1 * ln(CAST(1 + n AS DOUBLE) / (1 + d1))
  + t2 * ln(CAST(1 + n AS DOUBLE) / (1 + d2)), 4) AS score FROM tf, s)
WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 25""")
def lexical_recall(t: Tables) -> DataFrame:
    return search.lexical_recall(t.texts("documents", "doc_id"), RECALL_QUERY, 25, "doc_id", "text")


@query("near_copies", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') if x <> ''] AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(list_distinct([hash(array_to_string(w[i:i + 4], ' '))
  for i in range(1, greatest(len(w) - 4, 1) + 1)])) AS g FROM words WHERE len(w) > 0),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g GROUP BY ALL),
edge AS MATERIALIZED (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE c >= 0.8 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT a AS doc_id, min(b) AS group_id, count(DISTINCT b) AS n_copies FROM reach GROUP BY a HAVING count(DISTINCT b) > 1""")
def near_copies(t: Tables) -> DataFrame:
    return en.copy_groups(t.texts("documents", "doc_id"), "doc_id", "text")


LOG_SQL = """
SELECT conv_id, turn, CAST(i - 1 AS INT) AS pos, l[i] AS line FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)) WHERE l[i] <> ''"""


@query("log_lines", LOG_SQL)
def log_lines(t: Tables) -> DataFrame:
    return al.log_lines(t.read("conversations").select("conv_id", "turn", "text"), "text", ["conv_id", "turn"])
