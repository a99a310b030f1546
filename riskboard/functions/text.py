"""Column helpers: text, defaults, numbers, addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

_EDGE_BLANKS = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"
_VISIBLE = r"[^\s\p{Z}\x{FEFF}]"
_NAME_NOISE = r"[\s\p{Z}\p{P}\x{FEFF}]+"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
# Public suffixes of two labels; any other last label is a suffix itself.
TWO_LABEL_SUFFIXES = [
    "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "ac.cn", "com.hk", "com.tw", "co.uk", "org.uk", "co.jp",
    "com.au", "com.sg", "example.com", "example.org", "example.net",
]


def trim_all(c: Column) -> Column:
    """Trim every Unicode blank, the full-width one included."""
    return F.regexp_replace(c, _EDGE_BLANKS, "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(_VISIBLE)


def first_filled(*cols: Column) -> Column:
    """The first argument that is neither null nor the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def number_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def norm_name(c: Column) -> Column:
    """Name key: lower case, blanks and punctuation dropped."""
    return F.regexp_replace(F.lower(c), _NAME_NOISE, "")


def content_key(c: Column) -> Column:
    """Content key: equal for texts that differ in case, blanks or punctuation only."""
    return F.sha2(norm_name(c), 256)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def domain_of(host: Column) -> Column:
    """The registered domain: the public suffix and one label more; a shorter host is
    its own domain. Suffixes of two labels are listed, all others have one."""
    last_two = F.substring_index(host, ".", -2)
    listed = last_two.isin(TWO_LABEL_SUFFIXES)
    return F.when(listed, F.substring_index(host, ".", -3)).otherwise(last_two)


def site_label(host: Column) -> Column:
    """First label of the registered domain."""
    return F.substring_index(domain_of(host), ".", 1)


def pick(code: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Decode a fixed code list inline, without a join."""
    branches = reduce(
        lambda acc, kv: F.when(code == kv[0], F.lit(kv[1])) if acc is None
        else acc.when(code == kv[0], F.lit(kv[1])),
        table.items(), None)
    return branches.otherwise(F.lit(None) if default is None else default)


def index_of(code: Column, values: list[str]) -> Column:
    """Zero-based position in a fixed list, null when absent."""
    found = F.array_position(F.array(*[F.lit(v) for v in values]), code)
    return F.nullif(found.cast("int"), F.lit(0)) - 1


def nth(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1)


def last_part(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def json_quote(c: Column) -> Column:
    """A text as a JSON string literal."""
    boxed = F.to_json(F.array(c))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def indented_json(m: Column) -> Column:
    """A flat text map as JSON, two blanks of indent, entries in map order."""
    lines = F.transform(F.map_entries(m), lambda e: F.concat(
        F.lit("  "), json_quote(e["key"]), F.lit(": "),
        F.coalesce(json_quote(e["value"]), F.lit("null"))))
    return F.when(F.size(m) == 0, F.lit("{}")).otherwise(
        F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")))
