"""Stored pages: text, title, links, hosts."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import host_of, trim_all

_HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<head.*?</head>"
_TAG = r"<[^>]*>"
_TITLE = r"(?is)<title[^>]*>([^<]*)</title>"
# the address of a link or of an area of an image: in double or single quotes, or bare
_LINK = r"""(?i)<(?:a|area)\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_COMMENT = r"(?s)<!--.*?-->"
_REFERENCE = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
# the named references of HTML 4, as the language's own library lists them
NAMES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
_MARK = "\ue000"


def decoded(c: Column) -> Column:
    """Character references as characters, numeric and named ones, each decoded once: the
    text is cut at its references, and what stands between them is kept as it is."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    number = lambda t: F.coalesce(
        F.conv(F.regexp_extract(t, "^&#[xX]([0-9a-fA-F]{1,6});$", 1), 16, 10).try_cast("int"),
        F.regexp_extract(t, "^&#([0-9]{1,7});$", 1).try_cast("int"))
    utf16 = lambda n: F.when(n < 65536, F.lpad(F.hex(n), 4, "0")).otherwise(F.concat(
        F.lpad(F.hex(F.floor((n - 65536) / 1024) + 55296), 4, "0"), F.lpad(F.hex(F.pmod(n - 65536, F.lit(1024)) + 56320), 4, "0")))
    good = lambda n: F.coalesce((n > 0) & (n < 1114112) & ~n.between(55296, 57343), F.lit(False))
    named = lambda t: F.try_element_at(names, F.regexp_extract(t, "^&([A-Za-z][A-Za-z0-9]{1,30});$", 1))
    parts = F.split(F.regexp_replace(c, f"({_REFERENCE})", f"{_MARK}$1{_MARK}"), _MARK)
    one = lambda t: F.when(~F.startswith(t, F.lit("&")), t).when(
        good(number(t)), F.decode(F.unhex(utf16(number(t))), "UTF-16BE")).otherwise(F.coalesce(named(t), t))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def _plain(c: Column) -> Column:
    return trim_all(F.regexp_replace(decoded(c), r"[\s\p{Z}]+", " "))


def page_text(pages: DataFrame) -> DataFrame:
    """Host, title and visible text of every page, row by row."""
    body = F.regexp_replace(F.regexp_replace("html", _HIDDEN, " "), _TAG, " ")
    return pages.select("page_id", host_of(F.col("url")).alias("host"),
                        _plain(F.regexp_extract("html", _TITLE, 1)).alias("title"),
                        _plain(body).alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """Links of every page in page order, without quotes and references; what stands in a
    comment is no link."""
    shown = F.regexp_replace("html", _COMMENT, " ")
    found = F.posexplode(F.regexp_extract_all(shown, F.lit(_LINK), F.lit(1))).alias("pos", "href")
    bare = F.regexp_replace("href", "^[\"']|[\"']$", "")
    return pages.select("page_id", found).select("page_id", "pos", decoded(bare).alias("href"))


def domain_activity(candidate: DataFrame, pages: DataFrame) -> DataFrame:
    """A candidate host is active when any page of it is stored."""
    stored = pages.groupBy(F.col("host").alias("domain")).agg(F.count(F.lit(1)).alias("n_pages"))
    n = F.coalesce("n_pages", F.lit(0))
    return (candidate.select("domain").distinct().join(stored, "domain", "left")
            .select("domain", n.alias("n_pages"), (n > 0).alias("is_active")))
