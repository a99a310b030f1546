"""Board filters and lexical recall."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import is_blank, trim_all
from ..session import shared_folder

SEARCHED = ("name", "risk_words", "active_domains")


def text_match(query: str | Column, cols: tuple[str, ...] = SEARCHED) -> Column:
    """Case-insensitive containment in the joined columns; an empty query matches all."""
    q = F.lower(trim_all(F.lit(query) if isinstance(query, str) else query))
    hay = F.lower(F.array_join(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in cols]), " "))
    return (q == "") | F.contains(hay, q)


def status_match(status: str) -> Column:
    return F.col("status").eqNullSafe(status) if status else F.lit(True)


def risk_match(compat: bool = False) -> Column:
    """Risk is true, or there are risk words.

    ``compat`` reads a stored ``-`` as words, as the published board does.
    """
    words = F.col("risk_words")
    none = is_blank(words)
    if not compat:
        none = none | (trim_all(words) == fixed.NO_TEXT)
    return F.col("risk").eqNullSafe(True) | ~F.coalesce(none, F.lit(True))


def search(board: DataFrame, query: str = "", status: str = "", risk_only: bool = False,
           compat: bool = False) -> DataFrame:
    """The three board filters together."""
    keep = text_match(query) & status_match(status)
    return board.filter(keep & risk_match(compat) if risk_only else keep)


_CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"


def query_terms(query: str) -> list[str]:
    """Words of a query; runs of letters written without blanks become letter pairs (a
    single such letter stands alone)."""
    terms = set()
    for run in re.findall(rf"[{_CJK}]+|[^\W_{_CJK}]+", query.lower()):
        if re.match(rf"[{_CJK}]", run) and len(run) > 1:
            terms.update(run[i:i + 2] for i in range(len(run) - 1))
        else:
            terms.add(run)
    return sorted(terms)


def _occurrences(text: Column, word: str) -> Column:
    """How often a text holds a word as a whole token, or a letter pair anywhere; a text
    without the letters of the word is passed over by a plain search."""
    if re.match(rf"[{_CJK}]", word):
        token = re.escape(word)
    else:
        token = rf"(?<![\p{{L}}\p{{N}}]){re.escape(word)}(?![\p{{L}}\p{{N}}])"
    return F.when(F.contains(text, F.lit(word)), F.regexp_count(text, F.lit(token))).otherwise(0)


def lexical_recall(text: DataFrame, query: str, k: int, id_col: str, text_col: str) -> DataFrame:
    """Top ``k`` texts for a query by tf-idf.

    Words are counted in place in the whole text; nothing is exploded or shuffled. One
    pass over the texts writes ids and counts of the texts that hold a word; the document
    frequencies and the scores come from that table, and each task keeps its own top ``k``.
    """
    words = query_terms(query)
    if not words:
        raise ValueError("the query holds no word")
    counted = text.select(id_col, F.lower(text_col).alias("_low")).select(
        id_col, *[_occurrences(F.col("_low"), w).alias(f"_tf{i}") for i, w in enumerate(words)])
    shared_folder(text.sparkSession)
    some = reduce(lambda a, b: a | b, [F.col(f"_tf{i}") > 0 for i in range(len(words))])
    counted = counted.filter(some).checkpoint()
    stats = counted.agg(*[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()
    n = text.count()
    terms = [F.col(f"_tf{i}") * F.log(F.lit((1.0 + n) / (1.0 + stats[f"df{i}"])))
             for i in range(len(words))]
    score = F.round(sum(terms[1:], terms[0]), 4).alias("score")
    hits = counted.select(id_col, score).filter(F.col("score") > 0)
    return hits.orderBy(F.desc("score"), F.asc(id_col)).limit(k)
