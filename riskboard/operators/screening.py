"""Dictionary screening and the conservative verdict rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.labels import is_degraded
from ..functions.scale import lookup, marked
from ..session import shared_folder

# Entries of a list that may stand in the plan itself; more of them make a table.
LISTED = 500
# Bytes of a dictionary that every task may hold.
HELD = 64 << 20
# Bytes of the blocks into which texts are cut for a table of keywords, longest first: whatever
# has 2 n - 1 bytes holds a whole block of n wherever it stands.
BLOCKS = (24, 9, 6, 4)


def screen_keywords(text: DataFrame, words: DataFrame | list[tuple[str, str]], text_col: str,
                    keep: list[str]) -> DataFrame:
    """Every (text, keyword) pair where the whole text holds the keyword, in any case.

    ``words`` is a list of (keyword, category) or a table ``keyword, category``; empty
    keywords match nothing. A short list is looked up text by text. For a table texts are looked
    through block by block, see ``_met``: so a text is read once whatever the length of the
    dictionary, and only what is left as a whole word meets the dictionary. That goes to all tasks
    where its measured size allows.
    """
    spark = text.sparkSession
    low = text.select(*keep, F.lower(text_col).alias("_low"))
    if not isinstance(words, DataFrame):
        pairs = sorted({(k.lower(), c) for k, c in words if k})
        if len(pairs) <= LISTED:
            return _listed(low, pairs, keep)
        words = spark.createDataFrame(pairs, "keyword string, category string")
    entries = words.select(F.lower("keyword").alias("keyword"), "category").filter("keyword <> ''").distinct()
    shared_folder(spark)
    return _met(low, entries.checkpoint(), keep)


def _listed(low: DataFrame, pairs: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(c).cast("string").alias("category")) for k, c in pairs])
    if not pairs:
        entries = entries.cast("array<struct<keyword: string, category: string>>")
    hits = F.filter(entries, lambda e: F.contains(F.col("_low"), e["keyword"]))
    return low.select(*keep, F.inline(hits))


def _whole(named: DataFrame, words: DataFrame) -> DataFrame:
    """``named`` (with ``_bytes``) and ``_at``, ``_size``: where texts hold what may be one of
    ``words`` (``_word``, its ``_size`` and the ``_block`` for that).

    A text is cut into blocks, not into all its runs. Wherever a word stands, its first
    ``2 * block - 1`` bytes hold a whole block, one of their first ``block`` runs. So blocks that
    no word has there are ruled out, then beside the others what no word begins with, then what
    is no word in any of the sizes. All three are done in the loop over the text, where a run
    is a position only. Words that begin alike cost no more than their different sizes.
    """
    sizes = {r[0]: sorted(r[1]) for r in words.groupBy("_block").agg(F.collect_set("_size")).collect()}
    blocks = sorted(sizes)
    part = lambda start, size: F.xxhash64(F.substring("_bytes", start + 1, size))
    block, start, n = F.col("_block"), F.col("_start"), F.octet_length("_bytes")
    begins = (words.groupBy("_block", F.substring("_word", F.lit(1), 2 * block - 1).alias("_bytes")).agg(F.count(F.lit(1)))
              .select("_block", "_bytes").checkpoint())
    # positions of all kinds of blocks in one list: position times kinds and the kind
    codes = F.concat(*[F.when(n >= b, F.sequence(F.lit(k), (n - b) * len(blocks) + k, F.lit(b * len(blocks)))).otherwise(
        F.array().cast("array<int>")) for k, b in enumerate(blocks)])
    kind = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("_code") % len(blocks) + 1)
    runs = named.withColumn("_code", F.explode(codes)).withColumns(
        {"_start": F.expr(f"cast(_code div {len(blocks)} as int)"), "_block": kind}).drop("_code")
    first = begins.withColumn("_start", F.explode(F.sequence(F.lit(0), block - 1)))
    near = marked(runs.withColumn("_run", part(start, block)), "_run", first.select(part(start, block)))
    heads = near.withColumn("_back", F.explode(F.sequence(F.lit(0), F.least(start, block - 1)))).withColumn("_at", start - F.col("_back"))
    heads = marked(heads.withColumn("_run", part(F.col("_at"), 2 * block - 1)), "_run", begins.select(F.xxhash64("_bytes")))
    each = F.array().cast("array<int>")
    for b in blocks:
        each = F.when(block == b, F.array(*[F.lit(k) for k in sizes[b]])).otherwise(each)
    ends = heads.withColumn("_size", F.explode(each))
    found = marked(ends.withColumn("_run", part(F.col("_at"), F.col("_size"))), "_run", words.select(F.xxhash64("_word")))
    return found.select(*named.columns, "_at", "_size")


def _met(low: DataFrame, entries: DataFrame, keep: list[str]) -> DataFrame:
    """The pairs for any size of dictionary, on the bytes of texts and keywords. Keywords too
    short for blocks are looked up text by text if they are few, else by all runs of their
    sizes. What may be a keyword meets the dictionary as a whole, each text by a number of its
    own."""
    size, least = F.octet_length("keyword"), 2 * BLOCKS[-1] - 1
    held = (entries.agg(F.sum(size + F.octet_length(F.coalesce("category", F.lit(""))) + 64)).first()[0] or 0) <= HELD
    short = entries.filter(size < least)
    listed = short.limit(LISTED + 1).collect()
    few = len(listed) <= LISTED
    block = F.lit(BLOCKS[-1])
    for b in reversed(BLOCKS[:-1]):
        block = F.when(size >= 2 * b - 1, F.lit(b)).otherwise(block)
    words = entries.filter(size >= least).select(F.col("keyword").cast("binary").alias("_word"), size.alias("_size"), block.alias("_block")).distinct()
    named = (low.filter("_low is not null").select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(keep)], F.col("_low").cast("binary").alias("_bytes"))
             .withColumn("_id", F.monotonically_increasing_id()))
    found = [] if words.isEmpty() else [_whole(named, words)]
    for n in [] if few else sorted(r[0] for r in short.select(size).distinct().collect()):
        starts = F.when(F.octet_length("_bytes") >= n, F.sequence(F.lit(0), F.octet_length("_bytes") - n))
        runs = named.withColumn("_at", F.explode(starts)).withColumn("_run", F.xxhash64(F.substring("_bytes", F.col("_at") + 1, F.lit(n))))
        known = short.filter(size == n).select(F.xxhash64(F.col("keyword").cast("binary")))
        found.append(marked(runs, "_run", known).withColumn("_size", F.lit(n)).select(*named.columns, "_at", "_size"))
    out = _listed(low, sorted(((r["keyword"], r["category"]) for r in listed), key=repr) if few else [], keep)
    columns = [c for c in named.columns if c != "_bytes"]
    for hits in found:
        keyword = F.substring("_bytes", F.col("_at") + 1, F.col("_size")).cast("string").alias("keyword")
        # read once more for frequent keywords: kept, so that texts are cut once
        hits = hits.select(*columns, keyword).distinct().checkpoint()
        met = hits.join(F.broadcast(entries), "keyword") if held else lookup(hits, entries, ["keyword"], ["_id"], "inner")
        out = out.unionByName(met.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(keep)], "keyword", "category"))
    return out


def keyword_findings(hits: DataFrame) -> DataFrame:
    """Findings: distinct keywords per company and location. The set is bounded by the
    dictionary and is built from map-side partial sets."""
    found = F.array_sort(F.collect_set("keyword"))
    return hits.groupBy("company_id", "location").agg(found.alias("keywords"))


def keyword_text(findings: DataFrame) -> DataFrame:
    """Keywords within a finding joined by 、, the distinct texts of a company's findings
    by ；, empty ones dropped. Locations can be any number, but texts of keyword sets are
    bounded by the dictionary: equal ones are one before they are gathered."""
    rows = findings.select("company_id", F.array_join("keywords", "、").alias("_t")).filter("_t <> ''").distinct()
    return rows.groupBy("company_id").agg(
        F.array_join(F.array_sort(F.collect_list("_t")), "；").alias("keyword_text"))


def nested_keyword_text(findings: str):
    """The same text from a nested findings column."""
    parts = F.transform(findings, lambda f: F.array_join(F.coalesce(
        f["keywords"], F.array().cast("array<string>")), "、"))
    return F.array_join(F.filter(parts, lambda p: p != ""), "；")


def company_words(hits: DataFrame, **flags: Column) -> DataFrame:
    """Distinct risk words per company, comma-joined; bounded by the dictionary. ``flags``
    tell of each company whether any hit meets a condition, in the same pass."""
    return hits.groupBy("company_id").agg(
        F.array_join(F.array_sort(F.collect_set("keyword")), ",").alias("risk_words"),
        *[F.bool_or(c).alias(name) for name, c in flags.items()])


def rule_verdict(company: DataFrame, carriers: DataFrame, pages: DataFrame, hits: DataFrame
                 ) -> DataFrame:
    """The conservative rule. Only a finished company with data whose texts were screened
    can be clear of risk: an unfinished one, one without carriers and pages, and one
    without hits whose keyword phase is not OK stay undecided.

    ``company`` may carry ``live_screened``; without task rows a closed company counts as
    screened. Each side is reduced to one row per company before it is joined.
    """
    screened = F.coalesce("live_screened", F.lit(False)) if "live_screened" in company.columns else F.lit(True)
    n = lambda df, name: df.groupBy("company_id").agg(F.count(F.lit(1)).alias(name))
    facts = (company.select("company_id", "status", "analysis_mode", screened.alias("_screened"))
             .join(n(carriers, "_carriers"), "company_id", "left")
             .join(n(pages, "_pages"), "company_id", "left")
             .join(n(hits, "_hits"), "company_id", "left"))
    have = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    closed = F.coalesce(F.col("status") == "CLOSED", F.lit(False))
    missing = ~have("_carriers") & ~have("_pages")
    unknown = ~closed | missing | (~have("_hits") & ~F.col("_screened"))
    return facts.select(
        "company_id", "status",
        F.when(unknown, F.lit(None).cast("boolean")).otherwise(have("_hits")).alias("risk"),
        F.when(~closed, "unfinished").when(missing, fixed.TO_VERIFY).when(have("_hits"), "keyword")
        .when(~F.col("_screened"), "unscreened").otherwise("no_keyword").alias("reason"),
        "analysis_mode", is_degraded(F.col("analysis_mode")).alias("is_degraded"))


def flag_wording(text: DataFrame, rules: dict[str, list[str]] | DataFrame, text_col: str,
                 keep: list[str]) -> DataFrame:
    """Published text that holds a forbidden phrase; ``rules`` maps a rule to its phrases,
    or is a table ``phrase, rule``."""
    if isinstance(rules, dict):
        words = [(p, rule) for rule, phrases in rules.items() for p in phrases]
    else:
        words = rules.select(F.col("phrase").alias("keyword"), F.col("rule").alias("category"))
    return screen_keywords(text, words, text_col, keep).withColumnsRenamed(
        {"keyword": "phrase", "category": "rule"})
