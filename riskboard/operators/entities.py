"""Accounts, similar names, entity alignment, copies of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.scale import components, fits, lookup, top_k
from ..functions.text import norm_name
from ..session import shared_folder, small_batches
from . import segments


# tokens in a group, and the share of groups that near copies have in common
SHINGLE = 5
SIMILAR = 0.8
# ids of a list that is sent to every task at most
LISTED = 1_000_000


def rank_accounts(account: DataFrame, k: int) -> DataFrame:
    """Best ``k`` accounts per company by score, then name and platform."""
    order = [F.desc("score"), F.asc("name"), F.asc("platform")]
    return top_k(account, ["company_id"], order, k).select(
        "company_id", "platform", "name", "score", "rn")


def decide_accounts(account: DataFrame, company: DataFrame, carriers: DataFrame) -> DataFrame:
    """Unfinished company or one without carriers: to review. Else an uncertified
    account is foreign, any other one probably the company's own."""
    counted = carriers.groupBy("company_id").agg(F.count(F.lit(1)).alias("_n"))
    firm = company.select("company_id", "status").join(counted, "company_id", "left")
    closed = F.coalesce(F.col("status") == "CLOSED", F.lit(False))
    decision = (F.when(~closed | F.col("_n").isNull(), fixed.ACCOUNT_OPEN)
                .when(F.col("official_status") == fixed.UNCERTIFIED, fixed.ACCOUNT_FOREIGN)
                .otherwise(fixed.ACCOUNT_OWN))
    rows = lookup(account, firm, ["company_id"], ["platform", "name"])
    return rows.withColumn("decision", decision).drop(
        "status", "_n")


def account_listing(account: DataFrame) -> DataFrame:
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(fixed.NO_VALUE))
    return account.select("company_id", F.format_string(
        "[%s] %s · %s · %s", F.col("platform"), dash("name"), dash("decision"),
        dash("official_status")).alias("line"))


def scenario_listing(scenario: DataFrame, keys: list[str]) -> DataFrame:
    """Scenario name and the whole record as JSON."""
    name = F.coalesce(F.nullif(F.col("scenario"), F.lit("")), F.lit(fixed.NO_VALUE))
    record = F.to_json(F.struct("scenario", "level", "note"), {"ignoreNullFields": "false"})
    return scenario.select(*keys, F.concat(name, F.lit(": "), record).alias("line"))


def _shortened(name: Column) -> Column:
    """The name itself and every form with one character left out."""
    cut = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(
        F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(name), cut))


def _forms(names: DataFrame, column: str, k: int) -> DataFrame:
    forms = F.array(F.col(column))
    for _ in range(k):
        forms = F.array_distinct(F.flatten(F.transform(forms, _shortened)))
    return names.filter(F.length(column) > 0).select(column, F.explode(forms).alias("_form"))


def near_names(left: DataFrame, right: DataFrame, k: int = 1) -> DataFrame:
    """All pairs of distinct names at edit distance ``k`` or less, equal ones included:
    ``name, other, dist``.

    Exact, by equi-join: two such names share a form after at most ``k`` deletions on
    each side. Names are made distinct first and only names close to one another share
    a form, so no group grows with the number of rows.
    """
    a = _forms(left.select("name").distinct(), "name", k)
    b = _forms(right.select(F.col("name").alias("other")).distinct(), "other", k)
    pairs = a.join(b, "_form").select("name", "other").distinct()
    return pairs.withColumn("dist", F.levenshtein("name", "other", k)).filter(F.col("dist") >= 0)


def similar_accounts(account: DataFrame, company: DataFrame, k: int = 1) -> DataFrame:
    """Accounts whose name is equal or near to the name of a company: one row per account
    and like name, with the smallest company of that name and how many there are, so
    that a name many accounts and companies bear does not multiply them."""
    pairs = near_names(account, company, k)
    firms = company.groupBy(F.col("name").alias("other")).agg(
        F.min("company_id").alias("like_company_id"), F.count_distinct("company_id").alias("n_like"))
    return (lookup(account, pairs.join(firms, "other"), ["name"], ["company_id", "platform"], "inner")
            .select("company_id", "platform", F.col("name").alias("account"), "like_company_id",
                    F.col("other").alias("like_name"), "n_like", "dist"))


def align_entities(member: DataFrame) -> DataFrame:
    """Members ``domain, name`` that share a registered domain or a normalised name are
    one entity; returns ``domain, entity_id`` (the smallest domain of the entity). Names
    without letters or figures link nothing."""
    named = member.select("domain", norm_name(F.col("name")).alias("name")).filter("name <> ''")
    linked = components(named, "domain", "name")
    return member.select("domain").distinct().join(linked, "domain", "left").select(
        "domain", F.coalesce("component", "domain").alias("entity_id"))


def _groups(text: str) -> tuple[Column, Column]:
    """Tokens, and the distinct hashed groups of ``SHINGLE`` tokens (of ``_w``), sorted; fewer
    tokens make one group. Letters of scripts written without blanks are tokens of their
    own."""
    spaced = F.regexp_replace(F.lower(text), r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}])", " $1 ")
    words = F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - SHINGLE + 1, F.lit(1)))
    return words, F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("_w", i, SHINGLE), " ")))))


def _hashed(text: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, groups`` of all texts that hold a token."""
    words, groups = _groups(text_col)
    return (text.filter(F.col(id_col).isNotNull()).select(id_col, words.alias("_w")).filter(F.size("_w") > 0)
            .select(id_col, groups.alias("groups")))


def _listed(ids: DataFrame) -> DataFrame:
    """A list of ids to keep or leave out rows by. While it is short every task gets it, so
    that the rows, whole sets, stay where they are."""
    return F.broadcast(ids) if fits(ids, LISTED) else ids


def same_sets(hashed: DataFrame, id_col: str) -> DataFrame:
    """Links ``left, right`` of each text to the first one with the same groups; 128 bits
    stand for them."""
    told = hashed.select(id_col, F.xxhash64("groups").alias("_one"), F.xxhash64(F.lit(1), "groups").alias("_two"))
    first = told.groupBy("_one", "_two").agg(F.min(id_col).alias("left"), F.max(id_col).alias("_high")).filter("left < _high")
    return (lookup(told, first, ["_one", "_two"], [id_col], "inner").select("left", F.col(id_col).alias("right"))
            .filter("left < right").distinct())


def shared_keys(sets: DataFrame, id_col: str, threshold: float = SIMILAR) -> DataFrame:
    """``_g, id, left``: the segment keys that several texts have, and the first text of each.
    A key holds one row of a text that has dozens of keys, so no key outgrows a partition."""
    own = Window.partitionBy("_g")
    return (segments.filed(sets, id_col, "groups", threshold)
            .withColumns({"left": F.min(id_col).over(own), "_high": F.max(id_col).over(own)})
            .filter("left < _high").select("_g", id_col, "left"))


def _checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``left, right`` whose sets (``_id, _set``) have the threshold's share in common.
    Only sets of pairs that their prints allow leave their place."""
    def asked(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("left", "right")).alias("_id")).distinct().checkpoint()
        return sets.join(_listed(ids), "_id", "left_semi")
    pairs = segments.near(pairs, segments.prints(asked(pairs), "_id", "_set").checkpoint(), threshold).checkpoint()
    sets = asked(pairs).checkpoint()
    both = (pairs.join(sets.withColumnsRenamed({"_id": "left", "_set": "_a"}), "left")
            .join(sets.withColumnsRenamed({"_id": "right", "_set": "_b"}), "right"))
    common = F.size(F.array_intersect("_a", "_b"))
    return both.filter(common >= threshold * (F.size("_a") + F.size("_b") - common)).select("left", "right")


def joining_links(shared: DataFrame, sets: DataFrame, id_col: str, threshold: float = SIMILAR) -> DataFrame:
    """Checked links ``left, right`` that join whatever is joined by all links between texts
    that share a key (``_g, id`` and its first text ``left``). ``sets``: ``_id, _set`` of the texts.

    1. Each text is compared with the first text of each of its keys, so the near copies of
       one text make one comparison each.
    2. Texts of a key that are not joined yet are compared with each other, all of
       them: whatever fails with the first text still meets every text it may be linked to.
    """
    pairs = shared.withColumnRenamed(id_col, "right").filter("left < right").select("left", "right").distinct().checkpoint()
    begun = _checked(pairs, sets, threshold).checkpoint()
    ends = begun.select(F.explode(F.array("left", "right")).alias(id_col), F.xxhash64("left", "right").alias("_link"))
    named = shared.join(components(ends, id_col, "_link", keep_single=False), id_col, "left").select(
        "_g", id_col, F.coalesce("component", id_col).alias("_root"))
    mixed = (named.groupBy("_g").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high"))
             .filter("_low < _high").select("_g"))
    apart = lookup(named, mixed, ["_g"], [id_col], "inner").select("_g", id_col, "_root").checkpoint()
    other = apart.select("_g", F.col(id_col).alias("_other"), F.col("_root").alias("_apart"))
    rest = (apart.join(other, "_g").filter("_root < _apart")
            .select(F.least(id_col, "_other").alias("left"), F.greatest(id_col, "_other").alias("right")).distinct()
            .join(pairs, ["left", "right"], "left_anti").checkpoint())
    return begun.unionByName(_checked(rest, sets, threshold))


def copy_links(text: DataFrame, id_col: str, text_col: str, threshold: float = SIMILAR) -> DataFrame:
    """Checked links ``left, right`` between texts that have at least the ``threshold`` of
    their groups in common: enough of them to join whatever all such links join."""
    shared_folder(text.sparkSession)
    small_batches(text.sparkSession)
    hashed = _hashed(text, id_col, text_col).checkpoint()  # hashed once, read several times
    same = same_sets(hashed, id_col).checkpoint()
    own = hashed.join(_listed(same.select(F.col("right").alias(id_col))), id_col, "left_anti")
    shared = shared_keys(own, id_col, threshold).checkpoint()
    sets = hashed.select(F.col(id_col).alias("_id"), F.col("groups").alias("_set"))
    return same.unionByName(joining_links(shared, sets, id_col, threshold))


def copy_groups(text: DataFrame, id_col: str, text_col: str, threshold: float = SIMILAR) -> DataFrame:
    """Texts grouped with their near copies: ``id, group_id, n_copies`` for groups of two
    or more. Groups are the connected components over checked links, so no text is in a
    group without a mate of at least the threshold's similarity."""
    links = copy_links(text, id_col, text_col, threshold)
    pairs = links.select(F.explode(F.array("left", "right")).alias(id_col), F.xxhash64("left", "right").alias("_link"))
    grouped = components(pairs, id_col, "_link", keep_single=False)
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("n_copies"))
    return lookup(grouped, sizes, ["component"], [id_col], "inner").select(
        id_col, F.col("component").alias("group_id"), "n_copies")
