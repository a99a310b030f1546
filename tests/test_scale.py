"""Hot keys, deep pages, large dictionaries: results equal the plain or brute-force form."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskboard.functions import scale
from riskboard.operators import board, chain, entities, evidence, keys, review, screening, search, segments, tasks


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows; key 7 holds a third of them."""
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("long")
    return spark.range(20_000).select(F.col("id").alias("row_id"), key.alias("key")).cache()


def test_hot_keys_finds_every_frequent_key(skewed):
    hot = scale.hot_keys(skewed, ["key"])
    seven = skewed.filter("key = 7").select(F.xxhash64("key")).first()[0]
    assert hot[seven] >= 4 and len(hot) <= 1000


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_equals_join(spark, skewed, rows, how):
    dim = spark.range(300).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    for small in ("1k", "64m"):  # salted, and as it comes
        try:
            for k in kept:
                spark.conf.set(k, small)
            got = scale.lookup(skewed, dim, ["key"], ["row_id"], how)
            assert ("_salt" in got._jdf.queryExecution().toString()) == (small == "1k")
        finally:
            for k, v in kept.items():
                spark.conf.set(k, v)
        assert rows(got, "row_id", "key", "v") == rows(skewed.join(dim, "key", how), "row_id", "key", "v")


def test_lookup_splits_the_hot_key(spark, skewed):
    hot = scale.hot_keys(skewed, ["key"])
    parts = scale.salted(skewed, ["key"], hot, ["row_id"]).groupBy("key", "_salt").count()
    assert parts.agg(F.max("count")).first()[0] < 20_000 / 8
    assert parts.agg(F.sum("count")).first()[0] == 20_000


def test_latest_by(spark, skewed, rows):
    got = scale.latest_by(skewed, ["key"], ["row_id"], ["row_id"])
    assert rows(got) == rows(skewed.groupBy("key").agg(F.max("row_id")))


def test_top_k_limits_before_the_shuffle(skewed):
    got = scale.top_k(skewed, ["key"], [F.desc("row_id")], 3)
    assert got.groupBy("key").count().filter("count > 3").count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_deep_slices_equal_shallow_ones(spark, skewed, rows):
    order = [F.desc("key"), F.asc("row_id")]
    for skip, take in ((0, 20), (6_500, 300), (19_990, 20), (25_000, 10)):
        deep = scale.slice_sorted(skewed, order, skip, take, head=0)
        flat = scale.slice_sorted(skewed, order, skip, take)
        assert [tuple(r) for r in deep.collect()] == [tuple(r) for r in flat.collect()]


def test_pages_concatenate_to_the_whole(spark):
    df = spark.range(57).select(F.format_string("n%03d", "id").alias("name"))
    got = [r["name"] for p in range(1, 4) for r in board.page(df, ["name"], p, 20).collect()]
    assert got == [f"n{i:03d}" for i in range(57)]
    assert [r["name"] for r in board.page(df, ["name"], 99, 20).collect()] == got[40:]
    assert board.page_count(df, 20).first()["pages"] == 3
    assert board.page_count(df.limit(0), 20).first()["pages"] == 1


def _components(edges):
    left = {a: {a} for a, _ in edges}
    by_right = {}
    for a, b in edges:
        by_right.setdefault(b, []).append(a)
    for group in by_right.values():
        whole = set().union(*(left[a] for a in group))
        for a in whole:
            left[a] = whole
    return {a: min(s) for a, s in left.items()}


def test_components_equal_brute_force(spark, rows):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), f"b{rnd.randrange(150)}") for _ in range(230)]
    edges += [(i, "hot") for i in range(0, 60, 2)]                     # one hot group
    edges += [(1000 + i // 2, f"c{(i + 1) // 2}") for i in range(120)]  # one long chain
    df = spark.createDataFrame(edges, "a long, b string")
    assert dict(rows(scale.components(df, "a", "b"))) == _components(edges)


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2])
def test_near_names_equal_brute_force(spark, rows, k):
    rnd = random.Random(5)
    a = sorted({"".join(rnd.choices("abc", k=rnd.randrange(1, 7))) for _ in range(90)})
    b = sorted({"".join(rnd.choices("abc", k=rnd.randrange(1, 7))) for _ in range(90)})
    got = entities.near_names(spark.createDataFrame([(x,) for x in a * 3], "name string"),
                              spark.createDataFrame([(x,) for x in b], "name string"), k)
    want = [(x, y, _levenshtein(x, y)) for x, y in itertools.product(a, b)
            if _levenshtein(x, y) <= k]
    assert rows(got) == sorted(want, key=repr)


def test_screening_forms_agree(spark, rows):
    rnd = random.Random(9)
    texts = [(i, " ".join(rnd.choices(["Gold", "保本", "pay", "back", "高价x", "zz"], k=6))) for i in range(60)]
    text = spark.createDataFrame(texts, "id long, body string")
    entries = [("gold", "a"), ("保本", "b"), ("PAY", "c"), ("back z", "d"), ("价x", "e"), ("none", "f")]
    table = spark.createDataFrame(entries, "keyword string, category string")
    want = sorted(((i, k.lower(), c) for i, t in texts for k, c in entries if k.lower() in t.lower()), key=repr)
    assert rows(screening.screen_keywords(text, entries, "body", ["id"])) == want
    assert rows(screening.screen_keywords(text, table, "body", ["id"])) == want
    many = entries + [(f"none{i}", "g") for i in range(1200)] + [("", "empty")]
    assert rows(screening.screen_keywords(text, many, "body", ["id"])) == want


def test_domain_words_are_found(spark, rows):
    from riskboard.functions.fixed import RISK_WORDS
    text = spark.createDataFrame([(1, "承诺高息回购黄金"), (2, "保本保息，到期兑付"), (3, "常规说明"), (4, None)], "id long, body string")
    got = screening.screen_keywords(text, [(w, "risk") for w in RISK_WORDS], "body", ["id"])
    assert rows(got, "id", "keyword") == [(1, "高息回购"), (2, "保本"), (2, "到期兑付")]


def test_recall_reads_running_letters(spark):
    df = spark.createDataFrame([(1, "该公司保本保息，到期兑付"), (2, "承诺高息回购黄金"), (3, "常规说明"), (4, "gold_bar")],
                               "id long, body string")
    got = {r["id"] for r in search.lexical_recall(df, "保本 高息回购", 5, "id", "body").collect()}
    assert got == {1, 2}
    assert [r["id"] for r in search.lexical_recall(df, "bar_", 5, "id", "body").collect()] == [4]


def test_wording(spark, rows):
    text = spark.createDataFrame([(1, "稳赚不赔，必涨"), (2, "常规说明"), (3, None)], "id long, body string")
    from riskboard.functions.fixed import FORBIDDEN_WORDING
    assert rows(screening.flag_wording(text, FORBIDDEN_WORDING, "body", ["id"])) == [
        (1, "必涨", "price_forecast"), (1, "稳赚", "return_promise")]


def test_conflict_shows_both_sides_once(spark, rows):
    claims = [(1, "k", i, i % 3 == 0) for i in range(300)] + [(1, "one", 900, True), (2, "k", 901, False)]
    df = spark.createDataFrame(claims, "company_id long, claim_key string, evidence_id long, supports boolean")
    got = rows(evidence.evidence_conflict(df))
    assert len(got) == 300 and {r[1] for r in got} == {"k"}
    assert {(r[4], r[5]) for r in got} == {(100, 200)}
    assert sum(r[3] == "supporting" for r in got) == 100


def test_dedup_counts_copies_of_one_hot_text(spark, rows):
    df = spark.createDataFrame(
        [(i, 1, f"s{i % 4}", "Same  TEXT!" if i % 3 == 0 else f"text {i}") for i in range(300)],
        "evidence_id long, company_id long, source_id string, content string")
    got = rows(evidence.dedup_evidence(df), "evidence_id", "n_copies", "n_sources")
    assert (0, 100, 4) in got and len(got) == 201


def test_copy_groups(spark, rows):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    base = rnd.choices(words, k=300)
    near = base[:150] + ["changed"] + base[151:]
    half = base[:150] + rnd.choices(words, k=150)
    texts = [(0, " ".join(base)), (1, " ".join(near)), (2, " ".join(base).upper() + "."), (3, "two words"),
             (4, "Two, words"), (5, ""), (6, " ".join(rnd.choices(words, k=300))), (7, " ".join(half)),
             (8, "承诺高息回购黄金制品"), (9, "承诺高息回购黄金制品。")]
    got = rows(entities.copy_groups(spark.createDataFrame(texts, "id long, body string"), "id", "body"))
    assert got == [(0, 0, 3), (1, 0, 3), (2, 0, 3), (3, 3, 2), (4, 3, 2), (8, 8, 2), (9, 8, 2)]


def test_copy_groups_of_a_template_family(spark, rows):
    """Variants of one text, too far apart to be linked, and a near copy of each: all pairs
    of the family are compared, the first text of a group decides nothing."""
    rnd = random.Random(11)
    base, texts = [f"b{i}" for i in range(300)], []
    for _ in range(60):
        own = list(base)
        for at in rnd.sample(range(0, 300, 10), 8):
            own[at] = f"v{rnd.randrange(10**9)}"
        near = list(own)
        near[155] = f"n{rnd.randrange(10**9)}"
        texts += [own, near]
    rnd.shuffle(texts)
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    want = [(k, r, root.count(r)) for k, r in enumerate(root) if root.count(r) > 1]
    assert len(set(root)) > 20
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "id long, body string")
    assert rows(entities.copy_groups(df, "id", "body")) == sorted(want, key=repr)


def test_copies_send_only_sets_that_are_alike(spark, rows):
    """Texts made of passages that many others hold have no rare group and meet by the hundred;
    their prints tell them apart before sets are sent."""
    rnd = random.Random(5)
    passages = [" ".join(f"p{rnd.randrange(10**6)}" for _ in range(12)) for _ in range(40)]
    texts = [(k, " ".join(rnd.sample(passages, 10))) for k in range(300)]
    texts += [(1000 + k, f"{texts[k][1]} more") for k in range(10)]
    df = spark.createDataFrame(texts, "id long, body string")
    hashed = entities._hashed(df, "id", "body").checkpoint()
    pairs = (hashed.select(F.col("id").alias("left"), F.explode("groups").alias("g"))
             .join(hashed.select(F.col("id").alias("right"), F.explode("groups").alias("g")), "g")
             .filter("left < right").select("left", "right").distinct().checkpoint())
    assert pairs.count() > 10_000
    near = segments.near(pairs, segments.prints(hashed, "id", "groups"), 0.8)
    assert rows(near) == [(k, 1000 + k) for k in range(10)]
    assert rows(entities.copy_groups(df, "id", "body")) == sorted(
        [(x, k, 2) for k in range(10) for x in (k, 1000 + k)], key=repr)


def test_segments_meet_at_the_share():
    """All pairs at the share have a key in common and prints that allow it, sets whose
    members fill one segment only included."""
    rnd = np.random.default_rng(3)
    met = 0
    for size in [*range(1, 60), 300, 1000]:
        for spread in (1, 5040 * 11 * 13 * 17 * 19 * 23):
            for lost, new in ((0, size // 4), (size // 5, 0), (size // 9, size // 9), (size // 18, size // 10)):
                a = np.unique(rnd.integers(0, 2**30, size)) * spread
                b = np.unique(np.append(rnd.permutation(a)[lost:], (np.arange(new) + 2**30) * spread))
                common = len(np.intersect1d(a, b))
                if a.tobytes() == b.tobytes() or common < 0.8 * (len(a) + len(b) - common):
                    continue
                met += 1
                for known in (None, np.sort(a)[::3], np.sort(a)[::2], np.sort(a)):
                    told, whose = segments.keys(np.append(a, b), np.array([0, len(a), len(a) + len(b)]), 0.8, known)
                    assert set(told[whose == 0].tolist()) & set(told[whose == 1].tolist()), (size, spread, lost, new)
                assert segments.within(segments.parity(a), segments.parity(b), len(a) + len(b) - 2 * common)
    assert met > 200
    assert not segments.within(segments.parity(np.arange(400) ** 3), segments.parity(np.arange(90) ** 5 + 7), 40)


def test_domains_and_entities(spark, rows):
    from riskboard.functions.text import domain_of
    hosts = ["shop.aurum.com", "mail.aurum.com", "aurum.com", "shop.borea.com", "a.b.cinna.com.cn", "localhost"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", domain_of(F.col("host")).alias("d"))
    assert [r["d"] for r in df.collect()] == ["aurum.com", "aurum.com", "aurum.com", "borea.com", "cinna.com.cn", "localhost"]
    member = spark.createDataFrame([("aurum.com", "Aurum Ltd."), ("au-rum.net", "AURUM　ltd"), ("borea.com", "-"),
                                    ("cinna.com", "..")], "domain string, name string")
    assert rows(entities.align_entities(member)) == [
        ("au-rum.net", "au-rum.net"), ("aurum.com", "au-rum.net"), ("borea.com", "borea.com"), ("cinna.com", "cinna.com")]


def test_accounts_with_a_firms_own_name_are_found(spark, rows):
    accounts = spark.createDataFrame([(1, "p", "aurum"), (2, "p", "aurun"), (3, "p", "borea")],
                                     "company_id long, platform string, name string")
    firms = spark.createDataFrame([(10, "aurum"), (11, "aurum")], "company_id long, name string")
    assert rows(entities.similar_accounts(accounts, firms), "company_id", "like_company_id", "n_like", "dist") == [
        (1, 10, 2, 0), (2, 10, 2, 1)]


def test_exposure_grows_by_paths_not_by_pairs(spark):
    events = spark.range(1000).select(F.lit(1).cast("long").alias("company_id"), F.col("id").alias("event_id"),
                                      F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"))
    orders = spark.range(1000).select(F.col("id").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"))
    lines = spark.range(2000).select(
        (F.col("id") % 1000).alias("l_orderkey"), (F.col("id") % 5).alias("l_partkey"),
        F.lit(10.01).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"))
    part = spark.range(5).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"))
    got = chain.exposure_chain(events, orders, lines, part).collect()
    assert len(got) == 10 and {r["n_events"] for r in got} == {500}
    assert {r["amount"] for r in got} == {round(400 * 9.009, 4)}
    one = chain.event_exposure(events, orders, lines)
    assert one.count() == 1000 and one.select("amount").distinct().count() == 1


def test_merge_live_keeps_every_name_once(spark, rows):
    full = spark.createDataFrame([("a", "OPEN"), ("b", ""), ("c", None)], "name string, status string")
    live = spark.createDataFrame([("a", "CLOSED"), ("b", ""), ("d", "OPEN")], "name string, status string")
    got = rows(board.merge_live(full, live, "name"), "name", "status", "has_full")
    assert got == [("a", "CLOSED", True), ("b", "未知", True), ("c", "未知", True), ("d", "OPEN", False)]
    assert len(got) == keys.union_names(full, live).count()


def test_last_duplicate_wins(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "name string, pos int, v string")
    assert rows(keys.last_by_key(df, "name", ["pos"]), "name", "v") == [("a", "y"), ("b", "z")]


def test_reuse_and_process_make_the_plan(spark, rows):
    plan = spark.createDataFrame([(1, "p", "x"), (1, "p", "y"), (2, "p", "x")],
                                 "company_id long, phase string, input_sha string")
    done = plan.filter("input_sha = 'x' and company_id = 1")
    got = tasks.split_reuse(plan, done, ["company_id", "phase", "input_sha"], ["input_sha"])
    assert rows(got, "company_id", "input_sha", "action") == [
        (1, "x", "HISTORY_REUSE"), (1, "y", "PROCESS"), (2, "x", "PROCESS")]


def test_replay_needs_a_choice(spark):
    roster = spark.createDataFrame([("a",), ("b",)], "name string")
    with pytest.raises(ValueError):
        tasks.select_replay(roster, roster.limit(0), "name")
    assert tasks.select_replay(roster, roster.filter("name = 'b'"), "name").count() == 1


def test_review_rules(spark, rows):
    events = spark.createDataFrame(
        [(1, 10, "已复核", "r", "采纳", None, "2025-01-01"), (2, 10, "已复核", "r", "标记误报", "n", "2025-01-02"),
         (3, None, "已复核", "r", "采纳", "", "2025-01-03"), (4, 11, "已复核", "r", "", "", "2025-01-01")],
        "event_id long, company_id long, status string, reviewer string, decision string, note string, reviewed_at string")
    latest = review.latest_review(events)
    assert rows(latest, "company_id", "decision") == [(10, "标记误报"), (11, "采纳")]
    verdict = spark.createDataFrame([(10, True), (11, False), (12, None), (13, True)], "company_id long, risk boolean")
    assert rows(review.review_queue(verdict, latest), "company_id", "priority") == [(12, 2), (13, 1)]
    assert rows(review.feedback_set(verdict, events), "event_id", "verdict") == [(2, True)]
    state = verdict.join(latest, "company_id", "left").select(
        "company_id", review.display_state(F.col("risk"), F.col("decision")).alias("s"))
    assert dict(rows(state)) == {10: "dismissed", 11: "none", 12: "undecided", 13: "risk"}


def test_recall_counts_whole_words(spark):
    texts = [(1, "Gold, gold! goldsmith"), (2, "silver"), (3, "GOLD and silver silver"), (4, None)]
    df = spark.createDataFrame(texts, "id long, body string")
    got = search.lexical_recall(df, "gold silver", 2, "id", "body").collect()
    from math import log
    idf = log(5 / 3)
    assert [(r["id"], r["score"]) for r in got] == [(3, round(3 * idf, 4)), (1, round(2 * idf, 4))]


def test_widen_leaves_wide_tables_alone(spark):
    wide = spark.range(0, 100, 1, 8)
    assert scale.widen(wide, "id") is wide
    assert scale.widen(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == 8
