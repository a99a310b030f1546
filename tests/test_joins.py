"""As-of joins, suffix rules, long dictionaries and chains against brute force."""

import os
import random
from datetime import datetime, timedelta

import ahocorasick
import pytest
from pyspark.sql import functions as F

from riskboard.functions import scale
from riskboard.functions.domains import registered_domains
from riskboard.operators import chain, evidence, review, screening

DAY = datetime(2024, 5, 1)


# --- as-of joins


@pytest.mark.parametrize("share", [0.001, 0.9])  # with and without frequent keys
def test_as_of_equals_brute_force(spark, rows, monkeypatch, share):
    monkeypatch.setattr(scale, "HOT_SHARE", share)
    rnd = random.Random(6)
    when = lambda: DAY + timedelta(minutes=rnd.randrange(400))
    left = [(k, rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.choice([when(), when(), None])) for k in range(300)]
    right = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice([when(), when(), None]), 1000 + k, rnd.choice(["x", "y", None])) for k in range(120)]
    got = scale.as_of(spark.createDataFrame(left, "id long, key long, at timestamp_ntz"),
                      spark.createDataFrame(right, "key long, since timestamp_ntz, n long, value string"), ["key"], "at", "since",
                      ["value", "n"], ["n"])
    want = []
    for k, key, at in left:
        known = [r for r in right if r[0] == key and key is not None and at is not None and r[1] is not None and r[1] <= at]
        best = max(known, key=lambda r: (r[1], r[2]), default=(None,) * 4)
        want.append((k, key, at, best[3], best[2]))
    assert rows(got) == sorted(want, key=repr)
    assert got.columns == ["id", "key", "at", "value", "n"]


def test_as_of_carries_over_slices(spark):
    """A frequent key whose only right row lies far before most left rows."""
    left = spark.range(2000).select("id", F.lit(1).alias("key"), (F.lit(DAY).cast("timestamp_ntz") + F.expr("make_interval(0,0,0,0,0,id)")).alias("at"))
    right = spark.createDataFrame([(1, DAY + timedelta(minutes=10), "first"), (1, DAY + timedelta(minutes=1500), "second")],
                                  "key int, since timestamp_ntz, value string")
    got = scale.as_of(left, right, ["key"], "at", "since", ["value"])
    assert {(r["value"], r["n"]) for r in got.groupBy("value").agg(F.count("*").alias("n")).collect()} == {
        (None, 10), ("first", 1490), ("second", 500)}


def test_feedback_speaks_about_its_time(spark, rows):
    history = spark.createDataFrame([(1, DAY, 10, True, "OK"), (1, DAY + timedelta(days=2), 11, False, "OK"), (2, DAY, 12, None, "RUNNING")],
                                    "company_id long, ts timestamp_ntz, event_id long, risk boolean, status string")
    told = [(1, 1, "已复核", "r", "修改", "a", DAY + timedelta(days=1)), (2, 1, "已复核", "r", "标记误报", "b", DAY + timedelta(days=2)),
            (3, 1, "已复核", "r", "修改", "c", DAY - timedelta(days=1)), (4, 1, "已复核", "r", "采纳", "d", DAY), (5, 3, "已复核", "r", "修改", None, DAY)]
    reviews = spark.createDataFrame(told, "event_id long, company_id long, status string, reviewer string, decision string, note string, reviewed_at timestamp_ntz")
    got = review.feedback_as_of(history, reviews)
    assert rows(got, "event_id", "verdict", "note") == [(1, True, "a"), (2, False, "b"), (3, None, "c"), (5, None, "")]
    state = review.reviewed_history(history, reviews)
    assert rows(state, "event_id", "state") == [(10, "risk"), (11, "dismissed"), (12, "undecided")]


# --- public suffixes


def test_registered_domains(spark):
    rules = ["com", "sg", "com.sg", "id", "co.id", "io", "github.io", "jp", "kobe.jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck",
             "XN--55QX5D.cn ", "cn", "", "com"]
    want = {
        "a.com.sg": ("com.sg", "a.com.sg"), "x.a.com.sg": ("com.sg", "a.com.sg"), "com.sg": ("com.sg", "com.sg"), "foo.co.id": ("co.id", "foo.co.id"),
        "www.bar.co.id": ("co.id", "bar.co.id"), "x.github.io": ("github.io", "x.github.io"), "github.io": ("github.io", "github.io"),
        "shop.b.c.kobe.jp": ("c.kobe.jp", "b.c.kobe.jp"), "c.kobe.jp": ("c.kobe.jp", "c.kobe.jp"), "a.city.kobe.jp": ("kobe.jp", "city.kobe.jp"),
        "city.kobe.jp": ("kobe.jp", "city.kobe.jp"), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"), "a.b.ck": ("b.ck", "a.b.ck"),
        "b.ck": ("b.ck", "b.ck"), "10.0.0.1": (None, "10.0.0.1"), "[2001:db8::1]": (None, "[2001:db8::1]"), "2001:db8::1": (None, "2001:db8::1"),
        "firm.xn--55qx5d.cn": ("xn--55qx5d.cn", "firm.xn--55qx5d.cn"), "firm.unlisted": ("unlisted", "firm.unlisted"), "localhost": ("localhost", "localhost"),
        "xcom.sg": ("sg", "xcom.sg")}
    hosts = [*want, "A.Com.SG.", "a.com.sg", None, ""]
    got = registered_domains(spark.createDataFrame([(h,) for h in hosts], "host string"), spark.createDataFrame([(r,) for r in rules], "rule string"))
    assert {r["host"]: (r["suffix"], r["domain"]) for r in got.collect()} == want and got.count() == len(want)


# --- long dictionaries


def table_of(spark, entries):
    return spark.createDataFrame(entries, "keyword string, category string")


def test_only_runs_of_the_dictionary_are_shuffled(spark, monkeypatch):
    """Beyond what a task may hold, texts send the runs that the dictionary uses, not all."""
    sent = []
    met = screening.lookup
    monkeypatch.setattr(screening, "HELD", 0)
    monkeypatch.setattr(screening, "lookup", lambda fact, *rest: sent.append(fact.count()) or met(fact, *rest))
    texts = [(i, " ".join(f"{i * 7919 + j * 104729:x}" for j in range(500))) for i in range(20)] + [(20, "by Firm#000000077 and xyz")]
    words = [(f"firm#{i:09d}", "company") for i in range(300)] + [("xyz", "c")]
    got = screening.screen_keywords(spark.createDataFrame(texts, "id int, body string"),
                                    spark.createDataFrame(words, "keyword string, category string"), "body", ["id"])
    assert sorted(tuple(r) for r in got.collect()) == [(20, "firm#000000077", "company"), (20, "xyz", "c")]
    assert sent[0] < 0.05 * sum(len(t) for _, t in texts)


@pytest.mark.parametrize("held", [screening.HELD, 0])  # the dictionary at the texts, and by shuffles
def test_dictionary_forms_agree(spark, rows, monkeypatch, held):
    monkeypatch.setattr(screening, "HELD", held)
    rnd = random.Random(3)
    pool = ["Gold", "保本", "pay", "back", "高价x", "zz", "é", "\U0001f600", "}{", "a\nb", "İst", "100%"]
    texts = [(k, rnd.choice(["", " ", "　"]).join(rnd.choices(pool, k=rnd.randrange(0, 9)))) for k in range(80)] + [(900, None), (901, ""), (7, "gold" * 5000)]
    entries = [("gold", "a"), ("GOLD", "a"), ("gold", "b"), ("保本", "b"), ("保", "c"), ("backpay", "d"), ("价x", "e"), ("none", "f"), ("", "g"), ("a\nb", "h"),
               ("\U0001f600", None), ("}{", "i"), ("zzgold", "j"), (None, "k"), ("é", "l"), ("100%", "m"), ("goldgoldgold", "n")]
    text = spark.createDataFrame(texts, "id long, body string")
    low = lambda s: text.sparkSession.range(1).select(F.lower(F.lit(s))).first()[0]
    keys = {(low(k), c) for k, c in entries if k}
    lower = {r["id"]: r["t"] for r in text.filter("id <> 7").select("id", F.lower("body").alias("t")).collect()}
    want = sorted(((i, k, c) for (i, t) in texts if t is not None for k, c in keys if k in (lower[i] if i != 7 else (t if len(t) > 100 else t.lower()))), key=repr)
    got = screening.screen_keywords(text, table_of(spark, entries), "body", ["id"])
    assert rows(got) == want
    assert screening.screen_keywords(text, table_of(spark, entries).limit(0), "body", ["id"]).count() == 0
    assert screening.screen_keywords(text.limit(0), table_of(spark, entries), "body", ["id"]).count() == 0


@pytest.mark.parametrize("plain, listed", [(1 << 20, 500), (0, 0)])  # hashes as they are and as bits; few short keywords and many
def test_large_dictionaries_look_through_blocks(spark, monkeypatch, plain, listed):
    """Beyond what a task may hold a text is not cut into all its runs, and each row has its own hits."""
    monkeypatch.setattr(screening, "HELD", 0)
    monkeypatch.setattr(screening, "LISTED", listed)
    monkeypatch.setattr(scale, "PLAIN", plain, raising=False)
    plans, frame = [], type(spark.range(0))
    kept = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a: plans.append(df._jdf.queryExecution().toString()) or kept(df, *a))
    rnd = random.Random(12)
    texts = [(k % 50 or None, "".join(rnd.choices("abé保 ", k=rnd.randrange(0, 150)))) for k in range(60)] + [(7, "ab" * 60), (7, "ab" * 60), (None, None)]
    keys = set()
    for _ in range(400):
        t = rnd.choice(texts[:-1])[1] or "ab"
        at, n = rnd.randrange(max(1, len(t))), rnd.randrange(1, 60)
        keys |= {t[at:at + n], t[at:at + n] + rnd.choice("ab") * rnd.randrange(4)}
    entries = [(k, c) for k in sorted(keys - {""}) for c in ("x", None)[:1 + len(k) % 2]]
    got = screening.screen_keywords(spark.createDataFrame(texts, "key int, body string"), table_of(spark, entries), "body", ["key"])
    want = sorted(((i, k, c) for i, t in texts if t is not None for k, c in entries if k in t), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and len(want) > 1000
    assert not any("regexp_extract_all" in p for p in [*plans, got._jdf.queryExecution().toString()])


def test_hundred_thousand_keywords(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").repartition(8)
    texts = [(r["doc_id"], r["text"].lower()) for r in docs.collect() if r["text"]]
    rnd, keys = random.Random(8), set()
    while len(keys) < 100_000:
        text = rnd.choice(texts)[1]
        at = rnd.randrange(max(1, len(text) - 30))
        key = text[at:at + rnd.randrange(5, 30)]
        keys.add(key if rnd.random() < 0.1 else key[::-1] + str(len(keys)))
    keys = sorted(k for k in keys if k)
    automaton = ahocorasick.Automaton()
    for k in keys:
        automaton.add_word(k, k)
    automaton.make_automaton()
    want = sum(len({k for _, k in automaton.iter(t)}) for _, t in texts)
    got = screening.screen_keywords(docs, table_of(spark, [(k, "c") for k in keys]), "text", ["doc_id"])
    plan = got._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert plan.count("FileScan parquet") == 1 and "Exchange hashpartitioning" not in plan
    assert got.agg(F.count("*"), F.sum(F.length("keyword"))).first()[0] == want


# --- claims


def test_claims_that_mean_the_same(spark, rows):
    from riskboard.operators import evidence
    texts = [(1, "The vault in Kerala is insured"), (2, "the VAULT in Kerala is not insured"), (3, "Kerala vault: is it not not the one"),
             (4, "the mint is open"), (5, "the mint is never open, no"), (6, None), (7, ""), (8, "the the the"), (9, "the mint is not open")]
    told = evidence.claim_groups(spark.createDataFrame(texts, "id long, t string"), "id", "t", ["not", "no", "never"], 2, 3)
    # shared by three texts or more: vault, kerala, mint, open, is, the
    assert rows(told) == [(1, "kerala vault", True), (2, "kerala vault", False), (3, "kerala vault", True), (4, "mint open", True),
                          (5, "mint open", True), (8, "the", True), (9, "mint open", False)]
    torn = evidence.evidence_conflict(told.withColumnRenamed("id", "evidence_id"), ("claim_key",))
    assert rows(torn, "evidence_id", "side", "n_supporting", "n_opposing") == [
        (1, "supporting", 2, 1), (2, "opposing", 2, 1), (3, "supporting", 2, 1), (4, "supporting", 2, 1), (5, "supporting", 2, 1), (9, "opposing", 2, 1)]


# --- chains


def test_reach_equals_walks(spark, rows):
    rnd = random.Random(2)
    links = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(70)] + [("n1", f"m{k}") for k in range(40)] + [
        (f"m{k}", "hub") for k in range(40)] + [("hub", "n1"), ("n1", "n2"), ("n1", "n2"), (None, "n1"), ("n1", None)]
    starts = ["n1", "n2", "n1", "gone", None, "hub"]
    want = {}
    whole = sorted({x for x in links if None not in x})
    for start in {s for s in starts if s}:
        walks = [(start, None)]
        for hop in range(1, 5):
            walks = [(b, a) for node, _ in walks for a, b in whole if a == node]
            for node, via in walks:
                n, low = want.get((start, node, hop), (0, "~"))
                want[start, node, hop] = n + 1, min(low, via)
    got = chain.reach(spark.createDataFrame(links, "source string, target string"), spark.createDataFrame([(s,) for s in starts], "start string"), 4)
    assert rows(got) == sorted(((*k, *v) for k, v in want.items()), key=repr)


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_chains_fold_by_hashing(spark, rows, monkeypatch, held):
    """No round sorts its chains to find the smallest node, whether nodes go to all tasks or not."""
    monkeypatch.setattr(chain, "NAMES", held)
    plans, frame = [], type(spark.range(0))
    kept = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a: plans.append(df._jdf.queryExecution().toString()) or kept(df, *a))
    links = [(f"a{i}", f"b{i * j % 11}") for i in range(9) for j in (1, 2, 3)] + [(f"b{i}", f"c{i % 2}") for i in range(11)]
    got = rows(chain.reach(spark.createDataFrame(links, "source string, target string"),
                           spark.createDataFrame([("a3",), ("a5",)], "start string"), 2))
    want = {}
    for s in ("a3", "a5"):
        for _, b in {x for x in links if x[0] == s}:
            want[s, b, 1] = (1, s)
            for _, c in {x for x in links if x[0] == b}:
                n, low = want.get((s, c, 2), (0, "~"))
                want[s, c, 2] = n + 1, min(low, b)
    assert got == sorted(((*k, *v) for k, v in want.items()), key=repr)
    assert plans and not any("SortAggregate" in p for p in plans)


@pytest.mark.parametrize("held, plain", [(1 << 20, 1 << 20), (0, 1 << 20), (0, 0)])
def test_chains_are_kept_as_numbers(spark, rows, monkeypatch, held, plain):
    """No round writes its chains by names, nor tells all links apart; files of links go again."""
    monkeypatch.setattr(chain, "NAMES", held)
    monkeypatch.setattr(scale, "PLAIN", plain, raising=False)
    monkeypatch.setattr(scale, "HOT_SHARE", 0.05)
    monkeypatch.setattr(scale, "_bytes", lambda df: float("inf"))  # as if all were large: frequent nodes are salted
    written, removed, frame = [], [], type(spark.range(0))
    cut, done = frame.checkpoint, chain.__dict__.get("dropped")
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a: written.append(df.columns) or cut(df, *a))
    monkeypatch.setattr(chain, "dropped", lambda s, path: removed.append(path) or done(s, path), raising=False)
    rnd = random.Random(4)
    links = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(90)] + [("n1", f"n{k}") for k in range(40)] * 3 + [
        (None, "n1"), ("n1", None)]
    starts = ["n1", "n2", "n10", "n1", "gone", None]
    want = {}
    for start in {s for s in starts if s}:
        walks = [(start, None)]
        for hop in range(1, 4):
            walks = [(b, a) for node, _ in walks for a, b in {x for x in links if None not in x} if a == node]
            for node, via in walks:
                n, low = want.get((start, node, hop), (0, "~"))
                want[start, node, hop] = n + 1, min(low, via)
    got = chain.reach(spark.createDataFrame(links, "source string, target string"), spark.createDataFrame([(s,) for s in starts], "start string"), 3)
    assert rows(got) == sorted(((*k, *v) for k, v in want.items()), key=repr)
    assert written and not any("n_paths" in c or "target" in c for c in written)
    assert len(removed) == 4 and not any(os.path.exists(p.removeprefix("file:")) for p in removed)


def test_claims_read_each_text_twice(spark):
    """Once to count words and once to weigh them, whatever is asked of the claims."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(i):
        read.add(1)
        return f"w{i % 3} some words" + " not" * (i % 2)
    text = spark.range(60).select("id", body.asNondeterministic()("id").alias("t")).repartition(4)
    claims = evidence.claim_groups(text, "id", "t", ["not"], 1, 3).withColumnRenamed("id", "evidence_id")
    got = evidence.evidence_conflict(claims, ("claim_key",))
    assert got.count() == 60 and got.filter("n_supporting = 10 and n_opposing = 10").count() == 60
    assert read.value <= 2 * 60
