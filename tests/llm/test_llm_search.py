"""Whitening, the grammar of clauses and ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from conftest import SMALL
from riskboard.llm import fptree, queries, toxicity, whiten

LARGE = "/root/testdata/sf0.1"


# --- whitening


def plain_directions(x, k):
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return values[::-1][:k], vectors[:, ::-1][:, :k], centred


@pytest.mark.parametrize("size, wanted, decay", [(64, 32, 0), (200, 8, 0), (150, 20, 0.03), (5, 32, 0), (40, 32, 0.2)])
def test_jacobi_davidson_equals_a_full_solver(size, wanted, decay):
    x = np.random.default_rng(size).standard_normal((3000, size)) * np.exp(-decay * np.arange(size))
    want, vectors, centred = plain_directions(x, min(size, wanted))
    v = centred.T @ centred / len(x)
    values, found = whiten.leading(lambda block: v @ block, size, wanted)
    assert np.abs(values - want).max() <= 1e-13 * want[0]
    assert np.abs(v @ found - found * values).max() <= 1e-12 * want[0]
    assert np.abs(found.T @ found - np.eye(len(values))).max() <= 1e-12


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    frame = np.linalg.qr(rng.standard_normal((30, 4)))[0]
    theta, rest = np.array([0.3, -1.0]), rng.standard_normal((30, 2))
    got = whiten.corrections(lambda b: a @ b, theta, rest, frame, steps=60)
    p = np.eye(30) - frame @ frame.T
    for j in range(2):
        left = p @ (a - theta[j] * np.eye(30)) @ p @ got[:, j] + p @ rest[:, j]
        assert np.linalg.norm(left) <= 1.01 * whiten.INNER * np.linalg.norm(p @ rest[:, j])


def test_whitening_equals_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(int(i), [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((300, 6)) * [5, 4, 3, 2, 1, 0.5])]
    good += [good[0], good[0], (None, good[1][1])]
    bad = [(901, None), (902, []), (903, [1.0] * 5 + [None]), (904, [1.0] * 5 + [float("nan")]),
           (905, [float("inf")] + [0.0] * 5), (906, [1.0, 2.0]), (907, [1.0] * 7)]
    rows = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>").withColumn("n", F.lit("clash"))
    got = whiten.whitened(rows.withColumn("component", F.lit(1)).repartition(3), 4).collect()
    x = np.floor(64 * np.array([v for _, v in good])) + 1_000_000
    values, vectors, centred = plain_directions(x, 4)
    own = centred @ (vectors / np.sqrt(values))
    assert len(got) == 4 * len(good) and {r["n"] for r in got} == {len(good)}
    n, sums = len(x), x.sum(0)
    want = sorted((repr(i), k + 1, int(np.square(n * row - sums).sum()), round(abs(float(w[k])), 9))
                  for (i, _), row, w in zip(good, x, own) for k in range(4))
    assert sorted((repr(r["vec_id"]), r["component"], r["deviation"], round(abs(r["whitened"]), 9)) for r in got) == want
    total = centred.var(0).sum()
    assert max(abs(r["explained"] - values[r["component"] - 1] / total) for r in got) < 1e-12
    assert max(r["identity_error"] for r in got) < 1e-10
    sign = {}  # one sign for all rows of a component
    for r in got:
        if r["vec_id"] is not None and abs(own[r["vec_id"], r["component"] - 1]) > 1e-6:
            sign.setdefault(r["component"], set()).add(np.sign(r["whitened"] * own[r["vec_id"], r["component"] - 1]))
    assert all(len(s) == 1 for s in sign.values())


def test_whitening_without_variance(spark):
    ddl = "vec_id bigint, embedding array<float>"
    assert whiten.whitened(spark.createDataFrame([], ddl)).count() == 0
    assert whiten.whitened(spark.createDataFrame([(1, None), (2, [])], ddl)).count() == 0
    assert whiten.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, ddl)).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 7.0]) for k in range(9)], ddl)
    got = whiten.whitened(line).collect()  # one direction has variance
    assert len(got) == 9 and abs(np.var([r["whitened"] for r in got]) - 1) < 1e-12 and abs(got[0]["explained"] - 1) < 1e-12
    with pytest.raises(Exception, match="2\\^40"):
        whiten.whitened(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 0.0])], ddl)).collect()


def test_whitening_of_the_table(spark):
    got = queries.QUERIES["op11_whitening"](spark, LARGE)
    rows = spark.read.parquet(f"{LARGE}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows]))
    values, vectors, centred = plain_directions(x, 32)
    own = np.abs(centred @ (vectors / np.sqrt(values)))
    told = np.array([r["whitened"] for r in got.orderBy("vec_id", "component").collect()]).reshape(-1, 32)
    assert np.abs(np.abs(told) - own).max() < 1e-9


# --- ranked search


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k=20):
    held = [(d, Counter(t), len(t)) for d, t in ((d, plain_terms(t)) for d, t in docs) if t]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, own, _ in held for t in own)
    out = []
    for item, texts in items.items():
        asked = Counter(t for text in texts for t in plain_terms(text))
        scores = []
        for d, own, n in held:
            m = 75 + (25 * n * n_docs) // total
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((1000000000 * own[t]) // (1000 * own[t] + 12 * m)) for t, c in asked.items() if t in own)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def library():
    rnd = random.Random(4)
    texts = [" ".join(f"w{min(int(rnd.expovariate(0.05)), 150)}" for _ in range(rnd.randrange(1, 60))) for _ in range(400)]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(500 + i, texts[7]) for i in range(80)] + [(7, texts[7]), (None, texts[7]), (None, None), (601, ""), (602, " !? \x00"),
             (603, "É été É w1-w2_W3"), (604, "w5 " * 30_000), (605, "w149w" * 5000 + " w149")]
    items = [(i, " ".join(rnd.choices(texts[i].split(), k=rnd.randrange(1, 12)))) for i in range(40)]
    items += [(50, "W1 w1 É"), (51, None), (52, "none such"), (53, ""), (None, "w1"), (54, "w3 w4"), (54, "w3 w4"), (54, "w9"), (55, "w149")]
    return docs, items


@pytest.mark.parametrize("tree, run, piece, limit", [(2_000_000, 24, 4_000_000, 32_000_000), (500, 3, 64, 200), (3_000, 1, 7, 1)])
def test_search_equals_brute_force(spark, rows, library, monkeypatch, tree, run, piece, limit):
    docs, items = library
    for name, value in (("TREE", tree), ("RUN", run), ("PIECE", piece)):
        monkeypatch.setattr(fptree, name, value)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit(1)).withColumn("tf", F.lit("x"))
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit(None).cast("int"))
    told: dict = {}
    for i, t in dict.fromkeys(items):
        if i is not None and t is not None:
            told.setdefault(i, []).append(t)
    got = fptree.search(table.repartition(3), asked, limit=limit)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == plain_search(docs, told)


def test_search_of_nothing(spark, library):
    docs = spark.createDataFrame(library[0], "doc_id bigint, text string")
    items = spark.createDataFrame(library[1], "item_id bigint, text string")
    assert fptree.search(docs.limit(0), items).count() == 0
    assert fptree.search(docs, items.limit(0)).count() == 0


def test_branches_are_cut(library):
    """Far fewer runs are scored than there are documents."""
    docs, _ = library
    held = [(d, Counter(plain_terms(t))) for d, t in docs if d is not None and plain_terms(t)]
    df = Counter(t for _, own in held for t in own)
    rank = {t: i for i, t in enumerate(sorted(df, key=lambda t: (df[t], t)))}
    own = [sorted((rank[t], c) for t, c in c.items()) for _, c in held]
    sizes = np.array([len(o) for o in own], np.int64)
    tree = fptree.Tree(np.array([d for d, _ in held], np.int64), np.full(len(held), 100), np.array([t for o in own for t, _ in o], np.int64),
                       np.array([c for o in own for _, c in o], np.int64), sizes)
    seen = []
    scores = tree.scores
    tree.scores = lambda low, high, dense: seen.append(high - low) or scores(low, high, dense)
    rare = np.array([rank[t] for t in ("w149", "w120", "w1") if t in rank])
    rare.sort()
    weights = np.array([100, 90, 1], np.int64)[:len(rare)]
    dense = np.zeros(len(rank), np.int64)
    dense[rare] = weights
    best = []
    tree.search(rare, weights, dense, best, 1)
    assert best and sum(seen) < len(held) / 2


def test_ranked_query_equals_sql(spark):
    for folder in (SMALL, "/root/testdata/sf0.01"):
        ok, told = compare(spark, connect(folder), "op13_ranked", queries.QUERIES["op13_ranked"], queries.SQL["op13_ranked"], folder)
        assert ok, told


# --- toxicity


def described(text, symbols):
    names = ("insult", "marks", "target", "threat")
    return [(text[a:b], dict(zip(names, toxicity.CLASSES[c]))) for a, b, c, _ in toxicity.clauses(text, symbols)]


def test_clauses_of_the_grammar():
    symbols = toxicity.Symbols({"idiot$": 4.0, "lowei": 3.5, "scum$": 2.0})
    text = ('You are an Idiot, scum! She is not an idiot; he said the idiot left. "idiots idiot" is here.\n'
            "I will kill you, friend. They kill time? nothing\nDiese Loweischaft")
    got = described(text, symbols)
    assert got == [
        ("You are an Idiot", {"insult": 2, "marks": 0, "target": 1, "threat": 0}),
        ("scum", {"insult": 1, "marks": 0, "target": 0, "threat": 0}),
        ("She is not an idiot", {"insult": 2, "marks": toxicity.NEGATED, "target": 1, "threat": 0}),
        ("he said the idiot left", {"insult": 2, "marks": toxicity.REPORTED, "target": 1, "threat": 0}),
        ('"idiots idiot" is here', {"insult": 2, "marks": toxicity.REPORTED, "target": 0, "threat": 0}),
        ("I will kill you", {"insult": 0, "marks": 0, "target": 1, "threat": 1}),
        ("They kill time", {"insult": 0, "marks": 0, "target": 1, "threat": 1}),
        ("Diese Loweischaft", {"insult": 2, "marks": 0, "target": 0, "threat": 0})]
    factors = [toxicity.prior(tuple(d.values())) for _, d in got]
    assert factors[0] > factors[3] > 0 and factors[0] > factors[2] > 0
    assert [w for *_, w in toxicity.clauses(text, symbols)] == [4.0, 2.0, 4.0, 4.0, 4.0, toxicity.THREAT, toxicity.THREAT, 3.5]
    assert toxicity.clauses(None, symbols) == toxicity.clauses("", symbols) == toxicity.clauses(" \n 12 ", symbols) == []


def test_table_equals_the_transducers(monkeypatch):
    """The composed table, text cut into pieces, against the single machines in a row."""
    rnd = random.Random(8)
    symbols = toxicity.Symbols({"bad$": 4.0, "meh$": 1.5})
    vocabulary = ["bad", "meh", "not", "said", "you", "will", "kill", "plain", "word", ",", ".", "\n", '"', "42", ";"]
    for piece in (1_000_000, 5, 17):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        for _ in range(60):
            text = " ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 60)))
            negated = reported = 0
            clause, want = toxicity._NOTHING, []
            sentence: list = []
            for token in [*toxicity._TOKEN.findall(text), "."]:
                symbol = symbols[token]
                negated, one = toxicity._negation(negated, symbol)
                reported, two = toxicity._reported(reported, one)
                clause, out = toxicity._clause(clause, two)
                sentence += [out] if out else []
                if symbol == toxicity.SENTENCE:
                    want += sentence
                    negated, reported, sentence = 0, 0, []
            assert [toxicity.CLASSES[c] for _, _, c, _ in toxicity.clauses(text, symbols)] == want


def test_factors_are_the_posterior_maximum():
    rng = np.random.default_rng(2)
    k = len(toxicity.CLASSES)
    sums = rng.random((200, k)) * 5 * (rng.random((200, k)) < 0.1)
    label = (rng.random(200) < 0.4).astype(float)
    factors, intercept = toxicity.fitted(sums, label)
    middle = np.array([toxicity.prior(c) for c in toxicity.CLASSES] + [-3.0])
    firm = np.array([0.5] * k + [0.01])
    x = np.column_stack([np.sqrt(sums), np.ones(200)])

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - label * z).sum() + (firm * (w - middle) ** 2).sum() / 2
    found = np.append(factors, intercept)
    for j in range(k + 1):
        for step in (-1e-3, 1e-3):
            moved = found.copy()
            moved[j] += step
            assert loss(moved) > loss(found)


def test_lexicon_keeps_what_says_most():
    seen = [("tra", 130, 4.2), ("tras", 130, 4.2), ("trash", 130, 4.2), ("trash$", 130, 4.3), ("low", 60, 3.5), ("lowei", 60, 4.0),
            ("loweia", 20, 3.6), ("loweib", 25, 3.9), ("loweib$", 24, 5.0), ("rar", 9, 1.2)]
    assert toxicity.pruned(seen) == {"trash$": 4.3, "lowei": 4.0, "loweib$": 5.0, "rar": 1.2}


def test_toxicity_of_held_out_documents(spark):
    got = queries.QUERIES["op12_toxicity"](spark, LARGE).filter("held_out").join(
        spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    # the insults of three of the languages have about 30 examples each here
    assert hit / sum(r["toxic"] for r in got) >= 0.75
    assert hit / sum(r["predicted"] for r in got) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_takes_odd_and_empty_tables(spark):
    ddl = "doc_id bigint, text string, label string, score int"
    docs = [(1, "You idiot. Go away.", "x", 1), (2, None, None, None), (3, "", None, None), (None, "you idiot", None, 3), (1, "You idiot. Go away.", "x", 1),
            (4, "word " * 300_000 + "idiot", None, None)]
    rnd = random.Random(1)
    docs += [(10 + k, " ".join([*(f"w{rnd.randrange(500)}x" for _ in range(12)), "you idiot" if k % 2 else "fine day"]), None, None) for k in range(80)]
    labels = [(10 + k, k % 2) for k in range(80)] + [(None, 1), (12, None), (13, 0)]
    table, known = spark.createDataFrame(docs, ddl), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.scored(table, known).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["predicted"], r["score"]))
    assert all(len(v) == 1 for v in by.values())
    assert [r["n_clauses"] for r in got if r["doc_id"] == 4] == [1]
    assert {p for p, _ in by[1] | by[None]} == {1} and {p for p, _ in by[2] | by[3]} == {0} and by[2] == by[3]
    assert toxicity.scored(table.limit(0), known).count() == 0
    plain = toxicity.scored(table, known.limit(0)).collect()
    assert {r["predicted"] for r in plain} == {0}
    model = toxicity.train(table, known.withColumnRenamed("toxic", "label"))
    told = toxicity.matched(table.filter("doc_id = 1"), model).collect()
    assert len(told) == 2 and {(r["start"], r["stop"], r["insult"] > 0, r["target"]) for r in told} == {(0, 9, True, True)}
