"""Toxicity: a weighted finite-state grammar of clauses.

A lexicon transducer, a trie of word beginnings and whole words, turns each word into a
symbol: insult (strong or weak), act of violence, announcement, target, negation, reporting
word. Three transducers read the symbols: one marks what stands within a few words of a
negation, one what is reported (after a reporting word or inside quotation marks, up to
the end of the sentence), and one gathers the clause: its strongest insult with its marks,
whether a target is named, whether an act of violence is announced. They are composed into
one table at import; at a clause border the table emits the class of the clause that
matched, if any. A clause weighs as much as its strongest insult, and a text's score is
logistic in the roots of its clauses' weights, added up for each class.

Insults are learnt: beginnings and whole words whose log-odds of toxic against other
labelled documents stay above ``SURE`` after two standard errors. The factors of the classes
are learnt from other labelled documents, by maximum a posteriori around the grammar's own
(``prior``), so classes without examples keep those. Both learn from a sample of about
``SAMPLE`` documents by a hash of the id; copies and near copies among them (the same least
hash of three words) teach once. The small word lists of the grammar are parameters of this
module, in English, German, French and Spanish.

Defined cases: null, blank and empty texts and texts without a matched clause score by the
intercept; without labels no insult is known and the grammar's own weights hold; null labels
and null ids teach nothing; an id labelled twice has its larger label; repeated rows score
alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_digest

from .store import batches, chunks, discard, saved

# labelled documents learnt from, and the share of them that teaches the lexicon
SAMPLE, LEXICON_SHARE = 12_000, 0.75
# lengths of word beginnings, entries of the lexicon
SHORT, LONG, ENTRIES = 3, 10, 20_000
# lower bound of the log-odds of an entry, and of one that counts as strong
SURE, STRONG_ODDS = 1.0, 2.5
# weight of an announced act of violence
THREAT = 4.0
# words a negation reaches
REACH = 3
# characters read at a time, words remembered by a worker
PIECE, WORDS = 1_000_000, 300_000
# distinct beginnings a task holds before it hands them on
HELD = 300_000

OTHER, BORDER, SENTENCE, QUOTE, NEGATION, REPORT, TARGET, WILL, VIOLENCE, WEAK, STRONG = range(11)
SYMBOLS = 11
WORDS_OF = {
    NEGATION: "not never nor neither without isn aren wasn weren don doesn didn won nicht kein keine nie niemals ohne "
              "ne pas jamais sans nunca jamás sin ni",
    REPORT: "said says say told called claims claimed wrote writes quoted sagte sagt schrieb schreibt nannte "
            "dit disait écrit appelle dijo dice escribió llamó",
    TARGET: "you your yours yourself he him she her they them their these those everyone people du dich dir euch ihr "
            "ihnen tu toi vous il elle ils elles tú te usted él ella ellos ellas",
    WILL: "will gonna shall must should werde wirst wird werden vais vas va vont voy vamos van",
    VIOLENCE: "kill hurt beat destroy shoot burn stab punch strangle töten umbringen schlagen erschießen tuer frapper "
              "brûler étrangler matar golpear quemar disparar",
}
_FIXED = {word: symbol for symbol, words in WORDS_OF.items() for word in words.split()}
_SIGNS = {**dict.fromkeys(",;:()", BORDER), **dict.fromkeys(".!?\n", SENTENCE), **dict.fromkeys('"“”„«»', QUOTE)}
_TOKEN = re.compile('[^\\W\\d_]+|[,;:().!?\n"“”„«»]')
_GAP = re.compile(r"[\W\d_]")

# --- the grammar

NEGATED, REPORTED = 1, 2


def _negation(state: int, symbol: int) -> tuple[int, tuple[int, int]]:
    """State: words the last negation still reaches."""
    if symbol in (BORDER, SENTENCE):
        return 0, (symbol, 0)
    if symbol == NEGATION:
        return REACH, (symbol, 0)
    return (state if symbol == QUOTE else max(0, state - 1)), (symbol, NEGATED if state else 0)


def _reported(state: int, marked: tuple[int, int]) -> tuple[int, tuple[int, int]]:
    """State: 0 own words, 1 after a reporting word, 2 inside quotation marks."""
    symbol, marks = marked
    if symbol == SENTENCE:
        return 0, marked
    if symbol == QUOTE:
        return (0 if state == 2 else 2), marked
    if symbol == REPORT:
        return max(1, state), marked
    return state, (symbol, marks | (REPORTED if state else 0))


_NOTHING = (0, 0, 0, 0, 0)


def _clause(state: tuple, marked: tuple[int, int]) -> tuple[tuple, tuple | None]:
    """State: tier and marks of the strongest insult, target, announcement, violence. At a
    border the clause is given out if it holds an insult or an announced act of violence."""
    symbol, marks = marked
    tier, own, target, will, violence = state
    if symbol in (BORDER, SENTENCE):
        threat = int(bool(violence and (will or target)))
        return _NOTHING, (tier, own, target, threat) if tier or threat else None
    if symbol in (WEAK, STRONG):
        better = 1 + (symbol == STRONG)
        if better > tier or (better == tier and marks.bit_count() < own.bit_count()):
            tier, own = better, marks
    elif symbol == TARGET:
        target = 1
    elif symbol == WILL:
        will = 1
    elif symbol == VIOLENCE:
        violence = 1
        own = own if tier else marks
    return (tier, own, target, will, violence), None


def compose(first: Callable, second: Callable) -> Callable:
    """The transducer that hands the output of one to the other."""
    def step(state, symbol):
        one, between = first(state[0], symbol)
        two, out = second(state[1], between)
        return (one, two), out
    return step


def _table(step: Callable, start) -> tuple[list[list[int]], list[list[int]], list[tuple]]:
    """Next states and outputs (0 none, else class + 1) by number, and the classes."""
    numbers, classes, queue = {start: 0}, {}, [start]
    nexts, outs = [], []
    for state in queue:
        to, out = [], []
        for symbol in range(SYMBOLS):
            new, told = step(state, symbol)
            if new not in numbers:
                numbers[new] = len(numbers)
                queue.append(new)
            to.append(numbers[new])
            out.append(0 if told is None else 1 + classes.setdefault(told, len(classes)))
        nexts.append(to)
        outs.append(out)
    return nexts, outs, list(classes)


_NEXT, _OUT, CLASSES = _table(compose(compose(_negation, _reported), _clause), ((0, 0), _NOTHING))


def prior(kind: tuple[int, int, int, int]) -> float:
    """The grammar's own factor of a clause: more if it is surely an insult or a threat and
    if it names a target, less if it is negated or someone else's words."""
    tier, marks, target, threat = kind
    factor = (3.0 if tier == 2 or threat else 2.0) + 0.5 * target
    return factor * (0.4 if marks & NEGATED else 1) * (0.5 if marks & REPORTED else 1)


# --- the lexicon


def parts(word: str) -> list[str]:
    """Beginnings of a word, and the word itself with an end mark."""
    return [word[:k] for k in range(SHORT, min(len(word), LONG) + 1)] + [word + "$"]


class Symbols(dict):
    """Symbols of words: the fixed words, then a trie over the learnt entries. Words met
    are remembered."""

    def __init__(self, entries: dict[str, float]):
        super().__init__(_SIGNS)
        self.trie: dict = {}
        self.odds: dict[str, float] = {}
        for entry, odds in entries.items():
            at = self.trie
            for letter in entry:
                at = at.setdefault(letter, {})
            at[""] = odds

    def __missing__(self, word: str) -> int:
        low = word.lower()
        symbol = _FIXED.get(low, OTHER)
        if not symbol:
            at, odds = self.trie, 0.0
            for letter in low + "$":
                at = at.get(letter)
                if at is None:
                    break
                odds = max(odds, at.get("", 0.0))
            if odds:
                symbol, self.odds[low] = STRONG if odds >= STRONG_ODDS else WEAK, odds
        if len(self) < WORDS:
            self[word] = symbol
        return symbol


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """A whole text in pieces with their places, cut between words."""
    low = 0
    while len(text) - low > PIECE:
        high = low + PIECE
        while high > low and not _GAP.match(text[high - 1]):
            high -= 1
        if high == low:  # a word longer than a piece
            found = _GAP.search(text, low + PIECE)
            high = found.end() if found else len(text)
        yield low, text[low:high]
        low = high
    yield low, text[low:]


def clauses(text, symbols: Symbols) -> list[tuple[int, int, int, float]]:
    """Matched clauses of a whole text: first and last character (exclusive), class, weight."""
    if not text:
        return []
    told = [np.fromiter(map(symbols.__getitem__, _TOKEN.findall(p)), np.uint8) for _, p in pieces(text)]
    symbol = np.concatenate(told)
    asked = np.flatnonzero(symbol >= VIOLENCE)
    if not len(asked):
        return []
    # only sentences with an insult or an act of violence can match
    ends = np.append(np.flatnonzero(symbol == SENTENCE), len(symbol))
    sentence = np.unique(np.searchsorted(ends, asked))
    spans = np.array([(low + m.start(), low + m.end()) for low, p in pieces(text) for m in _TOKEN.finditer(p)], np.int64)
    found = []
    for k in sentence.tolist():
        low, high = int(ends[k - 1]) + 1 if k else 0, int(ends[k])
        state, begin, odds = 0, low, 0.0
        for at, own in enumerate([*symbol[low:high].tolist(), SENTENCE], low):
            out = _OUT[state][own]
            state = _NEXT[state][own]
            if own >= WEAK:
                odds = max(odds, symbols.odds[text[spans[at, 0]:spans[at, 1]].lower()])
            if out:
                weight = max(odds, THREAT * CLASSES[out - 1][3])
                found.append((int(spans[begin, 0]), int(spans[max(begin, at - 1), 1]), out - 1, weight))
            if own in (BORDER, SENTENCE):
                begin, odds = at + 1, 0.0
    return found


@dataclass(frozen=True)
class Model:
    """Learnt entries with their log-odds, factors of the classes, and the intercept."""
    entries: dict[str, float]
    factors: np.ndarray
    intercept: float

    def score(self, sums: np.ndarray) -> np.ndarray:
        """Probabilities of texts from the weights of their clauses by class."""
        return 1 / (1 + np.exp(-np.clip(np.sqrt(sums) @ self.factors + self.intercept, -35, 35)))


def _sums(found: list[tuple[int, int, int, float]]) -> np.ndarray:
    """Weights of a text's clauses added up by class."""
    return np.bincount([f[2] for f in found], [f[3] for f in found], minlength=len(CLASSES))


# --- learning


def _odds(n1: str, n0: str, toxic: int, clean: int) -> Column:
    """Log-odds of toxic documents, less two standard errors."""
    one, none = F.col(n1) + 0.5, F.col(n0) + 0.5
    return (F.log(one / (toxic + 1)) - F.log(none / (clean + 1))
            - 2 * F.sqrt(1 / one + 1 / none - F.lit(1 / (toxic + 1) + 1 / (clean + 1))))


def pruned(seen: list[tuple[str, int, float]]) -> dict[str, float]:
    """Of entries ``part, toxic documents, odds`` those to keep: a beginning goes when one
    longer entry accounts for nearly all of it, and an entry that says no more than a
    beginning that stays."""
    below: dict[str, int] = {}
    for part, n, _ in seen:
        for k in range(SHORT, len(part)):
            below[part[:k]] = max(below.get(part[:k], 0), n)
    kept: dict[str, float] = {}
    for part, n, odds in sorted(seen, key=lambda e: (len(e[0]), e[0])):
        above = max((kept.get(part[:k], 0.0) for k in range(SHORT, len(part))), default=0.0)
        if below.get(part, 0) < 0.9 * n and odds > above + (0.5 if above else 0.0):
            kept[part] = odds
    return kept


def _marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with the least hash of three words: near copies mostly share it."""
    for frame, data in chunks(frames):
        words = [d.split() for d in data]
        yield frame.assign(mark=[min((xxh64_digest(b" ".join(w[i:i + 3])) for i in range(max(1, len(w) - 2))), default=b"")
                                 for w in words])


def _lexicon(rows: DataFrame) -> dict[str, float]:
    """Entries with their log-odds, from rows ``label, text``."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def told() -> pd.DataFrame:
            both = [(p, label, n) for label, own in held.items() for p, n in own.items()]
            return pd.DataFrame(both, columns=["part", "label", "n"])
        for frame, data in chunks(frames):
            for label, raw in zip(frame["label"], data):
                words = {w.lower() for _, p in pieces(raw.decode("utf-8")) for w in set(_TOKEN.findall(p)) if w[0].isalpha()}
                held[int(label > 0)].update({p for w in words if w not in _FIXED for p in parts(w)})
                if len(held[0]) + len(held[1]) > HELD:
                    yield told()
                    held[0].clear()
                    held[1].clear()
        yield told()
    sizes = {r["label"]: r["n"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = (rows.mapInPandas(work, "part string, label int, n bigint").groupBy("part")
            .agg(F.sum(F.col("n") * F.col("label")).alias("n1"), F.sum(F.col("n") * (1 - F.col("label"))).alias("n0")))
    best = (seen.filter("n1 > 1").withColumn("odds", _odds("n1", "n0", sizes.get(1, 0), sizes.get(0, 0)))
            .filter(F.col("odds") >= SURE).orderBy(F.desc("odds"), "part").limit(ENTRIES).toPandas())
    return pruned(list(zip(best["part"], best["n1"].tolist(), best["odds"].tolist())))


def fitted(sums: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Factors and intercept: logistic regression over roots of sums, drawn to ``prior``."""
    x = np.column_stack([np.sqrt(sums), np.ones(len(sums))])
    middle = np.array([prior(c) for c in CLASSES] + [-3.0])
    firm = np.array([0.5] * len(CLASSES) + [0.01])
    w = middle.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (p - label) + firm * (w - middle)
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(firm)
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and weights from the documents that ``labels`` (``doc_id, label``) names."""
    known = (labels.filter("doc_id is not null and label is not null")
             .groupBy("doc_id").agg(F.max("label").cast("int").alias("label")))
    count = known.count()
    # all of them, or a share by hash: about `sample` rows at most, whatever the table
    known = known.withColumn("_order", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    if count > sample:
        known = known.filter(F.col("_order") < int(2**63 * sample / count))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("_order", "label", "text")
    marked = rows.mapInPandas(_marked, "_order bigint, label int, text string, mark binary")
    rows = saved(marked.groupBy("mark").agg(F.min(F.struct("_order", "label", "text")).alias("r")).select("r.*"), "sample")
    own = F.pmod(F.xxhash64("_order"), F.lit(1000)) < int(1000 * LEXICON_SHARE)
    entries = _lexicon(rows.filter(own).select("label", "text"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols = Symbols(entries)
        for frame, data in chunks(frames):
            yield pd.DataFrame({"_order": frame["_order"].to_numpy(), "label": frame["label"].to_numpy(), "sums": [
                _sums(clauses(d.decode("utf-8"), symbols)).tolist() for d in data]})
    # a few thousand short rows: the sample bounds them
    told = (rows.filter(~own).mapInPandas(work, "_order bigint, label int, sums array<double>")
            .orderBy("_order", "label").toPandas())
    discard(rows)
    sums = np.array(told["sums"].tolist(), float).reshape(-1, len(CLASSES))
    factors, intercept = fitted(sums, (told["label"] > 0).to_numpy(float))
    return Model(entries, factors, intercept)


# --- use


def held_out(ids: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is divisible by 5; false for null."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def matched(docs: DataFrame, model: Model) -> DataFrame:
    """Each matched clause of ``doc_id, text``: ``doc_id, start, stop, insult`` (0 none, 1
    weak, 2 strong), ``threat, target, negated, reported, weight``; places in characters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        symbols = Symbols(own.entries)
        for batch, data in batches(arrived):
            hits = [(i, *hit) for i, d in enumerate(data) for hit in clauses(d.decode("utf-8"), symbols)]
            told = [CLASSES[h[3]] for h in hits]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())),
                pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64()),
                pa.array([t[0] for t in told], pa.int32()), pa.array([bool(t[3]) for t in told], pa.bool_()),
                pa.array([bool(t[2]) for t in told], pa.bool_()), pa.array([bool(t[1] & NEGATED) for t in told], pa.bool_()),
                pa.array([bool(t[1] & REPORTED) for t in told], pa.bool_()),
                pa.array([h[4] for h in hits], pa.float64())],
                names=["doc_id", "start", "stop", "insult", "threat", "target", "negated", "reported", "weight"])
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, start bigint, stop bigint, insult int, threat boolean, target boolean, "
              "negated boolean, reported boolean, weight double")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_clauses, score`` for each row of ``doc_id, text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        symbols = Symbols(own.entries)
        for batch, data in batches(arrived):
            found = [clauses(d.decode("utf-8"), symbols) for d in data]
            sums = np.array([_sums(f) for f in found]).reshape(-1, len(CLASSES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(f) for f in found], pa.int64()), pa.array(own.score(sums))],
                                             names=["doc_id", "n_clauses", "score"])
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_clauses bigint, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_clauses`` for each row of ``doc_id, text``;
    learnt from the rows of ``labels`` (``doc_id, toxic``) that are not held out."""
    known = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    return scores(docs, train(docs, known)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_clauses")
