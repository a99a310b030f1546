"""Language identification as mixture inference.

Each language has a distribution over hashed letter trigrams, counted over every
labelled text. A document is a mixture: expectation-maximisation over its words
estimates the share of each language from the words' trigram likelihoods. The set of
languages that a document holds is the one with the best likelihood less
``0.5 * log(words)`` for each further share; the largest of them is the prediction.

Defined cases: a null text, or one without any letter, is ``und`` with score 0, and so
is every text when nothing is labelled; rows without a label or an id teach nothing and
are predicted like any other; repeated rows are predicted alike; ties go to the language
first in alphabetical order; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import batches, CHUNK, joined, numbered, widened

# Size of a language's trigram table; the model holds BUCKETS numbers a language.
BUCKETS = 1 << 15
SMOOTH = 0.5
ROUNDS = 12
_SPACE = 32
# lower-case ASCII letters and all bytes of non-ASCII characters count, others are blanks
_KEPT = bytes(b if 97 <= b <= 122 or b >= 128 else _SPACE for b in range(256))


def _lowered(text) -> bytes:
    return b" " + text.lower().encode("utf-8").translate(_KEPT) + b" " if isinstance(text, str) else b"  "


def _trigrams(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter byte, the first trigram of each word,
    and the number of words of each text."""
    raw, bounds = joined(data)
    letter = raw != _SPACE
    place = np.flatnonzero(letter)
    if not len(place):
        return place, place, np.zeros(len(data), np.int64)
    code = (raw[place - 1].astype(np.uint32) << 16) | (raw[place].astype(np.uint32) << 8) | raw[place + 1]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)
    first = np.flatnonzero(~letter[place - 1])
    words = np.diff(np.searchsorted(place[first], bounds))
    return bucket, first, words


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (BUCKETS x languages), from all rows
    of ``text, lang``. Each task sends one count per trigram and language it has seen."""
    def count(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch, data in batches(arrived):
            texts: dict[str, list[bytes]] = {}
            for lang, raw in zip(batch.column("lang").to_pylist(), data):
                texts.setdefault(lang, []).append(_lowered(raw.decode("utf-8")))
            for lang, own in texts.items():
                table = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                table += np.bincount(_trigrams(own)[0], minlength=BUCKETS)
        for lang, table in seen.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(table[at])], names=["lang", "bucket", "n"])

    counted = (labelled.filter("lang is not null and text is not null").select("lang", "text")
               .mapInArrow(count, "lang string, bucket int, n bigint")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
               .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("table")))
    tables = {}
    for row in counted.toLocalIterator():
        own = np.full(BUCKETS, SMOOTH)
        at, n = np.array(row["table"], np.int64).reshape(-1, 2).T
        own[at] += n
        tables[row["lang"]] = np.log(own / own.sum())
    names = sorted(tables)
    return names, np.array([tables[k] for k in names], np.float32).reshape(len(names), BUCKETS)


def mixture(like: np.ndarray, starts: np.ndarray, doc: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shares of the languages in each document. ``like``: word x language likelihoods;
    ``starts``: first word of each document; ``doc``: document of each word."""
    words = np.diff(np.append(starts, len(like)))[:, None]
    for _ in range(ROUNDS):
        part = like * share[doc]
        part /= part.sum(axis=1, keepdims=True)
        new = np.add.reduceat(part, starts, axis=0) / words
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-4:
            break
    return share


def chosen(like: np.ndarray, starts: np.ndarray, doc: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Which languages each document holds: of the sets made of the largest shares, the
    one of best penalised likelihood."""
    n_docs, n_langs = share.shape
    order = np.argsort(-share, axis=1, kind="stable")
    words = np.diff(np.append(starts, len(like)))
    kept = np.zeros_like(share, bool)
    best = np.full(n_docs, -np.inf)
    inside = np.zeros_like(share, bool)
    for k in range(n_langs):
        inside[np.arange(n_docs), order[:, k]] = True
        part = np.where(inside, share, 0)
        part /= part.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            fit = np.add.reduceat(np.log((like * part[doc]).sum(axis=1)), starts)
        fit -= 0.5 * k * np.log(np.maximum(words, 2))
        better = fit > best
        best[better] = fit[better]
        kept[better] = inside[better]
    return kept


def infer(texts: list[bytes], names: list[str], table: np.ndarray) -> list[tuple[str, float, list[str]]]:
    """Language, its share, and all languages found, for each text (lowered bytes)."""
    bucket, first, words = _trigrams(texts)
    out: list[tuple[str, float, list[str]]] = [("und", 0.0, [])] * len(texts)
    filled = np.flatnonzero(words)
    if not names or not len(filled):
        return out
    score = np.stack([np.add.reduceat(own[bucket], first) for own in table], axis=1).astype(np.float64)
    score -= score.max(axis=1, keepdims=True)
    like = np.exp(score)
    words = words[filled]
    starts = np.cumsum(words) - words
    doc = np.repeat(np.arange(len(filled)), words)
    share = mixture(like, starts, doc, np.full((len(filled), len(names)), 1 / len(names)))
    kept = chosen(like, starts, doc, share)
    share = np.where(kept, share, 0)
    share /= share.sum(axis=1, keepdims=True)
    for at, own in zip(filled.tolist(), share):
        found = [names[k] for k in np.argsort(-own, kind="stable") if own[k] > 0]
        out[at] = (found[0], float(min(1.0, own.max())), found)
    return out


def with_language(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``_lang``, ``_share`` and ``_langs``, learnt from
    ``labelled`` (``text, lang``)."""
    names, table = train(labelled)
    model = docs.sparkSession.sparkContext.broadcast((names, table))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    size = max(1, CHUNK * 4 // max(4, len(names)))

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = model.value
        for batch, data in batches(arrived, size=size):
            plain = [d.decode("utf-8") for d in data]
            told = infer([_lowered(t) for t in plain], known, logs)
            told = [x if any(map(str.isalpha, t)) else ("und", 0.0, []) for x, t in zip(told, plain)]
            yield widened(batch, _lang=pa.array([x[0] for x in told], pa.string()),
                          _share=pa.array([x[1] for x in told], pa.float64()),
                          _langs=pa.array([x[2] for x in told], pa.list_(pa.string())))
    return docs.mapInArrow(work, f"{kept}, _lang string, _share double, _langs array<string>")


def fold(ids: Column) -> Column:
    """Held-out rows: crc32 of the id as text, modulo 4, is 2. Null for a null id."""
    return F.crc32(ids.cast("string").cast("binary")) % 4 == 2


def predict(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, langs`` for each row of ``docs``; learnt
    from the rows that are not held out and have a ``lang``."""
    labelled = docs.filter(~fold(F.col("doc_id"))).select("text", "lang")
    told = with_language(docs.select("doc_id", "text"), labelled)
    return told.select("doc_id", F.coalesce(fold(F.col("doc_id")), F.lit(False)).alias("held_out"),
                       F.col("_lang").alias("lang_pred"), F.col("_share").alias("score"),
                       F.col("_langs").alias("langs"))


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose main language is known and has at least the share
    ``least`` of the text."""
    labelled = docs.filter(~fold(F.col("doc_id"))).select("text", "lang")
    own = numbered(docs)
    told = with_language(own, labelled).filter((F.col("_lang") != "und") & (F.col("_share") >= least))
    return told.select(*own.columns).toDF(*docs.columns)
