"""Quality classifier: logistic regression over hashed word n-grams.

Tokens are runs of letters, of digits and of signs; features are single tokens and pairs
of neighbours (all pairs of a token with itself are one feature), hashed into ``SPACE``
places, with their share of the text's n-grams as value. Weights are learnt by follow-the-regularised-leader updates, one document after the
other, from a sample of about ``SAMPLE`` labelled documents chosen by a hash of the id.
A score is the sparse dot product of a whole text's features with the weights.

Defined cases: null, blank or empty texts score by the intercept alone; without labels
every score is 0.5; null labels and null ids teach nothing; an id labelled twice has its
larger label; repeated rows score alike; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .store import chunks, joined
from .suffix import Hashes

SPACE = 1 << 18
# labelled documents learnt from: bounds the one task that learns, and its time
SAMPLE = 12_000
ROUNDS = 3
# learning rate, its smoothing, and the two penalties
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4
# value of a feature that makes up a whole text
SCALE = 40.0
_KIND = np.array([0 if b <= 32 or b == 127 else 2 if 48 <= b <= 57 else
                  1 if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 3 for b in range(256)], np.uint8)


def features(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of all texts, and the number of n-grams of each text."""
    raw, bounds = joined(data)
    if not len(raw):
        return np.empty(0, np.int64), np.zeros(len(data), np.int64)
    kind = _KIND[raw]
    edge = np.append(True, kind[1:] != kind[:-1])
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    edge[inner] = True
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.append(starts, len(raw)))
    word = kind[starts] > 0
    starts, sizes = starts[word], sizes[word]
    if not len(starts):
        return np.empty(0, np.int64), np.zeros(len(data), np.int64)
    one = Hashes(raw).of(starts, sizes)
    text = np.searchsorted(bounds, starts, side="right") - 1
    near = np.flatnonzero(text[1:] == text[:-1])
    two = one[near] * np.uint64(0x9E3779B97F4A7C15) + one[near + 1]
    two[one[near] == one[near + 1]] = 1
    both = np.concatenate([one, two])
    owner = np.concatenate([text, text[near]])
    both = (both ^ (both >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    by = np.argsort(owner, kind="stable")
    return (both >> np.uint64(46)).astype(np.int64)[by], np.bincount(owner, minlength=len(data))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def scores(data: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text; the last weight is the intercept."""
    place, n = features(data)
    total = np.zeros(len(data))
    full = np.flatnonzero(n)
    if len(full):
        starts = np.cumsum(n[full]) - n[full]
        total[full] = np.add.reduceat(weights[place].astype(np.float64), starts) * SCALE / n[full]
    return _sigmoid(total + float(weights[-1]))


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame, data in chunks(frames):
        place, n = features(data)
        ends = np.cumsum(n)
        at, value = [], []
        for low, high in zip(ends - n, ends):
            own, times = np.unique(place[low:high], return_counts=True)
            at.append(own.astype(np.int32))
            value.append((times * (SCALE / max(1, high - low))).astype(np.float32))
        yield pd.DataFrame({"_order": frame["_order"].to_numpy(), "label": frame["label"].to_numpy(),
                            "at": at, "value": value})


def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weights from feature vectors, in the order they come, ``ROUNDS`` times over."""
    rows = [(np.append(np.asarray(a, np.int64), SPACE), np.append(np.asarray(v, np.float64), 1.0), y)
            for frame in frames for a, v, y in zip(frame["at"], frame["value"], frame["label"])]
    z, n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)

    def weight(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
    for _ in range(ROUNDS):
        for at, value, label in rows:
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            slope = (_sigmoid(w @ value) - label) * value
            step = (np.sqrt(ni + slope * slope) - np.sqrt(ni)) / ALPHA
            z[at] = zi + slope - step * w
            n[at] = ni + slope * slope
    yield pd.DataFrame({"weights": [weight(z, n).astype("<f4").tobytes()]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from the documents that ``labels`` (``doc_id, label``) names."""
    known = (labels.filter("doc_id is not null and label is not null")
             .groupBy("doc_id").agg(F.max("label").cast("int").alias("label")))
    count = known.count()
    # all of them, or a share by hash: about `sample` rows at most, whatever the table
    order = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    known = known.withColumn("_order", order)
    if count > sample:
        known = known.filter(F.col("_order") < int(2**63 * sample / count))
    rows = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
            .select("_order", "label", "text")
            .mapInPandas(_vectors, "_order bigint, label int, at array<int>, value array<float>"))
    told = rows.repartition(1).sortWithinPartitions("_order", "at").select("label", "at", "value").mapInPandas(
        learn, "weights binary").first()
    return np.frombuffer(told["weights"], "<f4") if told else np.zeros(SPACE + 1, np.float32)


def held_out(ids: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is divisible by 5; false for null."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``doc_id, text``; learnt
    from the rows of ``labels`` (``doc_id, quality``) that are not held out."""
    known = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, known))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, data in chunks(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "score": scores(data, weights.value)})
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
