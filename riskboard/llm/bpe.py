"""Byte-level BPE with a hierarchical-bitmap rank queue.

The merge queue has one bucket per merge rank. A bucket holds places in the linked list
of tokens; a bitmap of three levels marks the buckets in use, and find-first-set from the
top level down gives the lowest rank. Entries are never taken out when their pair goes:
a popped entry counts only if the pair at its place still has that rank.

Different pre-tokens never touch, so one list and one queue serve all new pre-tokens of
a batch at once, and a popped bucket is merged as a whole, left to right. That equals
merging one pair at a time unless a merge opens a pair of lower rank than its own; the
pre-tokens in which that happens are encoded again singly. Each worker keeps the ids of
pre-tokens it has seen, up to ``KEPT``; the rest of a text is table look-ups.

Defined cases: null text is empty and has no tokens; very long pre-tokens are merged
whole; special tokens are ordinary text; repeated rows encode alike; an empty table gives
an empty result; other columns are not looked at. Ranks must hold all 256 bytes, and one
id below 2^31 for each byte string.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import pretokens
from .store import batches

# pre-tokens a worker remembers before it starts afresh: some 40 MB
KEPT = 200_000
# bytes of text whose new pre-tokens are merged together, and of texts sent on at a time
TOGETHER = 1_000_000
SENT = 1_000_000
_NONE = np.int64(1) << 40


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """Byte strings and ranks of a rank file."""
    with open(path, "rb") as lines:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]


# ids of many pre-tokens: all ids, and where each pre-token's start and how many they are
Coded = tuple[np.ndarray, np.ndarray, np.ndarray]


class Bitmap:
    """Which buckets are in use: 64 buckets a word, words summed up level by level."""

    def __init__(self, n: int):
        self.levels = []
        while True:
            n = (n + 63) // 64
            self.levels.append([0] * n)
            if n == 1:
                break

    def add(self, bucket: int) -> None:
        for level in self.levels:
            word, bit = bucket >> 6, 1 << (bucket & 63)
            if level[word] & bit:
                return
            level[word] |= bit
            bucket = word

    def drop(self, bucket: int) -> None:
        for level in self.levels:
            word = bucket >> 6
            level[word] &= ~(1 << (bucket & 63))
            if level[word]:
                return
            bucket = word

    def first(self) -> int:
        """Lowest bucket in use, or -1: find-first-set on each level, top down."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = at << 6 | (word & -word).bit_length() - 1
        return at


class Merger:
    """Ids of pre-tokens under a table of ranks."""

    def __init__(self, ranks: list[tuple[bytes, int]]):
        self.ids = dict(ranks)
        order = sorted(r for _, r in ranks)
        self.bucket_id = np.array(order, np.int64)  # bucket -> id
        bucket = {r: k for k, r in enumerate(order)}
        self.byte = np.array([bucket[self.ids[bytes((b,))]] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks:
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[bucket[a] << 32 | bucket[b]] = bucket[rank]
        self.pairs = pairs
        self._hash(pairs)

    def _hash(self, pairs: dict[int, int]) -> None:
        """The pairs as an open-addressing table for whole arrays of look-ups."""
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        keys = np.array(list(pairs), np.int64)
        values = np.array(list(pairs.values()), np.int64)
        self.keys, self.values = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, _NONE)
        slot, rest = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(rest):
            self.probes += 1
            if self.probes > 64:
                raise ValueError("pairs do not spread over the table")
            free = rest[self.keys[slot[rest]] == -1]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.setdiff1d(rest, put)
            slot[rest] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Buckets that pairs of tokens merge into; ``_NONE`` where they do not."""
        keys = left << 32 | right
        slot = self._slot(keys)
        out = np.full(len(keys), _NONE)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            if not len(open_):
                break
            slot[open_] += 1
        return out

    def single(self, raw: bytes) -> list[int]:
        """One pre-token, one merge at a time."""
        token = self.byte[np.frombuffer(raw, np.uint8)].tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        used, buckets = Bitmap(len(self.bucket_id)), {}

        def put(at: int) -> None:
            rank = self.pairs.get(token[at] << 32 | token[after[at]])
            if rank is not None:
                buckets.setdefault(rank, []).append(at)
                used.add(rank)
        for at in range(n - 1):
            put(at)
        while (rank := used.first()) >= 0:
            entries = sorted(set(buckets.pop(rank)), reverse=True)
            used.drop(rank)
            while entries:
                at = entries.pop()
                end = after[at]
                if token[at] < 0 or end >= n or self.pairs.get(token[at] << 32 | token[end]) != rank:
                    continue  # stale
                token[at], token[end], after[at] = rank, -1, after[end]
                if after[at] < n:
                    before[after[at]] = at
                    put(at)
                if before[at] >= 0:
                    put(before[at])
                lowest = used.first()
                if 0 <= lowest < rank and entries:  # a lower rank goes first
                    buckets.setdefault(rank, []).extend(entries)
                    used.add(rank)
                    break
        return self.bucket_id[[t for t in token if t >= 0]].tolist()

    def many(self, pretokens: list[bytes]) -> Coded:
        """Ids of each pre-token (none of them empty)."""
        size = np.array([len(p) for p in pretokens])
        bounds = np.append(0, np.cumsum(size))
        n = int(bounds[-1])
        token = self.byte[np.frombuffer(b"".join(pretokens), np.uint8)]
        owner = np.repeat(np.arange(len(size)), size)
        # neighbours; -1 where the pre-token ends
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[bounds[1:] - 1] = -1
        before[bounds[:-1]] = -1
        rank = np.full(n, _NONE)  # of the pair that starts at a place
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self._rank(token[inner], token[after[inner]])
        again = np.zeros(len(size), bool)
        used, buckets = Bitmap(len(self.bucket_id)), {}

        def put(places: np.ndarray) -> None:
            places = places[rank[places] != _NONE]
            if not len(places):
                return
            ranks = rank[places]
            by = np.argsort(ranks, kind="stable")
            ranks, places = ranks[by], places[by]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for own, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts)):
                if own in buckets:
                    buckets[own].append(part)
                else:
                    buckets[own] = [part]
                    used.add(own)
        put(inner)
        while (low := used.first()) >= 0:
            parts = buckets.pop(low)
            used.drop(low)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[(token[at] >= 0) & (rank[at] == low)]  # stale entries go
            if not len(at):
                continue
            if len(at) > 1:
                # of pairs that overlap in a row, every second one merges
                touch = np.append(False, after[at[:-1]] == at[1:])
                if touch.any():
                    head = np.maximum.accumulate(np.where(touch, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - head) % 2 == 0]
            end = after[at]
            token[at], token[end], rank[end] = low, -1, _NONE
            beyond = after[end]
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            rank[at] = _NONE
            ahead, behind = at[has], before[at]
            behind = behind[behind >= 0]
            new = np.concatenate([ahead, behind])
            if len(new):
                new = np.unique(new)
                rank[new] = self._rank(token[new], token[after[new]])
                lower = new[rank[new] < low]
                if len(lower):
                    again[owner[lower]] = True
                put(new)
        keep = token >= 0
        ids = self.bucket_id[token[keep]]
        sizes = np.add.reduceat(keep, bounds[:-1]).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(again).tolist():
            own = self.single(pretokens[k])
            starts[k], sizes[k] = len(ids), len(own)
            ids = np.append(ids, own)
        return ids, starts, sizes


class Encoder:
    """Texts to ids: pre-tokens by a pattern, their ids by ``many``, remembered.

    What is remembered is keyed by a 64-bit hash and checked by a second one. Texts in
    which the two disagree, and other patterns, are matched and encoded afresh each time.
    """

    def __init__(self, pattern: str, many: Callable[[list[bytes]], Coded]):
        self.find = regex.compile(pattern).findall
        self.common = pattern == pretokens.PATTERN
        self.many = many
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.check = np.empty(0, np.uint64)
        self.flat = self.starts = self.sizes = np.empty(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        flat, starts, sizes = self.many([w.encode("utf-8") for w in words])
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])

    def _afresh(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of pre-tokens that no hash leads to."""
        found = [self.find(t) for t in texts]
        words = {w: k for k, w in enumerate(dict.fromkeys(w for f in found for w in f))}
        base = len(self.starts)
        if words:
            self._learn(list(words))
            self.check = np.append(self.check, np.zeros(len(words), np.uint64))
        return [np.array([base + words[w] for w in f], np.int64) for f in found]

    def number(self, texts: list[str]) -> list[np.ndarray]:
        """Number of each pre-token of each text; new ones are encoded."""
        if not self.common:
            return self._afresh(texts)
        code, place, first, second, counts = pretokens.hashed(texts)
        if code is None:
            return self._afresh(texts)
        own = np.fromiter(map(self.known.get, first.tolist(), repeat(-1)), np.int64, len(first))
        new = np.flatnonzero(own < 0)
        if (self.check[own[own >= 0]] != second[own >= 0]).any():
            return self._afresh(texts)
        if len(new):
            whole = "".join(texts)
            base = len(self.starts)
            self._learn([whole[a:b] for a, b in place[new].tolist()])
            self.check = np.append(self.check, second[new])
            own[new] = np.arange(base, base + len(new))
            self.known.update(zip(first[new].tolist(), own[new].tolist()))
        return np.split(own[code], np.cumsum(counts)[:-1])

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text, one after the other."""
        if len(self.starts) > KEPT:
            self.clear()
        part, held = [], 0
        for k, text in enumerate(texts):
            part.append(text.decode("utf-8"))
            held += len(text)
            if held > TOGETHER or k == len(texts) - 1:
                for own in self.number(part):
                    n = self.sizes[own]
                    ends = np.cumsum(n)
                    inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
                    yield self.flat[np.repeat(self.starts[own], n) + inner]
                part, held = [], 0


_ENCODERS: dict[tuple, tuple] = {}


def _tools(ranks: list[tuple[bytes, int]], pattern: str) -> tuple[Encoder, dict[int, bytes]]:
    """Encoder and decoding table of this worker, made once."""
    key = (len(ranks), hash(tuple(ranks[-50:])), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = (Encoder(pattern, Merger(ranks).many), {r: t for t, r in ranks})
    return _ENCODERS[key]


def _coded(arrived: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids of documents and of their tokens, few enough texts at a time to be sent on."""
    for batch, data in batches(arrived, size=2 * TOGETHER):
        keys = batch.column("doc_id")
        part, low, held = [], 0, 0
        for at, ids in enumerate(encoder.encode(data), 1):
            part.append(ids)
            held += len(data[at - 1])
            if held > SENT:
                yield keys.slice(low, at - low), part
                part, low, held = [], at, 0
        if part:
            yield keys.slice(low), part


def encoded(docs: DataFrame, ranks: list[tuple[bytes, int]], pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` for each row of ``doc_id, text``: the ids, and the bytes
    that they decode to. The rank table is broadcast: it is the vocabulary, whatever the
    number of rows."""
    table = docs.sparkSession.sparkContext.broadcast(ranks)

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, token = _tools(table.value, pattern)
        for keys, part in _coded(arrived, encoder):
            ends = np.append(0, np.cumsum([len(x) for x in part])).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(part).astype(np.int32)))
            plain = pa.array([b"".join(map(token.__getitem__, x.tolist())) for x in part], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, ids, plain], names=["doc_id", "ids", "decoded"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks: list[tuple[bytes, int]], pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row: ids as
    little-endian unsigned 32-bit integers, and the decoded bytes."""
    table = docs.sparkSession.sparkContext.broadcast(ranks)

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, token = _tools(table.value, pattern)
        for keys, part in _coded(arrived, encoder):
            yield pa.RecordBatch.from_arrays([
                keys, pa.array([len(x) for x in part], pa.int64()),
                pa.array([sha256(x.astype("<u4").tobytes()).hexdigest() for x in part]),
                pa.array([sha256(b"".join(map(token.__getitem__, x.tolist()))).hexdigest() for x in part])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
