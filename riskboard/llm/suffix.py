"""Repeated passages found by a hash-compared suffix sort, and removed.

A byte goes when it lies in a ``LEAST``-byte string that also starts elsewhere in the
table, in the same text or another.

1. Each window of ``LEAST`` bytes is anchored at its smallest ``GRAM``-byte gram
   (leftmost of equals), so equal windows have equal anchors in equal places. Windows that
   follow each other and share an anchor are one row. Grams seen once are dropped.
2. For the rest, the bytes around the anchor are cut out as a slice. A slice that a batch
   of rows holds twice is known to repeat there and then; one of it goes on, with a count.
3. Slices of the same gram are suffix-sorted from the anchor rightwards, and from the
   anchor leftwards: a merge sort whose comparisons find the common extension of two
   suffixes by binary search over prefix polynomial hashes. Windows at offset ``o`` are
   equal when they share ``LEAST - o`` bytes to the right and ``o`` to the left, that is,
   lie in one run of both orders. Both orders are then proven byte by byte; if a hash
   collided, the slices are sorted by their bytes instead.
4. A gram that occurs more than ``GROUP`` times does not enter one task: its windows are
   cut singly and keyed by a 128-bit digest, so each key holds copies of one window.

The texts are shuffled once, by row key; both joins on that key share it.

Defined cases: null text is empty; texts shorter than ``LEAST`` bytes keep all; repeated
rows are copies of each other; ids may be null or repeat; an empty table gives an empty
result; other columns are carried along or not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .store import batches, joined, numbered, saved

LEAST = 200
GRAM = 40
# slices of one gram that a task sorts together: some 50 MB
GROUP = 200_000
# windows anchored at a time, and slices sorted at a time
PIECE = 1 << 18
TOGETHER = 5_000
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _byte_values() -> np.ndarray:
    """A 64-bit number for each byte value."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(27))


class Hashes:
    """Prefix polynomial hashes of a byte array: ``of(at, size)`` hashes substrings."""

    values = _byte_values()
    power = _powers(_BASE, 1)
    inverse = _powers(pow(_BASE, -1, 1 << 64), 1)

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        if n > len(Hashes.power):
            size = max(n, PIECE + LEAST + 1)
            Hashes.power = _powers(_BASE, size)
            Hashes.inverse = _powers(pow(_BASE, -1, 1 << 64), size)
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum(Hashes.values[raw] * Hashes.power[:n - 1], out=self.prefix[1:])

    def of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.prefix[at + size] - self.prefix[at]) * Hashes.inverse[at]

    def grams(self, size: int) -> np.ndarray:
        """Mixed hashes of all grams of one size."""
        n = len(self.prefix) - size
        x = (self.prefix[size:] - self.prefix[:n]) * Hashes.inverse[:n]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _anchored(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``text, gram hash, anchor, first window, last window`` of the windows of all texts
    (places in ``raw``), piece by piece."""
    for low in range(0, len(raw), PIECE):
        part = raw[low:low + PIECE + LEAST - 1]
        n = len(part) - LEAST + 1
        if n < 1:
            break
        gram = Hashes(part).grams(GRAM)
        # order by the upper half of the hash, then by place
        least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        span, size = LEAST - GRAM + 1, 1
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:n], least[span - size:span - size + n])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.arange(low, low + n)
        text = np.searchsorted(bounds, starts, side="right") - 1
        own = np.flatnonzero(starts + LEAST <= bounds[text + 1])
        if not len(own):
            continue
        cut = np.flatnonzero((np.diff(place[own]) != 0) | (np.diff(own) != 1) | (np.diff(text[own]) != 0))
        first, last = own[np.append(0, cut + 1)], own[np.append(cut, len(own) - 1)]
        yield text[first], gram[place[first]], place[first] + low, first + low, last + low


def _anchors(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data in batches(arrived, size=2 * PIECE):
        raw, bounds = joined(data)
        key = np.asarray(batch.column("_k"))
        for text, gram, at, first, last in _anchored(raw, bounds):
            spot = ((at - bounds[text]) << 16) | ((at - first) << 8) | (at - last)
            yield pa.RecordBatch.from_arrays([pa.array(key[text]), pa.array(gram.view(np.int64)), pa.array(spot)],
                                             names=["_k", "gram", "spot"])


_SLICE = pa.schema([("gram", pa.int64()), ("sid", pa.binary()), ("slice", pa.binary()), ("right", pa.int32()),
                    ("left", pa.int32()), ("n", pa.int64()), ("_k", pa.int64()), ("start", pa.int64())])


def _slices(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices around anchors, one of each in a piece of a batch. Further copies come as
    ranges known to repeat: no ``sid``, ``right`` bytes from ``start``, any key."""
    def told(seen, known):
        rows = [(*head, n, *first) for head, n, first in seen.values()]
        rows += [(key, None, None, size, 0, 0, key, start) for key, start, size in known]
        columns = zip(*rows) if rows else [[]] * len(_SLICE)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SLICE)], schema=_SLICE)

    seen, known, held = {}, [], 0
    for batch, data in batches(arrived):
        columns = [batch.column(c) for c in ("_k", "grams", "places", "singles")]
        for row, raw in enumerate(data):
            key, grams, places, singles = (c[row].as_py() for c in columns)
            for gram, place, single in zip(grams, places, singles):
                at, left, near = place >> 16, place >> 8 & 255, place & 255
                if single:
                    heads = []
                    for p in range(at - left, at - near + 1):
                        digest = blake2b(raw[p:p + LEAST], digest_size=16).digest()
                        heads.append(((int.from_bytes(digest[:8], "little", signed=True), digest, None, LEAST, 0), p))
                else:
                    cut = raw[at - left:at - near + LEAST]
                    sid = blake2b(cut, digest_size=16, salt=bytes((left, near))).digest()
                    heads = [((gram, sid, cut, LEAST - near, left), at - left)]
                for head, start in heads:
                    before = seen.get(head[1])
                    if before is None:
                        seen[head[1]] = [head, 1, (key, start)]
                        held += LEAST
                    else:
                        before[1] += 1
                        known.append((key, start, head[3] + head[4]))
            if held > 4_000_000 or len(known) > 50_000:
                yield told(seen, known)
                seen, known, held = {}, [], 0
    yield told(seen, known)


def common(hashes: Hashes, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Length of the common extension from ``a`` and ``b`` (backwards: before them), at
    most ``most``: binary search, since equal extensions have equal shorter ones."""
    size = np.zeros(len(a), np.int64)
    step = 1 << int(most.max(initial=1)).bit_length()
    while step := step >> 1:
        longer = size + step
        ok = np.flatnonzero(longer <= most)
        x, y, k = a[ok], b[ok], longer[ok]
        same = hashes.of(x - k, k) == hashes.of(y - k, k) if back else hashes.of(x, k) == hashes.of(y, k)
        size[ok[same]] = k[same]
    return size


def _after(raw, hashes, at, size, a, b, back) -> np.ndarray:
    """Order of suffixes ``a`` and ``b`` (numbers into ``at``): -1, 0 or 1."""
    most = np.minimum(size[a], size[b])
    same = common(hashes, at[a], at[b], most, back)
    out = np.sign(size[a] - size[b])
    part = np.flatnonzero(same < most)
    move = -1 - same[part] if back else same[part]
    out[part] = np.sign(raw[at[a[part]] + move].astype(np.int64) - raw[at[b[part]] + move])
    return out


def suffix_sort(raw: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray, back: bool
                ) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes within each group (``group`` ascends), and the length each
    has in common with the one before it in its group.

    Bottom-up merge sort: in each round all elements look up their place in the
    neighbouring run by binary search, with hash comparisons. ``back`` sorts by the bytes
    before ``at``, last byte first.
    """
    hashes, n = Hashes(raw), len(at)
    order = np.arange(n)
    edge = np.flatnonzero(np.diff(group, prepend=-1))
    start = np.repeat(edge, np.diff(np.append(edge, n)))
    stop = np.repeat(np.append(edge[1:], n), np.diff(np.append(edge, n)))
    width = 1
    while True:
        spot = np.flatnonzero(stop - start > width)
        if not len(spot):
            break
        run = (spot - start[spot]) // width
        mine = start[spot] + run * width
        other = start[spot] + (run ^ 1) * width
        right = run & 1
        lo = np.minimum(other, stop[spot])
        hi = np.minimum(other + width, stop[spot])
        base = lo.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            sign = _after(raw, hashes, at, size, order[mid], order[spot[open_]], back)
            before = sign < right[open_]  # of equals, the left run goes first
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        new = order.copy()
        new[np.minimum(mine, mine - right * width) + (spot - mine) + (lo - base)] = order[spot]
        order = new
        width *= 2
    same = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(group[a] == group[b])
        a, b = a[near], b[near]
        same[near + 1] = common(hashes, at[a], at[b], np.minimum(size[a], size[b]), back)
    return order, same


def proven(raw, at, size, group, back, order, same) -> bool:
    """Whether the order and the common lengths hold byte by byte: neighbours agree in as
    many bytes as said, and then ascend."""
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[a] == group[b])
    for low in range(0, len(near), 4096):
        x, y = a[near[low:low + 4096]], b[near[low:low + 4096]]
        k = same[near[low:low + 4096] + 1]
        total = np.cumsum(k)
        inner = np.arange(total[-1]) - np.repeat(total - k, k)
        move = -1 - inner if back else inner
        if (raw[np.repeat(at[x], k) + move] != raw[np.repeat(at[y], k) + move]).any():
            return False
        most = np.minimum(size[x], size[y])
        part = np.flatnonzero(k < most)
        step = -1 - k[part] if back else k[part]
        if (raw[at[x[part]] + step] >= raw[at[y[part]] + step]).any() or (size[x] > size[y])[k == most].any():
            return False
    return True


def _plain_sort(raw, at, size, group, back):
    """The same by the bytes themselves, should hashes ever collide."""
    def key(i):
        part = raw[at[i] - size[i]:at[i]][::-1] if back else raw[at[i]:at[i] + size[i]]
        return group[i], part.tobytes()
    keys = [key(i) for i in range(len(at))]
    order = sorted(range(len(at)), key=keys.__getitem__)
    same = np.zeros(len(at), np.int64)
    for p in range(1, len(order)):
        (g, x), (h, y) = keys[order[p - 1]], keys[order[p]]
        if g == h:
            most = min(len(x), len(y))
            same[p] = next((k for k in range(most) if x[k] != y[k]), most)
    return np.array(order, np.int64), same


def repeated(slices: list[bytes], left: np.ndarray, right: np.ndarray, group: np.ndarray, n: np.ndarray
             ) -> list[np.ndarray]:
    """For each slice, the windows (places in it) whose bytes occur more than once among
    the slices of its group. ``left``/``right``: bytes before and from the anchor; ``n``:
    how often a slice occurs; ``group`` ascends from 0."""
    raw, bounds = joined(slices)
    at = bounds[:-1] + left
    runs = []
    for size, back in ((right, False), (left, True)):
        order, same = suffix_sort(raw, at, size, group, back)
        if not proven(raw, at, size, group, back, order, same):
            order, same = _plain_sort(raw, at, size, group, back)
        runs.append((order, same))
    found: list[list[int]] = [[] for _ in slices]
    low = LEAST - right  # smallest offset of the anchor in a window of the slice
    edge = np.diff(group, prepend=-1) != 0  # orders keep groups in place
    for o in range(int(low.min()), int(left.max()) + 1):
        own = np.flatnonzero((low <= o) & (o <= left))
        key = np.zeros(len(slices), np.int64)
        for (order, same), least in zip(runs, (LEAST - o, o)):
            block = np.empty(len(slices), np.int64)
            block[order] = np.cumsum((same < least) | edge)
            key = key * (len(slices) + 1) + block
        _, inverse = np.unique(key[own], return_inverse=True)
        often = np.bincount(inverse, weights=n[own])[inverse] > 1
        for i in own[often].tolist():
            found[i].append(int(left[i]) - o)
    return [np.array(f[::-1], np.int64) for f in found]


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of ascending window starts, as byte ranges covered."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(),
                    (starts[np.append(cut, len(starts) - 1)] + LEAST).tolist()))


def _told(part: pd.DataFrame) -> pd.DataFrame:
    """Repeated ranges ``_k, a, b`` among rows of whole grams, ordered by gram and sid."""
    part = part.reset_index(drop=True)
    known = part["sid"].isna().to_numpy()
    out = [(part["_k"][known].to_numpy(), part["start"][known].to_numpy(),
            (part["start"] + part["right"])[known].to_numpy())]
    part = part[~known]
    if len(part):
        gram, sid = part["gram"].to_numpy(), part["sid"].to_numpy()
        head = np.append(True, (gram[1:] != gram[:-1]) | (sid[1:] != sid[:-1]))
        kind = np.cumsum(head) - 1
        n = np.bincount(kind, weights=part["n"].to_numpy())
        one = part[head]
        size = (one["left"] + one["right"]).to_numpy(np.int64)
        own = one["gram"].to_numpy()
        group = np.cumsum(np.append(0, np.diff(own) != 0))
        several = (np.bincount(group)[group] > 1) & one["slice"].notna().to_numpy()
        spans: list[list[tuple[int, int]]] = [[(0, s)] if k > 1 else [] for s, k in zip(size.tolist(), n.tolist())]
        mixed = np.flatnonzero(several)
        if len(mixed):
            _, dense = np.unique(group[mixed], return_inverse=True)
            picked = one.iloc[mixed]
            found = repeated(picked["slice"].tolist(), picked["left"].to_numpy(np.int64),
                             picked["right"].to_numpy(np.int64), dense, n[mixed])
            for k, starts in zip(mixed.tolist(), found):
                spans[k] = _spans(starts) if len(starts) else []
        count = np.array([len(s) for s in spans])
        first = np.cumsum(count) - count
        a, b = (np.array([s[k] for own in spans for s in own], np.int64) for k in (0, 1))
        each = count[kind]  # ranges of each row's slice
        place = np.repeat(first[kind] - np.cumsum(each) + each, each) + np.arange(each.sum())
        start = np.repeat(part["start"].to_numpy(), each)
        out.append((np.repeat(part["_k"].to_numpy(), each), start + a[place], start + b[place]))
    return pd.DataFrame({name: np.concatenate([o[k] for o in out]).astype(np.int64)
                         for k, name in enumerate(("_k", "a", "b"))})


def _marks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated ranges of slices that come ordered by gram and sid. Whole grams are worked
    on together; of single windows, which are all alike under one key, the rows stream by."""
    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame])
        if len(held) < TOGETHER:
            continue
        gram = held["gram"].to_numpy()
        cut = int(np.flatnonzero(gram == gram[-1])[0])  # the last gram may go on
        if cut:
            yield _told(held.iloc[:cut])
            held = held.iloc[cut:]
        if len(held) >= TOGETHER and held["slice"].isna().all():
            yield _told(held)
            held = held.iloc[-1:]
    if held is not None and len(held):
        yield _told(held)


def repeats(keyed: DataFrame, group: int = GROUP) -> DataFrame:
    """``_k, spans`` (start, end pairs in bytes) of all rows of ``_k, text`` that hold
    repeated bytes."""
    anchors = saved(keyed.select("_k", "text").mapInArrow(_anchors, "_k bigint, gram bigint, spot bigint"),
                    "anchors")
    often = saved(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                  .select("gram", (F.col("n") > group).alias("single")), "grams")
    spots = (anchors.join(often, "gram").groupBy("_k")
             .agg(F.collect_set(F.struct("gram", "spot", "single")).alias("spots"))
             .select("_k", F.col("spots.gram").alias("grams"), F.col("spots.spot").alias("places"),
                     F.col("spots.single").alias("singles")))
    # no column is left out before this join, so that its shuffle serves the last join too
    slices = keyed.join(spots, "_k").mapInArrow(_slices, from_arrow_schema(_SLICE))
    return (slices.repartition("gram").sortWithinPartitions("gram", "sid")
            .mapInPandas(_marks, "_k bigint, a bigint, b bigint")
            .groupBy("_k").agg(F.collect_set(F.struct("a", "b")).alias("spans")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_k", F.xxhash64("doc_id", "text"))


def _cleaned(raw: bytes, spans) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal ranges removed."""
    if spans is None or not len(spans):
        return raw, 0
    left, last, n = [], 0, 0
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if a > last or n == 0:
            left.append(raw[last:a])
            n += 1
        last = max(last, b)
    left.append(raw[last:])
    return b"".join(left), n


def removed(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row."""
    keyed = _keyed(docs.select("doc_id", "text"))

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in batches(arrived):
            rows = []
            for raw, spans in zip(data, batch.column("spans").to_pylist()):
                kept, n = _cleaned(raw, spans)
                rows.append((len(raw), len(raw) - len(kept), n, sha256(kept).hexdigest()))
            n_bytes, n_removed, n_spans, digest = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(n_spans, pa.int64()), pa.array(digest)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return keyed.join(repeats(keyed, group), "_k", "left").select("doc_id", "text", "spans").mapInArrow(
        work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, "
              "n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """The rows of ``docs`` with repeated bytes taken out of ``text``. A character that
    loses some of its bytes goes as a whole."""
    own = numbered(docs)
    keyed = _keyed(own)
    names = own.columns

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in batches(arrived):
            spans, texts = batch.column("spans").to_pylist(), batch.column("text")
            if any(spans):
                texts = pa.array([_cleaned(d, s)[0].decode("utf-8", "ignore") if s else t.as_py()
                                  for d, s, t in zip(data, spans, texts)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if n == "text" else batch.column(n) for n in names], names=names)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return keyed.join(repeats(keyed, group), "_k", "left").drop("_k").mapInArrow(work, kept).toDF(*docs.columns)
