"""Keys under which two sets meet if they have a given share in common: a set is dealt into
segments by the hashes of its members, and like sets have a whole segment in common.

Sets of ``a`` and ``b`` members at share ``t`` differ in (a + b)(1 - t) / (1 + t) members at most,
and the larger has at most 1 / t times the members of the smaller one. Dealt into more segments
than that, some are the same in both. So a key stands for all that a segment holds: unlike a
single member, it is hardly ever shared by chance, however many sets there are.

Sizes are cut into classes of 1 / t. A pair meets at the class of its smaller set, so a set is
filed at its own class and, if a set of the class below may be its partner, there too. Segments
that hold nothing but common members are no keys; which are common a sample tells. A set that is
left with no more keys than members may differ has all its filled segments for keys, and its least
members besides if these are no more either; a pair that no other key joins consists of two such sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# segments beyond the number of members that may differ: some are left empty
SPARE, MORE = 0.15, 3
# bits of the shortest print
LEAST = 64
# sets looked at for common members, and the number of these remembered
SAMPLE, COMMON = 10_000, 100_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def classes(threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each class of sizes up to ``most``: its least size, the largest size of a partner,
    and the number of members in which a pair may differ."""
    low, high, apart = [1], [], []
    while low[-1] <= most:
        # a little more than the exact values: rounding may only add keys
        top = int(low[-1] / threshold + 1e-6)
        high.append(int(top / threshold + 1e-6))
        apart.append(int((top + high[-1]) * (1 - threshold) / (1 + threshold) + 1e-6))
        low.append(top + 1)
    return np.array(low[:-1]), np.array(high), np.array(apart)


def common(sets: DataFrame, id_col: str, set_col: str) -> np.ndarray:
    """Members that several sets of a sample hold, sorted."""
    every = max(1, sets.count() // SAMPLE)
    found = (sets.filter(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0).select(F.explode(set_col).alias("g"))
             .groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "g").limit(COMMON).toPandas())
    return np.sort(found["g"].to_numpy(np.int64))


def keys(members: np.ndarray, bounds: np.ndarray, threshold: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets ``members[bounds[k]:bounds[k + 1]]`` and the place of each one's set;
    ``known`` are the common members, sorted."""
    rare = np.ones(len(members), bool)
    if known is not None and len(known):
        rare = known[np.minimum(np.searchsorted(known, members), len(known) - 1)] != members
    members = members.view(np.uint64)
    size = np.diff(bounds)
    low, high, apart = classes(threshold, int(size.max(initial=0)))
    own = np.searchsorted(low, size, side="right") - 1
    place = np.repeat(np.arange(len(size)), size)
    told, whose = [], []
    for level in (own, own - 1):
        filed = (level >= 0) & (size > 0)
        level = np.where(filed, level, 0)
        filed &= (size <= high[level]) & (apart[level] > 0)
        parts = np.where(filed, ((1 + SPARE) * apart[level]).astype(np.int64) + MORE, 0)
        begin = np.append(0, np.cumsum(parts))
        part = filed[place]
        value, of = members[part], place[part]
        at = begin[of] + (value % parts[of].astype(np.uint64)).astype(np.int64)
        held = np.zeros(begin[-1], np.uint64)
        np.add.at(held, at, _mixed(value + _ODD[0]))
        filled, taken = np.zeros(begin[-1], bool), np.zeros(begin[-1], bool)
        filled[at] = True
        taken[at[rare[part]]] = True
        of = np.repeat(np.arange(len(size)), parts)
        few = filed & (np.bincount(of[taken], minlength=len(size)) <= apart[level])
        taken |= filled & few[of]
        salt = _mixed(((level << 40)[of] + np.arange(begin[-1]) - begin[of]).astype(np.uint64))
        told.append(_mixed(held + salt)[taken])
        whose.append(of[taken])
        for k in np.flatnonzero(filed & (np.bincount(of[filled], minlength=len(size)) <= apart[level])):
            least = int(size[k] - np.ceil(threshold * size[k] - 1e-6)) + 1
            told.append(_mixed(np.sort(members[bounds[k]:bounds[k + 1]])[:least] + _mixed(np.uint64([level[k]])) + _ODD[1]))
            whose.append(np.full(least, k))
    return np.concatenate(told).view(np.int64), np.concatenate(whose)


def filed(sets: DataFrame, id_col: str, set_col: str, threshold: float) -> DataFrame:
    """``_g, id``: the keys of all sets of 64-bit hashes."""
    known = sets.sparkSession.sparkContext.broadcast(common(sets, id_col, set_col))

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            column = batch.column(set_col)
            bounds = np.asarray(column.offsets).astype(np.int64)
            told, whose = keys(np.asarray(column.values)[bounds[0]:bounds[-1]], bounds - bounds[0], threshold, known.value)
            ids = batch.column(id_col).take(pa.array(whose))
            for begin in range(0, len(told), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(told[begin:begin + 100_000]), ids.slice(begin, 100_000)], names=["_g", id_col])
    kind = sets.schema[id_col].dataType.simpleString()
    return sets.select(id_col, set_col).mapInArrow(work, f"_g bigint, `{id_col}` {kind}")


def parity(members: np.ndarray) -> bytes:
    """Print of a set, of as many bits as the next power of two has."""
    bits = max(LEAST, 1 << max(0, len(members) - 1).bit_length())
    return np.packbits(np.bincount(members & (bits - 1), minlength=bits) & 1).tobytes()


def _folded(raw: bytes, size: int) -> int:
    told = int.from_bytes(raw)
    for half in (4 * len(raw) >> k for k in range((len(raw) // size).bit_length() - 1)):
        told = (told >> half) ^ (told & ((1 << half) - 1))
    return told


def within(a: bytes, b: bytes, apart: int) -> bool:
    """Whether sets with these prints may differ in ``apart`` members only."""
    size = min(len(a), len(b))
    return (_folded(a, size) ^ _folded(b, size)).bit_count() <= apart


def prints(sets: DataFrame, id_col: str, set_col: str) -> DataFrame:
    """``id, n, print``: the size and the print of all sets of 64-bit hashes."""
    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            own = [np.asarray(x.values) for x in batch.column(set_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([len(x) for x in own], pa.int64()),
                                              pa.array([parity(x) for x in own], pa.binary())], names=[id_col, "n", "print"])
    kind = sets.schema[id_col].dataType.simpleString()
    return sets.select(id_col, set_col).mapInArrow(work, f"`{id_col}` {kind}, n bigint, print binary")


def near(pairs: DataFrame, told: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``left, right`` whose sizes and prints (``_id, n, print``) allow the threshold."""
    share = (1 - threshold) / (1 + threshold)

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            each = zip(*(batch.column(k).to_pylist() for k in ("_a", "_b", "_total")))
            found = [within(a, b, int(total * share + 1e-6)) for a, b, total in each]
            yield batch.select(["left", "right"]).filter(pa.array(found, pa.bool_()))
    both = (pairs.join(told.toDF("left", "_n", "_a"), "left").join(told.toDF("right", "_m", "_b"), "right")
            .filter(f"least(_n, _m) >= {threshold - 1e-9} * greatest(_n, _m)"))
    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in ("left", "right"))
    return both.selectExpr("left", "right", "_a", "_b", "_n + _m as _total").mapInArrow(work, kinds)
