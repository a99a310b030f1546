"""Near copies for a corpus: all texts with 0.8 or more of their five-word shingles in common.

Words are those of ``simhash``; five of them make a shingle, fewer make one together. Texts
first meet as in ``simhash``: their 64-bit fingerprints are compared by exclusive-or and bit
counts, tile by tile, and texts inside its radius are linked if their sets have 0.8 in common.
That radius holds the closest copies only, so what it has not joined is compared again, without
a miss, with fingerprints whose radius is exact for a share of shingles: bit ``h mod L`` of a text's
*parity fingerprint* is set when an odd number of its shingle hashes ``h`` fall on it. The
bits in which two fingerprints differ cannot outnumber the shingles that only one of the two
texts holds, and at 0.8 these are a ninth of both texts' shingles at most. L is about the number of
shingles; a longer fingerprint is folded onto a shorter one by exclusive-or.

1. Texts of equal SimHash meet the first of these, first texts meet whose SimHashes differ in
   ``simhash.RADIUS`` bits or fewer.
2. A text with n shingles is filed under the n - 0.8 n + 1 rarest of them: two texts at 0.8
   share one of those, whatever the order of the shingles. Rare ones first only keeps the
   lists short, and a sample is enough to know the common ones.
3. Each text meets the first text of each of its rare shingles unless these are joined
   already, so the copies of one text make one comparison each; components of the links found
   name what is joined.
4. Rare shingles whose texts are not all joined are compared whole, in cells of two blocks
   of ``BLOCK`` texts; rare shingles with the same texts once. A cell gives out the links
   that join something, never all pairs.

Only texts with a partner inside the radius send their whole sets, and a link is a pair
whose sets have the share in common. Components of links are groups of near copies.

Defined cases: equal shingle sets are one node, so null and blank texts are copies of each
other; a null id takes part and comes last in its group; an empty table gives an empty
result; other columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_128_digest, xxh64_digest

from . import simhash
from .graph import components
from .simhash import SEED, _LOWER
from .store import batches, discard, numbered, saved, utf8

SHINGLE, SIMILAR = 5, 0.8
# documents looked at for common shingles, and the number of these remembered
SAMPLE, COMMON = 10_000, 100_000
# texts of one rare shingle compared at a time, bits of the shortest fingerprint
BLOCK, LEAST = 512, 256


def shingles(text) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one whole text."""
    words = utf8(text).translate(_LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    plain = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends.tolist()[min(SHINGLE, len(words)) - 1:]
    return np.unique(np.frombuffer(b"".join([xxh64_digest(plain[a:b], SEED) for a, b in zip(starts, stops)]), "<i8"))


def parity(own: np.ndarray) -> bytes:
    """Fingerprint of a shingle set, of as many bits as the next power of two has."""
    bits = max(LEAST, 1 << max(0, len(own) - 1).bit_length())
    return np.packbits(np.bincount(own & (bits - 1), minlength=bits) & 1).tobytes()


def folded(raw: bytes, size: int) -> bytes:
    """The fingerprint that a shorter one of ``size`` bytes compares with."""
    while len(raw) > size:
        half = len(raw) // 2
        raw = (int.from_bytes(raw[:half]) ^ int.from_bytes(raw[half:])).to_bytes(half)
    return raw


def within(a: bytes, b: bytes, total: int) -> bool:
    """Whether sets with these fingerprints and ``total`` members in all may be at 0.8."""
    size = min(len(a), len(b))
    return 9 * (int.from_bytes(folded(a, size)) ^ int.from_bytes(folded(b, size))).bit_count() <= total


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the share in common."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= SIMILAR * (len(a) + len(b) - common)


def tile_pairs(n: np.ndarray, root: np.ndarray, side: np.ndarray, prints: list[bytes]) -> Iterator[tuple[int, int]]:
    """Places of the pairs of a cell that are inside the radius and not joined yet. With
    two sides only pairs across are looked at."""
    tile = np.frombuffer(b"".join(folded(p, LEAST // 8) for p in prints), np.uint64).reshape(len(prints), -1)
    across = (side != side[0]).any()
    for a in range(len(n) - 1):
        apart = np.bitwise_count(tile[a + 1:] ^ tile[a]).sum(1, dtype=np.int64)
        other = n[a + 1:]
        near = (9 * apart <= other + n[a]) & (root[a + 1:] != root[a])
        near &= 5 * np.minimum(other, n[a]) >= 4 * np.maximum(other, n[a])
        if across:
            near &= side[a + 1:] != side[a]
        for b in (np.flatnonzero(near) + a + 1).tolist():
            if within(prints[a], prints[b], int(n[a] + n[b])):
                yield a, b


def _lists(sets: list[np.ndarray]) -> pa.Array:
    bounds = np.append(0, np.cumsum([len(s) for s in sets]))
    values = np.concatenate(sets) if sets else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample hold, sorted, and how many do."""
    every = max(1, docs.count() // SAMPLE)

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in batches(arrived):
            found = [shingles(d) for d in data]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], names=["g"])
    found = (docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(work, "g bigint")
             .groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "g").limit(COMMON).toPandas())
    g, n = found["g"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    order = np.argsort(g)
    return g[order], n[order]


def rarest(own: np.ndarray, common: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The shingles a text is filed under."""
    # a little less than the exact product: rounding may only lengthen the list
    taken = len(own) - int(np.ceil(SIMILAR * len(own) - 1e-6)) + 1 if len(own) else 0
    if not len(common):
        return own[:taken]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    return own[np.argsort(np.where(common[at] == own, n[at], 0), kind="stable")[:taken]]


def _key() -> Column:
    """Names a row by its id and text; rows alike in both are interchangeable."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                       F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, key, digest, n, fp, print, rare`` of each row."""
    told = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in batches(arrived):
            sets = [shingles(d) for d in data]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([simhash.majority(s.view(np.uint8).reshape(-1, 8)) for s in sets], pa.int64()),
                 pa.array([parity(s) for s in sets], pa.binary()),
                 _lists([rarest(s, *told.value) for s in sets])],
                names=["doc_id", "key", "digest", "n", "fp", "print", "rare"])
    return docs.select("doc_id", _key().alias("key"), "text").mapInArrow(
        work, "doc_id bigint, key string, digest binary, n bigint, fp bigint, print binary, rare array<bigint>")


def _sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``id, set`` of the nodes ``id, key`` asked for, from one text of each."""
    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in batches(arrived):
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists([shingles(d) for d in data])], names=["id", "set"])
    return (docs.select(_key().alias("key"), "text").join(asked, "key").select("id", "text")
            .mapInArrow(work, "id bigint, set array<bigint>").dropDuplicates(["id"]))


def _inside(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``left, right`` whose sizes and fingerprints allow 0.8."""
    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            near = [within(*row) for row in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "total")))]
            yield batch.select(["left", "right"]).filter(pa.array(near, pa.bool_()))
    each = nodes.select("id", "n", "print")
    both = (pairs.join(each.toDF("left", "_n", "a"), "left").join(each.toDF("right", "_m", "b"), "right")
            .filter("5 * least(_n, _m) >= 4 * greatest(_n, _m)"))
    return both.selectExpr("left", "right", "a", "b", "_n + _m as total").mapInArrow(work, "left bigint, right bigint")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have the share in common."""
    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                a, b = ([np.asarray(x.values) for x in part.column(k)] for k in ("a", "b"))
                yield part.select(["left", "right"]).filter(pa.array([alike(x, y) for x, y in zip(a, b)], pa.bool_()))
    # the smaller end is shared by many pairs: its set joins last
    both = pairs.join(sets.toDF("right", "b"), "right").join(sets.toDF("left", "a"), "left")
    return both.select("left", "right", "a", "b").mapInArrow(work, "left bigint, right bigint")


def _cells(apart: DataFrame) -> DataFrame:
    """Rows ``g, id, many`` once for each cell ``g, i, j`` of two blocks they belong to;
    ``side`` is their own block."""
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    own = apart.withColumn("_blocks", blocks).withColumn("side", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    each = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return each.withColumns({"i": F.least("side", "_other"), "j": F.greatest("side", "_other")}).drop("_blocks", "_other", "many")


def _by_cell(rows: DataFrame, work: Callable[[pa.Table], list[tuple]], schema: str) -> DataFrame:
    """``work`` on the rows of each cell, one cell after the other."""
    def each(arrived: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in arrived:
            name = [np.asarray(batch.column(k)) for k in ("g", "i", "j")]
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in name], axis=0)) + 1
            out: list[tuple] = []
            for low, high in zip([0, *edge.tolist()], [*edge.tolist(), len(batch)]):
                if low == high:
                    continue
                own = tuple(int(k[low]) for k in name)
                if held and own != last:
                    out += work(pa.Table.from_batches(held))
                    held = []
                last = own
                held.append(batch.slice(low, high - low))
            yield out
        yield work(pa.Table.from_batches(held)) if held else []

    def told(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in each(arrived):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
    names = [f.split()[0] for f in schema.split(", ")]
    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(told, schema)


def _columns(table: pa.Table) -> tuple:
    return (table["id"].to_numpy(), table["n"].to_numpy(), table["root"].to_numpy(), table["side"].to_numpy(),
            table["print"].to_pylist())


def _asked(table: pa.Table) -> list[tuple]:
    """Rows of a cell that have a partner inside the radius."""
    if len(table) < 2:
        return []
    ids, n, root, side, prints = _columns(table)
    near = sorted({x for pair in tile_pairs(n, root, side, prints) for x in pair})
    where = [int(table[k][0].as_py()) for k in ("g", "i", "j")]
    return [(*where, int(ids[x]), int(side[x])) for x in near]


def _joining(table: pa.Table) -> list[tuple]:
    """Links of a cell that join what was not joined, checked by whole sets."""
    ids, n, root, side, prints = _columns(table)
    sets = [np.asarray(x.values) for x in table["set"]]
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x
    found = []
    for a, b in tile_pairs(n, root, side, prints):
        one, two = top(int(root[a])), top(int(root[b]))
        if one != two and alike(sets[a], sets[b]):
            parent[max(one, two)] = min(one, two)
            found.append((int(ids[a]), int(ids[b])))
    return found


def _nodes(docs: DataFrame) -> DataFrame:
    """``id, first, key, n, fp, print, rare`` of each distinct shingle set, with the id and the
    key of its first row."""
    rows = saved(_rows(docs), "texts")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("_first")
    nodes = saved(rows.groupBy("digest").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("print").alias("print"),
                                             F.first("rare").alias("rare"))
                  .select(F.monotonically_increasing_id().alias("id"), F.col("_first.doc_id").alias("first"),
                          F.col("_first.key").alias("key"), "n", "fp", "print", "rare"), "nodes")
    discard(rows)
    return nodes


def tiled(nodes: DataFrame) -> DataFrame:
    """Pairs ``left, right`` of nodes ``id, fp`` inside the SimHash radius: each node with the
    first of its fingerprint, and the first ones of two near fingerprints."""
    first = saved(nodes.groupBy("fp").agg(F.min("id").alias("low")), "prints")
    equal = nodes.select("fp", "id").join(first, "fp").filter("low < id").select(F.col("low").alias("left"), F.col("id").alias("right"))
    near = (simhash.links(first).join(first.toDF("a", "_a"), "a").join(first.toDF("b", "_b"), "b")
            .select(F.least("_a", "_b").alias("left"), F.greatest("_a", "_b").alias("right")))
    return equal.unionByName(near.distinct())


def _roots(found: DataFrame) -> DataFrame:
    return components(found).select(F.col("node").alias("id"), "root")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Checked links ``a, b`` that join whatever is joined by all links between nodes."""
    keys = nodes.select("id", "key")

    def ends(table: DataFrame, *names: str) -> DataFrame:
        return table.select(F.explode(F.array(*names)).alias("id")).distinct().join(keys, "id")

    def proven(pairs: DataFrame) -> DataFrame:
        inside = saved(_inside(pairs, nodes), "pairs")
        sets = saved(_sets(docs, ends(inside, "left", "right")), "sets")
        found = saved(_checked(inside, sets).select(F.col("left").alias("a"), F.col("right").alias("b")), "begun")
        discard(inside, sets)
        return found
    close = proven(tiled(nodes))

    joined = _roots(close)
    filed = nodes.select("id", F.explode("rare").alias("g"))
    low = filed.groupBy("g").agg(F.min("id").alias("low"), F.max("id").alias("_high")).filter("low < _high").select("g", "low")
    rare = saved(filed.join(low, "g"), "rare")
    pairs = rare.filter("low < id").select(F.col("low").alias("left"), F.col("id").alias("right")).distinct()
    pairs = (pairs.join(joined.toDF("left", "_a"), "left", "left").join(joined.toDF("right", "_b"), "right", "left")
             .filter("coalesce(_a, left) <> coalesce(_b, right)").select("left", "right"))
    begun = close.unionByName(proven(pairs))

    joined = _roots(begun)
    named = saved(rare.select("g", "id").join(joined, "id", "left").select("g", "id", F.coalesce("root", "id").alias("root")), "named")
    discard(rare, joined)
    # rare shingles with the same texts are one; 126 bits tell them apart
    mixed = (named.groupBy("g").agg(
        F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("many"),
        F.sum(F.shiftright(F.xxhash64("id"), 1).cast("decimal(20,0)")).alias("_one"),
        F.sum(F.shiftright(F.xxhash64("id", F.lit(1)), 1).cast("decimal(20,0)")).alias("_two"))
        .filter("_low < _high").groupBy("many", "_one", "_two").agg(F.min("g").alias("g")).select("g", "many"))
    apart = named.join(mixed, "g").join(nodes.select("id", "n", "print"), "id")
    cells = saved(_cells(apart), "cells")
    asked = saved(_by_cell(cells.select("g", "i", "j", "id", "n", "root", "side", "print"), _asked,
                           "g bigint, i bigint, j bigint, id bigint, side bigint"), "asked")
    sets = saved(_sets(docs, asked.select("id").distinct().join(keys, "id")), "sets")
    told = (asked.join(named.select("id", "root").distinct(), "id").join(nodes.select("id", "n", "print"), "id").join(sets, "id"))
    more = saved(_by_cell(told, _joining, "a bigint, b bigint"), "more")
    discard(named, cells, asked, sets)
    return begun.unionByName(more)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document left of each group of near copies: the one
    with the smallest id (of rows that repeat an id in a group, one stays)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = _nodes(texts)
    grouped = components(links(texts, nodes))
    named = nodes.join(grouped, nodes["id"] == grouped["node"], "left").select(
        F.coalesce("root", "id").alias("root"), "first", "key")
    # nulls last: a group is named by its smallest id
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "key")).alias("c")).select(F.col("c.key").alias("key"))
    own = numbered(docs)
    rows = own.withColumn("key", _key()).join(chosen, "key").dropDuplicates(["key"])
    return rows.select(*own.columns).toDF(*docs.columns)
