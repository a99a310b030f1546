"""SimHash near-copies: tiles of fingerprints compared exactly with xor and bit counts.

Words are runs of non-blank bytes of the text with A-Z lowered; three of them make a
shingle. A fingerprint bit is set when it is set in over half of the shingles' XXH64
values. Fingerprints that differ in at most ``RADIUS`` bits are linked, and components
of links are groups of near copies.

Equal fingerprints are one node, so groups of copies cost nothing. The nodes are dealt
into tiles by the population counts of their four 16-bit quarters; two tiles are compared
only when those counts differ by at most the radius in sum, which no linked pair exceeds.
Large tiles are cut, so a task holds two lists of ``TILE`` numbers at most.

Defined cases: null or blank text has fingerprint zero and links like any other; repeated
rows link to each other; a null id takes part, and a group is named by its smallest
non-null id (null if it has none); an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_digest

from .graph import components
from .store import batches, saved, utf8, widened

RADIUS = 3
SHINGLE = 3
SEED = 42
# fingerprints in one tile: two tiles and their comparison stay under a few MB
TILE = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one whole text."""
    words = utf8(text).translate(_LOWER).split()
    if not words:
        return 0
    plain = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends.tolist()[min(shingle, len(words)) - 1:]
    digests = b"".join([xxh64_digest(plain[a:b], SEED) for a, b in zip(starts, stops)])
    return majority(np.frombuffer(digests, np.uint8).reshape(-1, 8))


def majority(raw: np.ndarray) -> int:
    """Signed number of the bits that are set in over half of the 8-byte hashes."""
    ones = np.zeros(64, np.int64)
    for low in range(0, len(raw), 65536):
        ones += np.unpackbits(raw[low:low + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw)).view(">i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """The rows with a column ``out``; all other columns are carried along."""
    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data in batches(arrived, text):
            yield widened(batch, **{out: pa.array([fingerprint(d) for d in data], pa.int64())})
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{kept}, `{out}` bigint")


def _steps() -> list[int]:
    """Moves from a tile to the tiles it must meet, each pair of tiles once. Counts sit
    in five bits each with room on both sides, so a move never carries over."""
    near = range(-RADIUS, RADIUS + 1)
    moves = (m for m in itertools.product(near, repeat=4) if sum(map(abs, m)) <= RADIUS)
    codes = (sum(d << 5 * k for k, d in enumerate(m)) for m in moves)
    return sorted(c for c in codes if c >= 0)


def _tile_code():
    parts = [F.bit_count(F.shiftright("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) + RADIUS + 1
             for k in range(4)]
    return sum((F.shiftleft(p.cast("int"), 5 * k) for k, p in enumerate(parts)), F.lit(0))


def _forest(rows: np.ndarray, cols: np.ndarray, n: int) -> list[int]:
    """Positions of links that join two parts not joined before."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    kept = []
    for k, (a, b) in enumerate(zip(rows.tolist(), cols.tolist())):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(k)
    return kept


def tile_links(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles (or inside one): enough of them to join whatever is
    joined by links within these tiles, and no more than there are fingerprints."""
    n = len(left)
    height = max(1, (1 << 19) // max(1, len(right)))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for low in range(0, n, height):
        near = np.bitwise_count(left[low:low + height, None] ^ right[None, :]) <= RADIUS
        rows, cols = np.nonzero(near)
        rows += low
        if same:
            once = rows < cols
            rows, cols = rows[once], cols[once]
        if len(rows) > n + len(right):
            kept = _forest(rows, cols if same else cols + n, n if same else n + len(right))
            rows, cols = rows[kept], cols[kept]
        a.append(rows)
        b.append(cols)
    rows, cols = np.concatenate(a), np.concatenate(b)
    if len(rows) > n + len(right):
        kept = _forest(rows, cols if same else cols + n, n if same else n + len(right))
        rows, cols = rows[kept], cols[kept]
    return left[rows], right[cols]


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        a, b = [], []
        for left, right, same in zip(frame["left"], frame["right"], frame["same"]):
            x, y = tile_links(np.asarray(left, np.int64).view(np.uint64),
                              np.asarray(right, np.int64).view(np.uint64), same)
            a.append(x)
            b.append(y)
        if a:
            yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` between the distinct values of ``fp``, enough to join all groups."""
    coded = prints.select("fp").distinct().withColumn("tile", _tile_code())
    sizes = coded.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / tile).alias("cuts"))
    packed = (coded.join(sizes, "tile")
              .groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("cuts")).alias("cut"))
              .agg(F.collect_list("fp").alias("fps")))
    packed = saved(packed, "tiles")
    moves = F.explode(F.array(*[F.lit(c) for c in _steps()])).alias("move")
    left = (packed.select("tile", F.col("cut").alias("left_cut"), F.col("fps").alias("left"), moves)
            .select((F.col("tile") + F.col("move")).alias("tile"), "left_cut", "left", "move"))
    right = packed.select("tile", F.col("cut").alias("right_cut"), F.col("fps").alias("right"))
    pairs = (left.join(right, "tile").filter("move <> 0 or left_cut <= right_cut")
             .select("left", "right", F.expr("move = 0 and left_cut = right_cut").alias("same")))
    return pairs.mapInPandas(_compare, "a bigint, b bigint")


def groups(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """``fp, root`` for each distinct fingerprint of ``prints``; ``root`` names its group."""
    linked = components(links(prints, tile)).select(F.col("node").alias("fp"), "root")
    return prints.select("fp").distinct().join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def near_copies(docs: DataFrame, text: str = "text", tile: int = TILE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``doc_id, text``."""
    prints = saved(with_fingerprints(docs.select("doc_id", F.col(text).alias("text")))
                   .select("doc_id", "fp"), "prints")
    low = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    named = groups(prints, tile).join(low, "fp")
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    byprint = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    return prints.join(byprint, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """The rows of ``docs`` with one document left of each group: the one with the
    smallest id (of rows that repeat an id in a group, one stays)."""
    own = docs.columns
    printed = saved(with_fingerprints(docs, "text", "_fp"), "printed")
    prints = printed.select("doc_id", F.col("_fp").alias("fp"))
    low = prints.groupBy("fp").agg(F.min("doc_id").alias("_low"))
    named = groups(prints, tile).join(low, "fp")
    names = named.groupBy("root").agg(F.min("_low").alias("_first"))
    # of each group one fingerprint and one id, as one key: the rows need no shuffle but this join's
    def key(fp: str, doc: str):
        return F.concat_ws(":", F.col(fp).cast("string"), F.coalesce(F.col(doc).cast("string"), F.lit("-"))).alias("_key")
    chosen = named.join(names, "root").filter(F.col("_low").eqNullSafe(F.col("_first"))).groupBy("root").agg(
        F.min(F.struct("fp", "_first")).alias("c")).select(key("c.fp", "c._first"))
    kept = printed.select(*own, key("_fp", "doc_id")).join(chosen, "_key").dropDuplicates(["_key"])
    return kept.select(*own)
