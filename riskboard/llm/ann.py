"""Nearest neighbours by inner product with multi-index hashing.

A rotation learnt on a bounded sample turns vectors into binary codes that keep angles
(iterative quantisation). To make large inner products small angles, each vector first
gets one more component that brings all to the largest norm. Rows are dealt into tiles. In
a tile each code is cut into ``PARTS`` substrings, each with an index from value to rows.
For a Hamming radius ``r``, a code within ``r`` of the query has a substring within
``r // PARTS`` of the query's, so probing all indexes with that radius retrieves every code
within ``r``; these are reranked by their floats. The radius is the one that holds
``COVER`` of the true neighbours in the sample; with more rows neighbours only come closer.
Where a tile has fewer than ``k`` rows within the radius, the radius grows until it has.

Queries meet tiles in blocks; the vectors of both are packed, so Spark moves one row per
tile and per block and tile. Each tile answers with its best ``k`` per query.

Defined cases: vectors that are null, all zero, or hold null or non-finite components take
no part, nor do rows without an id and vectors of another length than the most frequent one
(of equal counts the smallest); repeated ids are separate candidates; a repeated query id asks once, with its smallest
vector, and never finds rows of its own id; ties go to the smaller id; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import saved

# most vectors the rotation and the radius are learnt from
SAMPLE = 8192
BITS = 64
PARTS = 4
COVER = 0.98
TURNS = 20
# rows of a tile and queries of a block: a few MB each
TILE = 8192
QUERIES = 1024
# rows whose scores are equal to this share may swap in floating point: checked exactly
SLACK = 8


def usable(vector: Column) -> Column:
    """Vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def learn(sample: np.ndarray, k: int, bits: int = BITS) -> tuple[np.ndarray, int]:
    """Rotation (components x bits) and radius, from vectors brought to one norm by their
    last component; as queries they have none."""
    n, size = sample.shape
    bits = min(bits, size)
    values, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, np.argsort(-values, kind="stable")[:bits]]
    spread = sample @ axes
    turn = np.linalg.qr(np.random.default_rng(7).standard_normal((bits, bits)))[0]
    for _ in range(TURNS):
        left, _, right = np.linalg.svd(np.sign(spread @ turn).T @ spread)
        turn = (left @ right).T
    rotation = axes @ turn
    if n <= k + 1:
        return rotation, bits
    asked = np.arange(0, n, max(1, n // 256))
    queries = sample[asked].copy()
    queries[:, -1] = 0
    score = queries @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-score, k, axis=1)[:, :k]
    signs, own = (np.packbits(x @ rotation > 0, axis=1) for x in (sample, queries))
    far = np.bitwise_count(own[:, None, :] ^ signs[best]).sum(axis=2)
    return rotation, int(np.quantile(far, COVER))


def codes(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Code substrings: PARTS numbers a vector."""
    bits = (vectors @ rotation > 0).astype(np.uint8)
    width = -(-bits.shape[1] // PARTS)
    padded = np.zeros((len(bits), PARTS * width), np.uint8)
    padded[:, :bits.shape[1]] = bits
    return padded.reshape(len(bits), PARTS, width) @ (1 << np.arange(width, dtype=np.int64))


class Index:
    """Rows of a tile by the values of their code substrings of ``width`` bits."""

    def __init__(self, parts: np.ndarray, width: int):
        self.parts, self.width = parts, width
        self.tables = []
        for p in range(PARTS):
            order = np.argsort(parts[:, p], kind="stable")
            value, first = np.unique(parts[order, p], return_index=True)
            self.tables.append((value, np.append(first, len(parts)), order))

    def probed(self, p: int, asked: int, reach: int) -> np.ndarray:
        """Rows whose substring ``p`` differs from the query's in ``reach`` bits at most: by
        flipping bits of the query's value where these are fewer than the values there are,
        else by looking through the values."""
        value, first, order = self.tables[p]
        if sum(math.comb(self.width, k) for k in range(reach + 1)) < len(value):
            flipped = asked ^ _masks(self.width, reach)
            at = np.searchsorted(value, flipped)
            at = at[(at < len(value)) & (value[np.minimum(at, len(value) - 1)] == flipped)]
        else:
            at = np.flatnonzero(np.bitwise_count(value ^ asked) <= reach)
        size = first[at + 1] - first[at]
        ends = np.cumsum(size)
        return order[np.repeat(first[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def within(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """Rows, rising, whose code is within the radius of a query's."""
        hit = np.zeros(len(self.parts), bool)
        for p in range(PARTS):
            hit[self.probed(p, int(asked[p]), radius // PARTS)] = True
        rows = np.flatnonzero(hit)  # retrieved: now the whole codes
        return rows[np.bitwise_count(asked ^ self.parts[rows]).sum(axis=1) <= radius]


@cache
def _masks(width: int, reach: int) -> np.ndarray:
    """Numbers of ``width`` bits with ``reach`` bits set at most."""
    every = np.arange(1 << width, dtype=np.int64)
    return every[np.bitwise_count(every) <= reach]


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, one order of additions for all."""
    return (rows * query).sum(axis=1)


def nearest(tile: np.ndarray, tile_ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray,
            tile_parts: np.ndarray, asked_parts: np.ndarray, radius: int, bits: int, k: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, row number and score of the best ``k`` rows for each query. Only the
    floats of retrieved rows are multiplied."""
    index = Index(tile_parts, -(-bits // PARTS))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, own in enumerate(asked):
        other = tile_ids != asked_ids[q]
        want = min(k, int(other.sum()))
        reach = radius
        while True:
            rows = index.within(asked_parts[q], reach)
            rows = rows[other[rows]]
            if len(rows) >= want or reach >= bits:
                break
            reach += max(1, bits // 16)
        if not len(rows):
            continue
        score = tile[rows] @ own
        if len(rows) > k + SLACK:
            # ties beyond the slack stay in, so that the smaller id wins
            edge = -np.partition(-score, k + SLACK - 1)[k + SLACK - 1]
            rows = rows[score >= edge - 1e-9 * (1 + abs(edge))]
        true = exact(own, tile[rows])
        best = np.lexsort((tile_ids[rows], -true))[:k]
        out.append((np.full(len(best), q), rows[best], true[best]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0) for i in range(3))


def _packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per key: ids and vectors as bytes, in order of the ids."""
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        vectors = np.stack([np.asarray(v, np.float64) for v in frame["vector"]])
        out = {name: [frame[name].iloc[0]] for name in by}
        return pd.DataFrame({**out, "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
                             "vectors": [vectors.tobytes()]})
    keys = ", ".join(f"{name} bigint" for name in by)
    return rows.groupBy(*by).applyInPandas(work, f"{keys}, ids binary, vectors binary")


def search(rows: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest ``k`` of all rows of ``vec_id,
    embedding`` for the rows whose id is divisible by ``every``."""
    spark = rows.sparkSession
    vector = F.col("embedding").cast("array<double>")
    good = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector")).filter(
        F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # of vectors of different lengths those of the most frequent one
    size = good.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    if size is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    good = good.filter(F.size("vector") == size["size"])
    norm2 = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    stats = good.agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("top"), F.max(F.size("vector")).alias("size"),
                     F.sum((F.pmod("vec_id", F.lit(every)) == 0).cast("long")).alias("asked")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not stats["n"] or not stats["asked"]:
        return spark.createDataFrame([], schema)
    top = float(stats["top"])

    def lifted(vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, top - (vectors * vectors).sum(axis=1)))
        return np.hstack([vectors, rest[:, None]])

    # a share by hash, about SAMPLE rows at most
    order = F.shiftrightunsigned(F.xxhash64("vec_id"), 1)
    share = min(1.0, SAMPLE / stats["n"])
    picked = good.filter(order < int(2**63 * share)) if share < 1 else good
    sample = np.array([r["vector"] for r in picked.orderBy("vec_id").toLocalIterator()])
    if not len(sample):
        sample = np.eye(stats["size"])
    rotation, radius = learn(lifted(sample), k)
    model = spark.sparkContext.broadcast(rotation)
    bits = rotation.shape[1]

    tiles, blocks = max(1, -(-stats["n"] // TILE)), max(1, -(-stats["asked"] // QUERIES))
    dealt = F.xxhash64("vec_id", F.lit(1))
    packed = _packed(good.withColumn("tile", F.pmod(dealt, F.lit(tiles))), ["tile"])
    asked = _packed(good.filter(F.pmod("vec_id", F.lit(every)) == 0)
                    .groupBy("vec_id").agg(F.min("vector").alias("vector"))
                    .withColumn("block", F.pmod(dealt, F.lit(blocks))), ["block"])
    asked = saved(asked, "queries")
    cells = (asked.select(F.col("ids").alias("asked_ids"), F.col("vectors").alias("asked"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint"))).alias("tile"))
             .join(saved(packed, "tiles"), "tile"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = model.value
        for frame in frames:
            for asked_ids, asked_raw, ids, raw in zip(frame["asked_ids"], frame["asked"], frame["ids"], frame["vectors"]):
                q_ids, t_ids = np.frombuffer(asked_ids, np.int64), np.frombuffer(ids, np.int64)
                q = np.frombuffer(asked_raw, np.float64).reshape(len(q_ids), -1)
                t = np.frombuffer(raw, np.float64).reshape(len(t_ids), -1)
                # a query's added component is zero: it is not in the product
                q_codes = codes(np.hstack([q, np.zeros((len(q), 1))]), turn)
                at, row, score = nearest(t, t_ids, q, q_ids, codes(lifted(t), turn), q_codes, radius, bits, k)
                yield pd.DataFrame({"query_id": q_ids[at.astype(np.int64)], "vec_id": t_ids[row.astype(np.int64)],
                                    "score": score})
    found = cells.mapInPandas(work, "query_id bigint, vec_id bigint, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
