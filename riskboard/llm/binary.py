"""Token ids in Simple-8b files.

A 64-bit word holds a selector (top 4 bits) and as many ids as fit its 60 other bits at
the selector's width. Each block of ``BLOCK`` ids starts a new word, and a file lists the
word each block starts at, so blocks decode by themselves and whole arrays at a time. Ids
of more than 60 bits are escaped: the word holds 0 and a list holds place and value.

A file is one byte string, little-endian::

    "S8B1" | u32 documents | u64 ids | u32 blocks | u32 escapes
    i64 id of each document | u32 length of each document
    u64 first word of each block, and the number of words
    u64 place, u64 value of each escape
    u64 words

Files are rows of a Parquet table (``shard, part, n_ids, payload``), written by Spark in
the shared folder: documents ascend within a file, parts within a shard, and shards.

Defined cases: null text is empty; an empty text is the end id alone; null ids come
first; repeated rows are documents of their own, ordered by text; an empty table writes
no file; other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import Coded, Encoder
from .store import chunks, saved

BLOCK = 4096
# blocks packed at a time, and text of one file in bytes: bound the memory of a task
TOGETHER = 64
FILE = 4_000_000
# ids in a word and bits for each, by selector
PACKS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
         (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_ESCAPE = np.uint64(1) << np.uint64(60)
_NULL = np.iinfo(np.int64).min


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the values (unsigned, below 2^60), and the first word of each block."""
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words, blocks, done = [], [], 0
    for low in range(0, n, TOGETHER * BLOCK):
        part, first = _pack(values[low:low + TOGETHER * BLOCK])
        words.append(part)
        blocks.append(first + done)
        done += len(part)
    return np.concatenate(words), np.concatenate(blocks)


def _pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, tail = len(values), PACKS[0][0]
    rows = -(-n // BLOCK)
    # each block with zeros behind it: what lies past its end always fits
    kind = np.uint32 if values.max() < 1 << 32 else np.uint64
    grid = np.zeros((rows, BLOCK + tail), kind)
    flat = np.zeros(rows * BLOCK, kind)
    flat[:n] = values
    grid[:, :BLOCK] = flat.reshape(rows, BLOCK)
    choice = np.full((rows, BLOCK), len(PACKS) - 1, np.uint8)
    for selector in range(len(PACKS) - 2, -1, -1):
        count, width = PACKS[selector]
        wide = np.zeros((rows, BLOCK + tail + 1), np.int16)
        np.cumsum(grid >= (1 << width), axis=1, dtype=np.int16, out=wide[:, 1:])
        fits = wide[:, count:count + BLOCK] == wide[:, :BLOCK]
        choice[fits] = selector
        if not fits.any():  # then longer runs of narrower values fit nowhere either
            break
    # from word to word, in all blocks
    jump, step = choice.tobytes(), [c for c, _ in PACKS]
    starts, firsts = [], []
    for row in range(rows):
        at, end = row * BLOCK, min(n, (row + 1) * BLOCK)
        firsts.append(len(starts))
        while at < end:
            starts.append(at)
            at += step[jump[at]]
    starts = np.array(starts)
    chosen = choice.ravel()[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    place = starts + starts // BLOCK * tail  # in the grid
    plain = grid.ravel()
    for selector, (count, width) in enumerate(PACKS):
        own = np.flatnonzero(chosen == selector)
        if width and len(own):
            for k in range(count):
                words[own] |= plain[place[own] + k].astype(np.uint64) << np.uint64(width * k)
    return words, np.array(firsts)


def unpack(words: np.ndarray, n: int, blocks: np.ndarray) -> np.ndarray:
    """The values, all words of one selector at a time."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in PACKS])[chosen]
    block = np.searchsorted(blocks, np.arange(len(words)), side="right") - 1
    ends = np.cumsum(counts)
    before = ends - counts
    starts = block * BLOCK + before - before[blocks[block]]
    stop = np.minimum((block + 1) * BLOCK, n)
    for selector, (count, width) in enumerate(PACKS):
        own = np.flatnonzero(chosen == selector)
        if not width or not len(own):
            continue
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            live = own[starts[own] + k < stop[own]]
            out[starts[live] + k] = words[live] >> np.uint64(width * k) & mask
    return out


def write_file(docs: np.ndarray, ids: list[np.ndarray]) -> bytes:
    """One file of whole documents."""
    sizes = np.array([len(x) for x in ids], "<u4")
    values = np.concatenate(ids).astype(np.uint64) if ids else np.empty(0, np.uint64)
    wide = np.flatnonzero(values >= _ESCAPE)
    escapes = np.stack([wide.astype("<u8"), values[wide].astype("<u8")], axis=1)
    values[wide] = 0
    words, blocks = pack(values)
    head = np.array([len(docs)], "<u4").tobytes() + np.array([len(values)], "<u8").tobytes()
    head += np.array([len(blocks), len(wide)], "<u4").tobytes()
    bounds = np.append(blocks, len(words)).astype("<u8")
    return b"".join([b"S8B1", head, docs.astype("<i8").tobytes(), sizes.tobytes(), bounds.tobytes(),
                     escapes.tobytes(), words.astype("<u8").tobytes()])


def read_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their lengths, and all ids of a file."""
    if raw[:4] != b"S8B1":
        raise ValueError("not a Simple-8b file")
    n_docs = int(np.frombuffer(raw, "<u4", 1, 4)[0])
    n_ids = int(np.frombuffer(raw, "<u8", 1, 8)[0])
    n_blocks, n_escapes = map(int, np.frombuffer(raw, "<u4", 2, 16))
    at = 24
    docs = np.frombuffer(raw, "<i8", n_docs, at)
    sizes = np.frombuffer(raw, "<u4", n_docs, at := at + 8 * n_docs)
    bounds = np.frombuffer(raw, "<u8", n_blocks + 1, at := at + 4 * n_docs).astype(np.int64)
    escapes = np.frombuffer(raw, "<u8", 2 * n_escapes, at := at + 8 * (n_blocks + 1)).reshape(-1, 2)
    words = np.frombuffer(raw, "<u8", int(bounds[-1]), at + 16 * n_escapes)
    ids = unpack(words, n_ids, bounds[:-1])
    ids[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return docs, sizes.astype(np.int64), ids


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: str, pattern: str) -> Encoder:
    """Encoder of this worker: the library encodes each new pre-token once."""
    if vocabulary not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.encode_special_tokens = True

        first = np.array([t.startswith("\u0120") for t, _ in sorted(tokenizer.get_vocab().items(), key=lambda x: x[1])])

        def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = [c.ids for c in found]
            return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

        def many(words: list[bytes]) -> Coded:
            texts = [w.decode("utf-8") for w in words]
            # a blank and letters split off again wherever they stand, and only their
            # first token starts with a blank: these go in long lines
            easy = np.array([t[0] == " " and t[1:].isalpha() for t in texts], bool)
            told = [t for t, e in zip(texts, easy.tolist()) if e]
            ids, _ = coded(["".join(told[low:low + 1000]) for low in range(0, len(told), 1000)])
            more, sizes = coded([t for t, e in zip(texts, easy.tolist()) if not e])
            heads = np.flatnonzero(first[ids]) if len(ids) else np.empty(0, np.int64)
            starts, size = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
            starts[easy], size[easy] = heads, np.diff(np.append(heads, len(ids)))
            starts[~easy], size[~easy] = len(ids) + np.cumsum(sizes) - sizes, sizes
            return np.concatenate([ids, more]), starts, size
        _ENCODERS[vocabulary] = Encoder(pattern, many)
    return _ENCODERS[vocabulary]


def write(docs: DataFrame, vocabulary: str, pattern: str, end: int) -> DataFrame:
    """Encode ``doc_id, text``, append the id ``end`` to each document, and write files in
    ascending order of ids. ``vocabulary``: the tokenizer file's text, broadcast once;
    ``pattern``: what it splits texts by. Returns the table of files."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part = _encoder(sent.value, pattern), 0
        for frame, data in chunks(frames, size=FILE):
            ids = [np.append(x, end) for x in encoder.encode(data)]
            keys = frame["doc_id"].astype("Int64").fillna(_NULL).to_numpy(np.int64)
            yield pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "part": [part],
                                "n_ids": [sum(map(len, ids))], "payload": [write_file(keys, ids)]})
            part += 1
    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
               .withColumn("shard", F.spark_partition_id()))
    return saved(ordered.mapInPandas(work, "shard int, part int, n_ids bigint, payload binary"), "tokens")


def read(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` for each document, from the files."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, part, payload in zip(frame["shard"], frame["part"], frame["payload"]):
                docs, sizes, ids = read_file(payload)
                raw = ids.astype("<u4")
                ends = np.cumsum(sizes)
                yield pd.DataFrame({
                    "shard": shard, "part": part,
                    "doc_id": pd.array(docs, "Int64").copy() if (docs != _NULL).all() else pd.Series(
                        docs, dtype="Int64").mask(docs == _NULL),
                    "inner": ends - sizes, "n_tokens": sizes,
                    "ids_crc32": [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends - sizes, ends)]})
    inner = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a shard, that is, one a task of the writing stage
    outer = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("shard_start"))
    parts = files.select("shard", "part", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("part_start"))
    starts = parts.join(shards, "shard").select(
        "shard", "part", (F.col("part_start") + F.col("shard_start")).alias("file_start"))
    rows = files.mapInPandas(work, "shard int, part int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts, ["shard", "part"]).select(
        "doc_id", (F.col("file_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
