"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words with one blank between. An item may
differ from a passage by ``ERRORS`` of its length in edits. It is split into one piece
more than its budget; wherever a passage is within the budget, at least one piece stands
in it unchanged. One automaton finds all pieces of all items; around each hit Myers'
bit-parallel search gives the smallest edit distance of the item to a passage there.

Items are the query set: they go to the tasks in blocks of about ``BLOCK``, whatever
their number, and every document meets every block.

Defined cases: null or wordless texts hold nothing; null or wordless items match nothing;
items of fewer than ``WORDS`` words are found without edits, as whole words, and
``without_leaks`` drops for them only documents made of just these words;
repeated items count once and items that share an id
count by the nearest; repeated documents count each for itself; an empty table gives an
empty result; other columns are carried along or not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import batches

# share of an item's characters that may be edited
ERRORS = 0.08
WORDS = 5
# items in one broadcast: a few MB
BLOCK = 10_000
_GAP = re.compile(r"[\W_]+")


def plain(text) -> str:
    """Lower-case words, each with a blank before and after; empty without words."""
    words = _GAP.sub(" ", text.lower()).strip() if isinstance(text, str) else ""
    return f" {words} " if words else ""


def budget(item: str, errors: float = ERRORS) -> int:
    return int(errors * len(item))


def pieces(item: str, parts: int) -> list[tuple[int, str]]:
    """The item in ``parts`` pieces of nearly equal length, with their places."""
    cuts = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def distance(item: str, masks: dict[str, int], text: str) -> int:
    """Smallest edit distance of the item to any part of the text (Myers, one big
    number for a column). ``masks``: the places of each character in the item."""
    size = len(item)
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best = size
    get = masks.get
    for char in text:
        eq = get(char, 0)
        diagonal = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        plus = plus << 1 & full
        up = (minus << 1 & full) | (full & ~(diagonal | plus))
        down = plus & diagonal
    return best


class Matcher:
    """Items ready to be looked up in texts."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS):
        self.items = []
        hits = defaultdict(list)
        for name, text in items:
            item = plain(text)
            if not item:
                continue
            short = item.count(" ") - 1 < WORDS
            k = 0 if short else budget(item, errors)
            masks = defaultdict(int)
            for at, char in enumerate(item):
                masks[char] |= 1 << at
            for at, piece in pieces(item, k + 1):
                hits[piece].append((len(self.items), at))
            self.items.append((name, item, k, dict(masks), short))
        self.find = ahocorasick.Automaton()
        for piece, places in hits.items():
            self.find.add_word(piece, (len(piece), places))
        if hits:
            self.find.make_automaton()

    def leaks(self, text, short: bool = True) -> list[tuple[int, int]]:
        """``item, edits`` for each item that a text holds within its budget; without
        ``short`` items of a few words only if they are the whole text."""
        line = plain(text)
        if not line or not self.items:
            return []
        out: dict[int, int] = {}
        lanes = defaultdict(set)  # where an item would have to start
        for end, (size, places) in self.find.iter(line):
            for item, at in places:
                lanes[item].add(end - size + 1 - at)
        for item, starts in lanes.items():
            name, want, k, masks, few = self.items[item]
            if few and not short and line != want:
                continue
            if not k:  # the one piece is the item
                out[name] = 0
                continue
            best, low, high = k + 1, None, None
            for start in [*sorted(starts), None]:
                if low is not None and (start is None or start - high > len(want)):
                    best = min(best, distance(want, masks, line[max(0, low - k):high + len(want) + k]))
                    low = None
                if low is None:
                    low = start
                high = start
            if best <= k:
                out[name] = min(best, out.get(name, best))
        return sorted(out.items())


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """The items, block by block; texts of one item id share a block."""
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    parts = max(1, -(-items.count() // block))
    dealt = items.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    for k in range(parts):
        yield [(r["item_id"], r["text"]) for r in dealt.filter(F.col("_block") == k).collect()]


def found(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, edits`` for each document and each item it holds."""
    parts = []
    names = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
              f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, edits int")
    for items in _blocks(benchmark, block):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def work(arrived: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, errors)
            for batch, data in batches(arrived):
                hits = [(k, *hit) for k, d in enumerate(data) for hit in matcher.leaks(d.decode("utf-8"))]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())),
                    pa.array([h[1] for h in hits], names), pa.array([h[2] for h in hits], pa.int32())],
                    names=["doc_id", "item_id", "edits"])
        parts.append(docs.select("doc_id", "text").mapInArrow(work, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block: int = BLOCK
                  ) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    schema = docs.schema
    for items in _blocks(benchmark, block):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def work(arrived: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, errors)
            for batch, data in batches(arrived):
                yield batch.filter(pa.array([not matcher.leaks(d.decode("utf-8"), short=False) for d in data], pa.bool_()))
        docs = docs.mapInArrow(work, schema)
    return docs
