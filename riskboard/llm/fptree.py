"""Ranked lexical search: document FP-trees and branch-and-bound.

Terms are runs of ASCII letters, ASCII figures and all other characters beyond ASCII, only
A-Z lower-cased. A document is kept as its vector over the terms that some item holds
(restricted vector): terms by frequency, rarest first, with their counts. Documents sorted
by these vectors share the paths of a trie: a node is a run of documents with a common
beginning, its children are told apart by their next term. Each node holds, for its
children, the largest count of every term below them and the smallest length figure m.

For each item the tree is searched depth first, best child first. The bound of a child is
the item's score at the child's largest counts and smallest m, so no document below it can
score more; children whose bound is under the item's 20th best so far are passed by. Since
paths begin with the rarest term, a child that lacks an item's rare terms shows it at once.
Runs of few documents are scored directly.

Texts are read once; trees are built per task from the vectors, ``TREE`` counts at a time,
and a task's best so far bound its later trees. Only the best of each task and item are
shuffled. Items are held by every task in blocks of ``ITEM_BYTES`` of text, each block one
more pass over the documents.

Defined cases: null and blank texts have no terms and are never found; items without terms
return nothing; several rows of one item id are one item, equal texts counted once; items
without id are left out; documents that repeat an id are ranked row by row; documents without
id rank behind equal scores; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .store import batches, saved, utf8

BEST = 20
# term counts of one tree, documents scored without a further node
TREE, RUN = 2_000_000, 24
# text of the items a task holds at a time
ITEM_BYTES = 32_000_000
# a longer text is taken apart in pieces of this many bytes
PIECE = 4_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
NO_ID = (1 << 63) - 1


def terms(text) -> Iterator[list[bytes]]:
    """All terms of a whole text, in pieces cut between terms."""
    raw, low = utf8(text), 0
    while len(raw) - low > PIECE:
        piece = raw[low:low + PIECE].translate(_LOWER)
        gaps = _GAP.search(piece[::-1])
        # a term longer than a piece: up to its end
        high = low + PIECE - gaps.start() if gaps else low + PIECE + (
            (end := _GAP.search(raw[low + PIECE:].translate(_LOWER))) and end.start() or len(raw))
        yield _TERM.findall(raw[low:high].translate(_LOWER))
        low = high
    yield _TERM.findall(raw[low:].translate(_LOWER))


def counted(text) -> Counter:
    found: Counter = Counter()
    for piece in terms(text):
        found.update(piece)
    return found


def weight(n_docs: int, df: int) -> int:
    return int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))))


def length_figure(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents of ``n`` terms."""
    return 75 + (25 * n * n_docs) // total


def part_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds, before its weight: rises with ``tf``, falls with ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Node:
    """A run of documents ``low .. high`` that share a beginning, and its children."""
    starts: np.ndarray                  # first document of each child
    stops: np.ndarray
    m: np.ndarray                       # smallest m below each child
    first: np.ndarray                   # smallest id below each child
    terms: np.ndarray                   # terms held below any child, sorted
    bounds: np.ndarray                  # where each term's children begin in the next two
    child: np.ndarray
    tf: np.ndarray                      # largest count of the term below that child
    depth: int                          # terms its vectors have in common
    nodes: dict[int, "Node"] = field(default_factory=dict)


class Tree:
    """Restricted vectors in trie order. ``rows`` are (term, tf) pairs of all documents one
    after the other, terms rising within a document, ``sizes`` their number for each."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, term: np.ndarray, tf: np.ndarray, sizes: np.ndarray):
        bounds = np.append(0, np.cumsum(sizes))
        big = term.astype(">i4").tobytes()
        # the bytes of rising numbers sort as the numbers do
        order = sorted(range(len(sizes)), key=lambda i: (big[4 * bounds[i]:4 * bounds[i + 1]], ids[i]))
        order = np.array(order, np.int64)
        self.ids, self.m, self.sizes = ids[order], m[order], sizes[order]
        self.bounds = np.append(0, np.cumsum(self.sizes))
        at = np.repeat(bounds[:-1][order] - self.bounds[:-1], self.sizes) + np.arange(len(term))
        self.term, self.tf = term[at], tf[at]
        self.root = self._node(0, len(sizes), 0)

    def _row(self, doc: int) -> np.ndarray:
        return self.term[self.bounds[doc]:self.bounds[doc + 1]]

    def _node(self, low: int, high: int, depth: int) -> Node:
        """Node of a run whose vectors agree in their first ``depth`` terms."""
        one, last = self._row(low), self._row(high - 1)
        both = min(len(one), len(last))
        differ = np.flatnonzero(one[depth:both] != last[depth:both])
        depth = depth + int(differ[0]) if len(differ) else both
        # documents that end here are children of their own, before all others
        own = np.flatnonzero(self.sizes[low:high] > depth) + low
        nxt = np.full(high - low, -1, np.int64)
        nxt[own - low] = self.term[self.bounds[own] + depth]
        starts = np.flatnonzero(np.append(True, nxt[1:] != nxt[:-1]))
        if len(starts) == 1:  # all alike: cut the run in halves of the same path
            starts = np.arange(0, high - low, max(RUN, (high - low + 15) // 16))
        stops = np.append(starts[1:], high - low)
        begin, end = self.bounds[low], self.bounds[high]
        child = np.repeat(np.arange(len(starts)), self.bounds[low + stops] - self.bounds[low + starts])
        term, tf = self.term[begin:end], self.tf[begin:end]
        order = np.lexsort((child, term))
        term, child, tf = term[order], child[order], tf[order]
        edge = np.append(True, (term[1:] != term[:-1]) | (child[1:] != child[:-1]))[:len(term)]
        at = np.flatnonzero(edge)
        most = np.maximum.reduceat(tf, at) if len(at) else tf
        term, child = term[at], child[at]
        names, where = np.unique(term, return_index=True)
        return Node(low + starts, low + stops, np.minimum.reduceat(self.m[low:high], starts),
                    np.minimum.reduceat(self.ids[low:high], starts), names, np.append(where, len(term)), child, most, depth)

    def bound(self, node: Node, term: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Largest score that a document below each child can have."""
        total = np.zeros(len(node.starts), np.int64)
        at = np.searchsorted(node.terms, term)
        known = np.flatnonzero(at < len(node.terms))
        known = known[node.terms[at[known]] == term[known]]
        if len(known):
            low, high = node.bounds[at[known]], node.bounds[at[known] + 1]
            size = high - low
            place = np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            child = node.child[place]
            np.add.at(total, child, np.repeat(weights[known], size) * part_score(node.tf[place], node.m[child]))
        return total

    def scores(self, low: int, high: int, dense: np.ndarray) -> np.ndarray:
        """Scores of a run of documents; ``dense`` holds the item's weight of each term."""
        begin, end = self.bounds[low], self.bounds[high]
        part = dense[self.term[begin:end]]
        hit = np.flatnonzero(part)
        doc = np.searchsorted(self.bounds[low:high + 1], begin + hit, side="right") - 1
        total = np.zeros(high - low, np.int64)
        np.add.at(total, doc, part[hit] * part_score(self.tf[begin + hit], self.m[low + doc]))
        return total

    def search(self, term: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: list, k: int) -> None:
        """Add the tree's documents to ``best``, a heap of (score, -id) with the worst of
        the ``k`` best first."""
        stack = [(self.root, None)]
        while stack:
            node, child = stack.pop()
            if child is not None:
                ceiling, place = child
                if len(best) == k and (ceiling, -int(node.first[place])) <= best[0]:
                    continue
                low, high = int(node.starts[place]), int(node.stops[place])
                if high - low <= RUN:
                    own = self.scores(low, high, dense)
                    for i in np.flatnonzero(own).tolist():
                        entry = (int(own[i]), -int(self.ids[low + i]))
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                    continue
                if place not in node.nodes:
                    node.nodes[place] = self._node(low, high, node.depth)
                node = node.nodes[place]
            ceilings = self.bound(node, term, weights)
            worth = np.flatnonzero(ceilings >= (best[0][0] if len(best) == k else 1))
            for place in worth[np.argsort(ceilings[worth], kind="stable")].tolist():
                stack.append((node, (int(ceilings[place]), place)))


def item_blocks(items: DataFrame, limit: int = ITEM_BYTES) -> Iterator[list[tuple]]:
    """Items ``(item_id, [texts])`` that take part, in blocks of about ``limit`` bytes."""
    rows = (items.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
            .groupBy("item_id").agg(F.sort_array(F.collect_list("text")).alias("texts")).orderBy("item_id"))
    block, held = [], 0
    for row in rows.toLocalIterator():
        block.append((row["item_id"], row["texts"]))
        held += sum(len(t) for t in row["texts"])
        if held > limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def vectors(docs: DataFrame, names: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, term, tf`` for each document with a term: number of all its terms, and
    the counts of those in ``names``."""
    told = docs.sparkSession.sparkContext.broadcast(names)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = told.value
        for batch, data in batches(arrived):
            n, term, tf = [], [], []
            for raw in data:
                found = counted(raw)
                n.append(found.total())
                own = sorted((known[t], c) for t, c in found.items() if t in known)
                term.append([t for t, _ in own])
                tf.append([c for _, c in own])
            keep = pa.array([x > 0 for x in n])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())),
                 pa.array(tf, pa.list_(pa.int32()))], names=["doc_id", "n", "term", "tf"]).filter(keep)
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, n bigint, term array<int>, tf array<int>")


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the ``size`` terms; tasks count for themselves, so a
    term that all documents hold is one row a task."""
    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in arrived:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "df"])
    df = np.zeros(size, np.int64)
    for row in rows.select("term").mapInArrow(work, "term int, df bigint").groupBy("term").agg(
            F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]
    return df


def _block(docs: DataFrame, block: list[tuple], k: int) -> DataFrame:
    """Best documents of each task for the items of a block: ``item, doc_id, score``."""
    items = [Counter() for _ in block]
    for own, (_, texts) in zip(items, block):
        for text in texts:
            own.update(counted(text))
    names = {t: i for i, t in enumerate(sorted(set().union(*items)))}
    rows = saved(vectors(docs, names), "vectors")
    told = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, total = told[0], told[1] or 1
    df = frequencies(rows, len(names))
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(names))
    weights = np.array([weight(n_docs, d) for d in df.tolist()], np.int64)
    asked = []
    for own in items:
        held = [(int(rank[names[t]]), c * int(weights[names[t]])) for t, c in own.items() if df[names[t]]]
        held.sort()
        asked.append((np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)))
    sent = docs.sparkSession.sparkContext.broadcast((rank, asked))

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, asked = sent.value
        best: list[list] = [[] for _ in asked]
        held: list[pa.RecordBatch] = []
        size = 0

        def searched() -> None:
            table = pa.Table.from_batches(held)
            term, tf = table["term"].combine_chunks(), table["tf"].combine_chunks()
            sizes = np.asarray(pc.list_value_length(term)).astype(np.int64)
            term = rank[term.flatten().to_numpy()]
            order = np.lexsort((term, np.repeat(np.arange(len(sizes)), sizes)))
            ids = table["doc_id"].fill_null(NO_ID).to_numpy()
            tree = Tree(ids, length_figure(table["n"].to_numpy(), n_docs, total), term[order],
                        tf.flatten().to_numpy().astype(np.int64)[order], sizes)
            dense = np.zeros(len(rank), np.int64)
            for (own, weights), heap in zip(asked, best):
                if len(own):
                    dense[own] = weights
                    tree.search(own, weights, dense, heap, k)
                    dense[own] = 0
        for batch in arrived:
            # a tree never grows beyond TREE counts and one document
            sizes = np.asarray(pc.list_value_length(batch.column("term"))).astype(np.int64)
            low = 0
            while low < len(batch):
                room = int(np.searchsorted(np.cumsum(sizes[low:]), TREE - size, side="right"))
                high = min(len(batch), low + max(room, 0 if held else 1))
                if high > low:
                    held.append(batch.slice(low, high - low))
                    size += int(sizes[low:high].sum())
                if high < len(batch):
                    searched()
                    held, size = [], 0
                low = high
        if held:
            searched()
        rows = [(i, s, -d) for i, heap in enumerate(best) for s, d in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([None if r[2] == NO_ID else r[2] for r in rows], pa.int64()),
             pa.array([r[1] for r in rows], pa.int64())], names=["item", "doc_id", "score"])
    return rows.mapInArrow(work, "item int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, limit: int = ITEM_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents (``doc_id, text``) with the
    highest score above 0 for each item (``item_id, text``), equal scores by id."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = None
    for block in item_blocks(items, limit):
        own = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {kind}")
        part = _block(docs, block, k).join(own, "item").select("item_id", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


SQL = r"""
with own as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null),
held as (select * from own where len(terms) > 0),
whole as (select count(*)::bigint as n_docs, sum(len(terms))::bigint as total from held),
each as (select row, unnest(terms) as term from held),
counts as (select row, term, count(*)::bigint as tf from each group by all),
asked as (
  select item_id, term, count(*)::bigint as times from (
    select item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select distinct item_id, text from benchmark where item_id is not null and text is not null))
  group by all),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from counts, whole where term in (select term from asked) group by term, n_docs),
scored as (
  select a.item_id, h.row, h.doc_id,
         sum(a.times * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (75 + (25 * len(h.terms) * n_docs) // total))))::bigint as score
  from asked a join weights w on w.term = a.term join counts c on c.term = a.term join held h on h.row = c.row, whole
  group by a.item_id, h.row, h.doc_id),
placed as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last, row)::integer as rank, doc_id, score
  from scored where score > 0)
select item_id, rank, doc_id, score from placed where rank <= 20
"""
