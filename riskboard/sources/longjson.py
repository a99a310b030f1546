"""One long JSON document read by many tasks.

A document is an object whose values are objects or arrays of objects; it may stand on one
line and be larger than a task should hold. Spark's text reader cuts it into splits, with
``}`` for the end of a line. What a split begins with (inside a string or not, and the open
brackets) hangs on all that stands before it: so each split is first scanned for both cases,
which gives one short row a split, and the rows of a document, taken in order, tell how each
of its splits begins. A second scan hands out the elements. Only elements that a border cuts
are put together from their pieces, of which there are two a border.

Documents of one split need the second scan only. The names of a document's own values must
hold no ``}``; values that are no objects, and elements of arrays that are none, are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import small_batches

_PLAIN = re.compile(r'["{}\[\],:]')
_INSIDE = re.compile(r'["\\]')
# characters of elements that a task holds before it gives them out
GIVEN = 1_000_000


class Reader:
    """Follows strings and brackets. ``stack`` holds the open brackets with the name of the
    value each opens; ``closes`` counts closing ones that nothing here has opened."""

    def __init__(self, text: bool = False, stack: list | tuple = ()):
        self.text, self.stack, self.closes = text, [tuple(s) for s in stack], 0
        self.begin: int | None = None
        self.word: str | None = None
        self.name: str | None = None

    def signs(self, piece: str) -> Iterator[tuple[str, int]]:
        """Brackets of a piece with their places; the stack is as before each of them."""
        at = 0
        while found := (_INSIDE if self.text else _PLAIN).search(piece, at):
            sign, at = found.group(), found.end()
            if self.text:
                if sign == "\\":
                    at += 1
                else:
                    self.text, self.word = False, None if self.begin is None else piece[self.begin:at - 1]
            elif sign == '"':
                self.text, self.begin = True, at
            elif sign == ":":
                self.name = self.word
            elif sign == ",":
                self.name = None
            else:
                yield sign, at - 1
                if sign in "{[":
                    self.stack.append((sign, self.name))
                    self.name = None
                elif self.stack:
                    self.stack.pop()
                else:
                    self.closes += 1
        self.begin = None

    def opens_element(self, sign: str) -> bool:
        """Whether a bracket opens an object that is a value of the document, or one in an
        array that is."""
        depth = len(self.stack)
        return sign == "{" and (depth == 1 or (depth == 2 and self.stack[1][0] == "["))

    def closes_element(self, sign: str) -> bool:
        depth = len(self.stack)
        return sign == "}" and ((depth == 2 and self.stack[1][0] == "{") or (depth == 3 and self.stack[1][0] == "["))

    def inside(self) -> bool:
        depth = len(self.stack)
        return depth > 1 and self.stack[1][0] == "{" or depth > 2


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Texts up to each ``}``, in order within their split."""
    return (spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value"))


def _splits(arrived: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """Pieces with the split they belong to and their closing bracket back. The blanks after
    a document's last bracket get one too, which closes nothing."""
    for batch in arrived:
        for path, start, value in zip(*(batch.column(k) for k in ("path", "start", "value"))):
            yield (path.as_py(), start.as_py()), value.as_py() + "}"


def _outline(pieces: DataFrame) -> DataFrame:
    """``path, start, out, inner`` for each split: what it does to a reader that begins
    outside a string, and to one inside: ``[inside at the end, closes, stack]`` as JSON."""
    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, readers = None, []

        def told() -> pa.RecordBatch:
            said = [json.dumps([r.text, r.closes, r.stack]) for r in readers]
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array(said[:1]), pa.array(said[1:])],
                                              names=["path", "start", "out", "inner"])
        for split, piece in _splits(arrived):
            if split != now:
                if now:
                    yield told()
                now, readers = split, [Reader(False), Reader(True)]
            for reader in readers:
                for _ in reader.signs(piece):
                    pass
        if now:
            yield told()
    return pieces.mapInArrow(work, "path string, start bigint, out string, inner string")


def _beginnings(outline: DataFrame) -> dict[tuple[str, int], tuple[bool, list]]:
    """How the splits of documents of several splits begin: one short row a split."""
    many = outline.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path")
    begins: dict[tuple[str, int], tuple[bool, list]] = {}
    last, text, stack = None, False, []
    for row in outline.join(many, "path").orderBy("path", "start").toLocalIterator():
        if row["path"] != last:
            last, text, stack = row["path"], False, []
        begins[row["path"], row["start"]] = text, list(stack)
        text, closes, opened = json.loads(row["inner"] if text else row["out"])
        stack = stack[:len(stack) - closes] + [tuple(s) for s in opened]
    return begins


def elements(spark: SparkSession, path: str) -> DataFrame:
    """``path, start, seq, name, value``: the objects of each document below a path, with
    the name of the value they are or stand in; ``start`` and ``seq`` tell their order."""
    small_batches(spark)
    pieces = _pieces(spark, path)
    begins = spark.sparkContext.broadcast(_beginnings(_outline(pieces)))

    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, held = None, Reader(), []
        rows: list[tuple] = []
        seq = size = 0
        begun = True

        def give(ends: bool) -> None:
            nonlocal seq, size, held
            value = "".join(held)
            rows.append((*now, seq, reader.stack[1][1], begun, ends, value))
            seq, size, held = seq + 1, size + len(value), []

        def told() -> pa.RecordBatch:
            nonlocal rows, size
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)]
            rows, size = [], 0
            return pa.RecordBatch.from_arrays(columns, names=["path", "start", "seq", "name", "begins", "ends", "value"])
        for split, piece in _splits(arrived):
            if split != now:
                if now and reader.inside():
                    give(False)
                now, seq, held = split, 0, []
                reader = Reader(*begins.value.get(split, (False, [])))
                begun = not reader.inside()
            at, was = 0, reader.inside()
            for sign, place in reader.signs(piece):
                if reader.opens_element(sign):
                    at, was, begun = place, True, True
                elif reader.closes_element(sign):
                    held.append(piece[at:place + 1])
                    give(True)
                    was, begun = False, True
            if was:
                held.append(piece[at:])
            if size > GIVEN:  # between two pieces, never a whole batch of them
                yield told()
        if now and reader.inside():
            give(False)
        yield told()
    found = pieces.mapInArrow(work, "path string, start bigint, seq bigint, name string, begins boolean, ends boolean, value string")
    whole = found.filter("begins and ends")
    line = Window.partitionBy("path").orderBy("start", "seq")
    cut = found.filter("not (begins and ends)").withColumn("_n", F.sum(F.col("begins").cast("int")).over(line))
    joined = (cut.groupBy("path", "_n").agg(F.min(F.struct("start", "seq", "name")).alias("_at"), F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "value"))), lambda p: p["value"]), "").alias("value"))
        .select("path", "_at.start", "_at.seq", "_at.name", "value"))
    return whole.select(*joined.columns).unionByName(joined)
