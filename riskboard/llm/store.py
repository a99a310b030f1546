"""What the operators share: tables kept in the shared folder, and row batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import work_folder

# Texts worked on at a time inside a task, in bytes: bounds the memory of a worker
# whatever the number of rows in an Arrow batch.
CHUNK = 1_000_000


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table, written below ``spark.checkpoint.dir`` and read back.

    Cuts the lineage in a place every executor can reach: what was computed once is not
    computed again when an executor is lost, nor when two branches of a plan need it.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_in = path
    return out


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python 4 MB at a time instead of 64: a batch lies in the JVM and
    in the worker, beside what the worker makes of it. Narrow rows are not touched by this."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def discard(*tables: DataFrame) -> None:
    """Remove saved tables that nothing asks for any more: all that was made from them has
    been saved itself. Tables that were not saved are left alone."""
    for df in tables:
        if path := getattr(df, "saved_in", None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with their columns under numbers, but for ``doc_id`` and ``text``: no name of
    theirs clashes with a column that an operator adds. ``toDF`` gives the names back."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)])


def utf8(text) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return text if isinstance(text, bytes) else text.encode("utf-8") if isinstance(text, str) else b""


def batches(arrived: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK
            ) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into pieces of about ``size`` bytes of text, with the texts as
    UTF-8. The pieces are views, so columns that only pass through are never copied. A
    single longer text makes a piece of its own; no text is cut. At the end of the task the
    memory that is free again goes back to the system: workers live on, and the next stage's
    own needs come on top of what they keep."""
    for batch in arrived:
        texts = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        low = 0
        while low < len(batch):
            high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:low + 100_000]), size, side="right")))
            own = texts.slice(low, high - low).cast(pa.binary())
            yield batch.slice(low, high - low), [b or b"" for b in own.to_pylist()]
            low = high
    released()


def released() -> None:
    """Hand memory that is free again back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def widened(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with further columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def chunks(frames: Iterator[pd.DataFrame], column: str = "text", size: int = CHUNK
           ) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Cut Arrow batches into pieces of about ``size`` bytes of text, with the texts
    as UTF-8. A single longer text makes a piece of its own; no text is cut."""
    for frame in frames:
        data, start, held = [], 0, 0
        for row, text in enumerate(frame[column]):
            raw = utf8(text)
            if data and held + len(raw) > size:
                yield frame.iloc[start:row], data
                data, start, held = [], row, 0
            data.append(raw)
            held += len(raw)
        if data:
            yield frame.iloc[start:], data


def joined(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the ``len(data) + 1`` bounds of the texts."""
    bounds = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(d) for d in data], out=bounds[1:])
    return np.frombuffer(b"".join(data), np.uint8), bounds


def fold(column: str = "doc_id", parts: int = 5):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts
