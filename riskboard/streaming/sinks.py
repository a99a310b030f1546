"""Delta-folder sink: each micro-batch writes its changed rows to its own partition.

A replayed micro-batch overwrites its own partition, so a lost executor or a restart
leaves every change in the folder exactly once. Readers take the newest row per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scale import latest_by


def _write(df: DataFrame, folder: str, batch_id: int) -> None:
    # few, evenly filled files: Spark sizes the parts from what the batch really holds
    df.hint("rebalance").write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def start(stream: DataFrame, folder: str, mode: str = "append", seconds: int | None = None,
          split: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> StreamingQuery:
    """Start writing a stream below ``folder``; ``split`` names several outputs of one
    stream. Without ``seconds`` the query takes what is there and ends. Every output gets
    an empty base first, so that an empty feed gives empty tables."""
    outputs = split or {"data": lambda df: df}
    spark = stream.sparkSession
    for name, shape in outputs.items():
        _write(shape(spark.createDataFrame([], stream.schema)), f"{folder}/{name}", -1)

    def each(batch: DataFrame, batch_id: int) -> None:
        if len(outputs) > 1:
            batch = batch.persist()
        for name, shape in outputs.items():
            _write(shape(batch), f"{folder}/{name}", batch_id)
        if len(outputs) > 1:
            batch.unpersist()

    writer = (stream.writeStream.outputMode(mode).foreachBatch(each)
              .option("checkpointLocation", f"{folder}/checkpoint"))
    if seconds:
        return writer.trigger(processingTime=f"{seconds} seconds").start()
    return writer.trigger(availableNow=True).start()


def drain(stream: DataFrame, folder: str, **kw) -> str:
    """Run a stream over everything there is and wait for its end."""
    query = start(stream, folder, **kw)
    query.awaitTermination()
    return folder


def rows(spark: SparkSession, folder: str, name: str = "data") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def _deltas(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of the newest base and of the micro-batches after it."""
    deltas = rows(spark, folder, name)
    base_path = f"{folder}/{name}-base"
    if not _exists(spark, base_path):
        return deltas
    base = spark.read.parquet(base_path)
    upto = base.agg(F.max("upto").alias("m")).first()["m"]
    newest = base.filter(F.col("upto") == upto).withColumnRenamed("upto", "batch_id")
    return deltas.filter(F.col("batch_id") > upto).unionByName(newest.select(deltas.columns))


def current(spark: SparkSession, folder: str, keys: list[str], order: list[str] | None = None,
            name: str = "data", every: bool = False) -> DataFrame:
    """The newest row per key over all micro-batches; ``order`` decides before the
    batch number does. ``every``: all rows that the last micro-batch with the key told."""
    deltas = _deltas(spark, folder, name)
    return _told_last(deltas, keys).drop("batch_id") if every else _newest(deltas, keys, order)


def _told_last(df: DataFrame, keys: list[str]) -> DataFrame:
    last = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("batch_id").alias("_last"))
    same = F.col("batch_id") == F.col("_last")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(last, same, "left_semi")


def _newest(df: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    order = (order or []) + ["batch_id"]
    rest = [c for c in df.columns if c not in keys and c != "batch_id"]
    return latest_by(df, keys, order, rest)


def committed(spark: SparkSession, folder: str) -> int | None:
    """Last micro-batch in the query's commit log: all its outputs are complete."""
    log = f"{folder}/checkpoint/commits"
    if not _listed(spark, log):
        return None
    names = (spark.read.format("binaryFile").load(log).select(
        F.element_at(F.split("path", "/"), -1).try_cast("bigint").alias("id")))
    return names.agg(F.max("id").alias("m")).first()["m"]


def _listed(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException:
        return False


def compact(spark: SparkSession, folder: str, keys: list[str], order: list[str] | None = None,
            name: str = "data", every: bool = False) -> None:
    """Fold the committed micro-batches into one base, so that readers of a long-running
    stream open few files. A micro-batch that is still being written is left for the next
    time. The micro-batches stay until their retention ends. ``every`` as in ``current``."""
    upto = committed(spark, folder)
    if upto is None:
        return
    done = _deltas(spark, folder, name).filter(F.col("batch_id") <= upto)
    folded = _told_last(done, keys).drop("batch_id") if every else _newest(done, keys, order)
    folded.write.mode("overwrite").parquet(f"{folder}/{name}-base/upto={upto}")
