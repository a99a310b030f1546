"""Publishing a run: tables and JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import small_batches


def publish_tables(tables: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """Write each table below ``folder``, one partition per run; republishing a run
    replaces that run only."""
    for name, df in tables.items():
        (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
         .parquet(f"{folder}/{name}"))


def publish_json(payload: DataFrame, folder: str, run_id: str, body: str = "payload") -> None:
    """Write JSON lines ``{"key": .., "payload": ..}``; the payload column holds JSON."""
    keys = [c for c in payload.columns if c != body]
    head = F.to_json(F.struct(*keys))
    line = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"payload":'), F.col(body), F.lit("}"))
    payload.select(line.alias("value")).write.mode("overwrite").text(f"{folder}/run_id={run_id}")


def write_documents(objects: DataFrame, folder: str, run_id: str, name: str = "companies") -> None:
    """Write JSON objects (``value``) as run documents ``{"meta": {..}, name: [..]}``, one
    document for each task."""
    small_batches(objects.sparkSession)
    head = json.dumps({"meta": {"run_id": run_id}})[:-1] + f', "{name}": ['

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        yield pd.DataFrame({"value": [head]})
        for frame in frames:
            if len(frame):
                told = "," + frame["value"]
                if first:
                    told.iloc[0] = told.iloc[0][1:]
                first = False
                yield pd.DataFrame({"value": told})
        yield pd.DataFrame({"value": ["]}"]})
    objects.select("value").mapInPandas(lines, "value string").write.text(folder)


def read_published(spark, folder: str, name: str, run_id: str | None = None) -> DataFrame:
    """A published table; naming the run prunes the other partitions."""
    df = spark.read.parquet(f"{folder}/{name}")
    return df.filter(F.col("run_id") == run_id) if run_id else df
