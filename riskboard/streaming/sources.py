"""Stream sources: task events, review events, posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import EVENTS, POSTS
from ..sources.tables import shape_review_events, shape_task_events


def files(spark: SparkSession, folder: str, pattern: str, schema, per_trigger: int | None = None
          ) -> DataFrame:
    """Parquet files of a folder as a stream. A name that fits ``pattern`` may be a file or
    a folder of part files, as Spark writes a table."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{folder.rstrip('/')}/{pattern}")


def task_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet", **kw) -> DataFrame:
    return shape_task_events(files(spark, folder, pattern, EVENTS, **kw))


def review_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet", **kw) -> DataFrame:
    return shape_review_events(files(spark, folder, pattern, EVENTS, **kw))


def posts(spark: SparkSession, folder: str, pattern: str = "conversations*.parquet", **kw) -> DataFrame:
    return files(spark, folder, pattern, POSTS, **kw)


def once(stream: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """Count a re-delivered event once, for re-deliveries no later than ``within``.

    Events later than that are dropped, so ``within`` must cover the feed's lateness.
    """
    timed = stream.withColumn("_event_time", F.col(time).cast("timestamp"))
    return (timed.withWatermark("_event_time", within).dropDuplicatesWithinWatermark([key])
            .drop("_event_time"))
