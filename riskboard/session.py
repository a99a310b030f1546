"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the work that static hints would only guess at:
# a side is broadcast once its measured shuffle size is small, a hot join key is
# split over several tasks, tiny shuffle partitions are merged.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # checkpoint files go once nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # plans are built without recording the Python line of every column
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def cluster_settings(cores: int) -> dict[str, str]:
    """Settings that follow the size of the cluster. Shuffles start with several
    partitions per core, which run-time coalescing merges where data is small; state
    of streams lives in RocksDB, off the heap."""
    return {
        "spark.sql.shuffle.partitions": str(4 * cores),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }


def build(app: str = "riskboard", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the recommended settings; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _setting(spark: SparkSession, key: str) -> str | None:
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a temporary folder: there the
    driver and the tasks are one machine.
    """
    folder = _setting(spark, "spark.checkpoint.dir")
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="riskboard-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/riskboard/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python 4 MB at a time, whatever their length: a batch lies in
    the worker beside what the worker makes of it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table written below the shared folder, much smaller than a checkpoint, and its path."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def taken(df: DataFrame, folder: str) -> DataFrame:
    """The rows of a table below a work folder, kept in the checkpoint folder (which
    Spark's cleaner empties), after which the work folder is removed."""
    spark = df.sparkSession
    shared_folder(spark)
    rows = df.checkpoint()
    dropped(spark, folder)
    return rows


def dropped(spark: SparkSession, folder: str) -> None:
    """Remove a work folder that nothing asks for any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
