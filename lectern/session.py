"""Session helpers: a tuned builder, input spreading, reliable checkpoints."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Options that make sense at any cluster size; partition counts stay with the deployment.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Text stages are bound by CPU, not bytes: let small shuffles keep one task per core.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the scan offers fewer tasks than the cluster has cores.

    A table stored as one row group is read by one task however many cores exist. At
    scale the scan already yields far more splits than cores and this is a no-op, so
    no shuffle of the raw data is added there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables that all machines can see.

    It is the one the session names in ``spark.checkpoint.dir``. Only a local master
    (tests, bench) may fall back to a temporary folder, because on a cluster such a folder
    would not be visible to the other machines.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="lectern-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


BATCH_BYTES = 4 << 20
_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Let Arrow batches of the session hold about ``limit`` bytes, if they may hold more.

    Spark bounds batches by rows (10,000) and by 64 MB; of long texts that is more than a
    worker needs at once, on both sides of the pipe.
    """
    found = re.fullmatch(r"(\d+)\s*([bkmg]?)b?", spark.conf.get(_KEY).lower())
    if not found or int(found[1]) * _UNITS[found[2]] > limit:
        spark.conf.set(_KEY, f"{limit}b")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as compressed columns and read again.

    What was shuffled on the way is given back when it is written, and not when the driver's
    garbage is next collected.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "stored")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def emptied(spark: SparkSession, *paths: str) -> None:
    """Tables that nothing reads any more make way for empty ones."""
    for path in paths:
        spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def release_memory() -> None:
    """Give back what a Python worker has freed; idle workers keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, giving memory back at the end of its task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return task
