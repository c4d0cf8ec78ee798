"""Incremental indexing: chunk files are embedded and stored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.session import bound_batches, stored
from lectern.sources.collection import merge_points, points
from lectern.sources.files import CHUNK_SCHEMA


def index_stream(
    spark: SparkSession, chunk_folder: str, point_folder: str, checkpoint: str, embed, files_per_batch: int = 100
) -> StreamingQuery:
    """Embed new chunk files and write their points, then stop when none is left.

    Each micro-batch replaces its own ``batch=<id>`` folder, so a batch that is run again
    after a failure leaves no duplicates.
    """
    chunks = (
        spark.readStream.schema(CHUNK_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", "*.json*")
        .option("recursiveFileLookup", "true")
        .json(chunk_folder)
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{point_folder}/batch={batch_id}")

    return (
        points(chunks, embed)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_LEDGER = "batch long, added long, replaced long, late long, removed long, set_aside long"


def applied_batches(spark: SparkSession, ledger: str) -> DataFrame:
    """The batches that :func:`merge_stream` has applied, with their counts."""
    return spark.read.schema(_LEDGER).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(ledger)


def merge_stream(
    spark: SparkSession,
    chunk_folder: str,
    name: str,
    checkpoint: str,
    embed,
    whole_documents: bool = True,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Merge new chunk files into the versioned collection ``name``, then stop.

    A chunk's version is the time of its file; a document's is that of its newest file in the
    batch, so that files of one document written one after the other count as one. The newest
    version of a chunk stays, whenever it arrives; with ``whole_documents`` chunks that the
    newest version of their document no longer has are removed (then all files of a
    document's version belong into one batch). Counts of every batch are kept in
    ``<checkpoint>/applied``; a batch that stands there is not applied again.
    """
    ledger = f"{checkpoint}/applied"
    chunks = (
        spark.readStream.schema(CHUNK_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", "*.json*")
        .option("recursiveFileLookup", "true")
        .json(chunk_folder)
        .withColumn("__time", F.unix_micros("_metadata.file_modification_time"))
    )
    spark.createDataFrame([], _LEDGER).write.mode("append").json(ledger)

    def merge(batch: DataFrame, batch_id: int) -> None:
        if not applied_batches(spark, ledger).filter(F.col("batch") == batch_id).isEmpty():
            return
        bound_batches(spark)
        times = batch.groupBy(F.col("document_id").alias("__d")).agg(
            F.min("__time").alias("__oldest"), F.max("__time").alias("version")
        )
        # Most documents stand in one file, whose time is known on the spot.
        several = stored(times.filter("__oldest < version").select("__d", "version"))
        if several.isEmpty():
            dated = batch.withColumn("version", F.col("__time"))
        else:
            dated = batch.join(several, F.col("document_id").eqNullSafe(F.col("__d")), "left").withColumn(
                "version", F.coalesce("version", "__time")
            )
        counts = merge_points(points(dated, embed, "version"), name, whole_documents)
        row = (batch_id, *[counts[c] for c in ("added", "replaced", "late", "removed", "set_aside")])
        spark.createDataFrame([row], _LEDGER).coalesce(1).write.mode("append").json(ledger)

    return (
        chunks.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(availableNow=True)
        .start()
    )
