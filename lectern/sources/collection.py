"""Vector collections kept as Spark tables.

A table is partitioned by a hash of the point id into a fixed number of slots, so replacing
points rewrites only the slots that they fall into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.vectors import norm
from lectern.session import reliable_checkpoint, stored

SLOTS = 64

PAYLOAD = (
    "chunk_id",
    "text",
    "document_id",
    "page_start",
    "page_end",
    "token_count",
    "section_path",
)
_COLUMNS = (
    "id string, vector array<float>, payload struct<id:string,text:string,document_id:string,"
    "page_start:int,page_end:int,token_count:int,section_path:array<string>>"
)


def collection_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def ensure_collection(
    spark: SparkSession,
    name: str,
    dim: int = fixed.VECTOR_SIZE,
    distance: str = "cosine",
    versioned: bool = False,
    location: str | None = None,
) -> bool:
    """Create the collection unless it exists; tells whether it was created.

    A ``versioned`` collection keeps the version of every point, for :func:`merge_points`.
    ``location`` is a folder for its files; without it the catalog chooses one.
    """
    if collection_exists(spark, name):
        return False
    columns = f"{_COLUMNS}, version long" if versioned else _COLUMNS
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, slot int) USING parquet PARTITIONED BY (slot) "
        + (f"LOCATION '{location}' " if location else "")
        + f"TBLPROPERTIES ('dim' = '{dim}', 'distance' = '{distance}')"
    )
    return True


def drop_collection(spark: SparkSession, name: str) -> bool:
    """Drop the collection; tells whether there was one."""
    existed = collection_exists(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return existed


def collection_properties(spark: SparkSession, name: str) -> dict[str, str]:
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").collect()
    return {row["key"]: row["value"] for row in rows}


def open_collection(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop("slot")


def _with_slot(rows: DataFrame) -> DataFrame:
    """Rows with their slot, which stands last as table partitions do."""
    return rows.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int"))


def _slotted(rows: DataFrame) -> DataFrame:
    return _with_slot(rows.select("id", "vector", "payload"))


def points(chunks: DataFrame, embed, *others: str) -> DataFrame:
    """Chunk rows as points: an id derived from the chunk id, a vector, the payload, ``others``."""
    payload = [F.col(c).alias("id" if c == "chunk_id" else c) for c in PAYLOAD]
    return chunks.select(
        F.md5("chunk_id").alias("id"),
        embed(F.col("text")).alias("vector"),
        F.struct(*payload).alias("payload"),
        *others,
    )


def append_points(batch: DataFrame, name: str) -> int:
    """Add points without looking for earlier ones (indexing twice stores them twice).

    Returns how many were written, counted while they were.
    """
    written = Observation()
    _slotted(batch).observe(written, F.count("*").alias("n")).write.mode("append").insertInto(name)
    return written.get["n"]


def merged(existing: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """``existing`` with the rows of ``batch`` put in place of those with the same key.

    ``batch`` must hold each key once. Only the key of the batch takes part in the join.
    """
    kept = existing.join(batch.select(key), key, "left_anti")
    return kept.unionByName(batch.select(*existing.columns))


def last_of_each(batch: DataFrame, order: str | None = None) -> DataFrame:
    """One row of every id: the one with the largest ``order``, then the largest payload text."""
    by = [F.to_json("payload"), F.to_json("vector")]
    if order is not None:
        by.insert(0, F.col(order))
    newest = F.max_by(F.struct("vector", "payload"), F.struct(*by))
    return batch.groupBy("id").agg(newest.alias("__p")).select("id", "__p.vector", "__p.payload")


def _overwrite(rows: DataFrame, name: str, touched: list[int]) -> None:
    """Put the rows in place of what the touched slots hold."""
    spark = rows.sparkSession
    key = "spark.sql.sources.partitionOverwriteMode"
    mode = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        rows.write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(key, mode)
    # A dynamic overwrite leaves a slot alone of which no row is left.
    left = {r["slot"] for r in rows.select("slot").distinct().collect()}  # at most SLOTS
    for slot in set(touched) - left:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (slot = {slot}) PURGE")


def upsert_points(batch: DataFrame, name: str, order: str | None = None) -> dict[str, int]:
    """Replace points of the same id and add the others; returns how many of each.

    Only slots that the batch touches are read and written; their new content is stored
    first, then put in place of the old by a dynamic partition overwrite, so the table is
    there all the time and other slots keep their files. Of several rows with one id the
    last by ``order`` counts; ``repeated`` tells of the others. ``replaced`` counts stored rows
    that made way, of which an id may have several. Counts are taken while the batch and the
    slots are written.
    """
    spark = batch.sparkSession
    seen, kept = Observation(), Observation()
    new = reliable_checkpoint(last_of_each(batch.observe(seen, F.count("*").alias("n")), order))
    touched = [r["slot"] for r in _slotted(new).select("slot").distinct().collect()]  # at most SLOTS
    if not touched:
        return {"added": 0, "replaced": 0, "repeated": 0}
    old = spark.table(name).filter(F.col("slot").isin(touched)).drop("slot")
    fresh = new.select(*old.columns).withColumn("__new", F.lit(True))
    both = old.withColumn("__new", F.lit(False)).unionByName(fresh)
    by_id = Window.partitionBy("id")
    judged = both.withColumn("__asked", F.bool_or("__new").over(by_id)).withColumn(
        "__stored", F.bool_or(~F.col("__new")).over(by_id)
    )
    own = F.col("__new")
    counted = judged.observe(
        kept,
        F.count_if(own & ~F.col("__stored")).alias("added"),
        F.count_if(~own & F.col("__asked")).alias("replaced"),
        F.count_if(own).alias("written"),
    )
    rows = reliable_checkpoint(_slotted(counted.filter(own | ~F.col("__asked"))))
    _overwrite(rows, name, touched)
    found = kept.get
    return {"added": found["added"], "replaced": found["replaced"], "repeated": seen.get["n"] - found["written"]}


def merge_points(batch: DataFrame, name: str, whole_documents: bool = False) -> dict[str, int]:
    """Merge ``id, vector, payload, version`` into a versioned collection: the newest wins.

    Of rows with one id the largest version stays, the batch's where they are equal, so a batch
    that is applied again changes nothing and a late one does not undo a newer. With
    ``whole_documents`` a document's points are those of its newest version: what an earlier
    version had besides goes. Rows without id or vector are set aside. The counts
    (``added, replaced, late, removed, set_aside``) are returned. Where no stored point makes
    way, the new ones are appended; else the slots that change are written anew.
    """
    spark = batch.sparkSession
    table = spark.table(name)
    columns = [c for c in table.columns if c != "slot"]
    usable = F.col("id").isNotNull() & F.col("vector").isNotNull()
    seen = Observation()
    new = stored(batch.select(*columns).observe(seen, F.count_if(~usable).alias("set_aside")).filter(usable))
    repeated = reliable_checkpoint(new.groupBy("id").count().filter("count > 1").select("id"))
    if not repeated.isEmpty():
        by = F.struct(F.col("version"), F.to_json("payload"), F.to_json("vector"))
        last = new.join(repeated, "id", "left_semi").groupBy("id").agg(
            F.max_by(F.struct(*[c for c in columns if c != "id"]), by).alias("__p")
        )
        new = stored(new.join(repeated, "id", "left_anti").unionByName(last.select("id", "__p.*")))

    # Ids, versions and documents decide; of whole points only those move that change place.
    def facts(rows: DataFrame, own: bool) -> DataFrame:
        return rows.select("id", "version", F.col("payload.document_id").alias("document"), F.lit(own).alias("own"))

    best = facts(new, True).unionByName(facts(table, False)).groupBy("id").agg(
        F.max_by(F.struct("version", "document", "own"), F.struct("version", "own")).alias("__p"),
        F.bool_or("own").alias("asked"), F.bool_or(~F.col("own")).alias("stored"),
    ).select("id", "__p.*", "asked", "stored")
    outdated = F.lit(False)
    if whole_documents:
        documents = facts(new, True).select(F.col("document").alias("__d")).distinct()
        newest = best.groupBy(F.col("document").alias("__document")).agg(F.max("version").alias("__newest"))
        newest = newest.join(documents, F.col("__document").eqNullSafe(F.col("__d")), "left_semi")
        best = best.join(newest, F.col("document").eqNullSafe(F.col("__document")), "left")
        outdated = F.coalesce(F.col("version") < F.col("__newest"), F.lit(False))
    judged = stored(
        best.select("id", "own", "asked", "stored", outdated.alias("outdated")).filter("asked OR outdated")
    )
    won = F.col("own") & ~F.col("outdated")
    counts = judged.agg(
        F.count_if(won & ~F.col("stored")).alias("added"),
        F.count_if(won & F.col("stored")).alias("replaced"),
        F.count_if(F.col("asked") & ~won).alias("late"),
        F.count_if(F.col("outdated") & F.col("stored")).alias("removed"),
    ).first().asDict() | {"set_aside": seen.get["set_aside"]}
    if counts["late"]:
        new = new.join(judged.filter(F.col("asked") & ~won).select("id"), "id", "left_anti")
    gone = judged.filter(F.col("stored") & (F.col("own") | F.col("outdated"))).select("id")
    if gone.isEmpty():
        if counts["added"]:
            _with_slot(new).write.mode("append").insertInto(name)
        return counts
    slots = [r["slot"] for r in _with_slot(gone.unionByName(new.select("id"))).select("slot").distinct().collect()]  # at most SLOTS
    kept = table.filter(F.col("slot").isin(slots)).select(*columns).join(gone, "id", "left_anti")
    _overwrite(stored(_with_slot(kept.unionByName(new))), name, slots)
    return counts


def vector_stats(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """Number of vectors, smallest and largest dimension and length, zero vectors."""
    length = norm(F.col(vector))
    return vectors.agg(
        F.count("*").alias("n_vectors"),
        F.min(F.size(vector)).alias("min_dim"),
        F.max(F.size(vector)).alias("max_dim"),
        F.min(length).alias("min_norm"),
        F.max(length).alias("max_norm"),
        F.count_if(length == 0).alias("n_zero"),
    )


def check_dimension(batch: DataFrame, name: str) -> DataFrame:
    """The batch, failing the job on a vector whose size is not the collection's."""
    dim = int(collection_properties(batch.sparkSession, name)["dim"])
    ok = F.size("vector") == dim
    return batch.withColumn(
        "vector", F.when(ok, F.col("vector")).otherwise(F.raise_error(F.lit(f"vector size is not {dim}")))
    )
