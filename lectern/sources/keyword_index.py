"""A stored keyword index: postings in blocks with maxima, added to without a rebuild.

The folder holds two tables. ``postings`` has a row per block: up to ``BLOCK`` items of one
term, those with the highest weight first, with the block's largest frequency and smallest item
length. These bound every weight in the block whatever items are added later, when the mean
length and the term's rarity change. ``items`` has a row per item: its length and its words with
their frequencies.

A query is answered in three steps. Its rarest terms' first blocks give a first list of items;
the k-th partial score of these cannot exceed the k-th score. Terms whose greatest weights
together stay below it are not looked up at all, and of the other terms' blocks only those are
that could lift an item to it. The items found so that may still reach the best, few of all, get
what the other terms add from their own rows. The result is that of ``operators.sparse.bm25_topk``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.vectors import SCORE_DIGITS
from lectern.operators.sparse import query_terms, words
from lectern.operators.topk import rank_results
from lectern.session import bound_batches, lean, reliable_checkpoint, stored

BLOCK = 128
_SLACK = 1e-6


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by term and weight to rows of blocks; a batch's end also ends a block."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term = np.asarray(batch.column("term").dictionary_encode().indices)
        changes = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        inside = np.arange(n) - np.repeat(changes, np.diff(np.r_[changes, n]))
        begins = np.flatnonzero(inside % BLOCK == 0)
        offsets = pa.array(np.r_[begins, n], pa.int32())
        tf, length = np.asarray(batch.column("tf")), np.asarray(batch.column("length"))
        yield pa.RecordBatch.from_pydict(
            {
                "term": batch.column("term").take(pa.array(begins)),
                "n": pa.array(np.diff(np.r_[begins, n]).astype(np.int32)),
                "max_tf": pa.array(np.maximum.reduceat(tf, begins)),
                "min_length": pa.array(np.minimum.reduceat(length, begins)),
                "ids": pa.ListArray.from_arrays(offsets, batch.column("item_id")),
                "tfs": pa.ListArray.from_arrays(offsets, batch.column("tf")),
                "lengths": pa.ListArray.from_arrays(offsets, batch.column("length")),
            }
        )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items' words to a map of their frequencies, and their number."""
    for batch in batches:
        lists = batch.column("words")
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        size = max(1, len(words.dictionary))
        row = np.repeat(np.arange(len(lengths)), lengths)
        found, tf = np.unique(row * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        offsets = np.searchsorted(found, np.arange(len(lengths) + 1) * size).astype(np.int32)
        terms = pa.MapArray.from_arrays(offsets, words.dictionary.take(pa.array(found % size)), pa.array(tf.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), terms, pa.array(lengths.astype(np.int32))], ["item_id", "terms", "length"]
        )


def add_to_index(items: DataFrame, path: str, item_id: str = "item_id", text: str = "text") -> None:
    """Write the index of ``items``, or add them to the one that is there.

    Each item is to be added once; items without a text do not count.
    """
    own = items.filter(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("words"))
    kind = own.schema["item_id"].dataType.simpleString()
    repeated = reliable_checkpoint(own.groupBy("item_id").count().filter("count > 1").select(F.col("item_id").alias("__same")))
    if not repeated.isEmpty():
        # Rows with words that have one id are one item.
        same = F.col("item_id").eqNullSafe(F.col("__same"))
        several, empty = own.join(repeated, same, "left_semi"), F.size("words") == 0
        joined = several.filter(~empty).groupBy("item_id").agg(F.flatten(F.collect_list("words")).alias("words"))
        own = own.join(repeated, same, "left_anti").unionByName(several.filter(empty)).unionByName(joined)
    bound_batches(items.sparkSession)
    part = f"{path}/items/batch={uuid.uuid4().hex}"
    own.mapInArrow(lean(_counted), f"item_id {kind}, terms map<string,int>, length int").write.parquet(part)
    rows = items.sparkSession.read.parquet(part)
    single = rows.select("item_id", "length", F.explode("terms").alias("term", "tf"))
    order = [F.col("term"), (F.col("tf") / (F.col("tf") + F.col("length") / 100)).desc(), F.col("item_id")]
    packed = single.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lean(_blocks),
        f"term string, n int, max_tf int, min_length int, ids array<{kind}>, tfs array<int>, lengths array<int>",
    )
    packed.withColumn("block", F.expr("uuid()")).write.mode("append").parquet(f"{path}/postings")


def _weight(tf: Column, length: Column, average: float) -> Column:
    """Share of a term's rarity that an item gets."""
    norm = fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * length / F.lit(average))
    return tf * (fixed.BM25_K1 + 1) / (tf + norm)


class KeywordIndex:
    """An index folder opened for search."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings = spark.read.parquet(f"{path}/postings")
        self.items = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/items")
        sums = self.items.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        self.n_items = sums[0]
        self.average = sums[1] / sums[0] if sums[1] else 1.0

    def _asked(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Query terms with rarity and greatest weight, and the bounds of their blocks."""
        bound = _weight(F.col("max_tf"), F.col("min_length"), self.average)
        heads = self.postings.select("term", "block", "n", bound.alias("bound"))
        heads = stored(heads.join(terms.select("term").distinct(), "term", "left_semi"))
        df = F.col("df")
        stats = heads.groupBy("term").agg(F.sum("n").alias("df"), F.max("bound").alias("most")).select(
            "term", "df", F.log(F.lit(1.0) + (F.lit(self.n_items) - df + 0.5) / (df + 0.5)).alias("idf"), "most"
        )
        asked = terms.join(stats, "term").withColumn("most", F.col("most") * F.col("idf"))
        return reliable_checkpoint(asked), heads

    def _partial(self, wanted: DataFrame) -> DataFrame:
        """``query_id, item_id, score`` from the blocks ``query_id, term, block, idf``."""
        lists = self.postings.select("term", "block", "ids", "tfs", "lengths")
        found = wanted.join(lists, ["term", "block"]).select(
            "query_id", "idf", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p")
        )
        gain = F.col("idf") * _weight(F.col("p.tfs"), F.col("p.lengths"), self.average)
        return found.groupBy("query_id", F.col("p.ids").alias("item_id")).agg(F.sum(gain).alias("score"))

    def _floors(self, asked: DataFrame, heads: DataFrame, k: int) -> DataFrame:
        """A score per query that at least k items reach: from the best blocks of rare terms."""
        rare = Window.partitionBy("query_id").orderBy(F.desc("idf"), "term")
        before = F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seeds = asked.withColumn("__before", before).filter(F.col("__before") < 4 * k).select("query_id", "term", "idf")
        best = Window.partitionBy("term").orderBy(F.desc("bound"), "block")
        ranked = heads.withColumn("__rank", F.row_number().over(best)).filter(F.col("__rank") <= 1 + 4 * k // BLOCK)
        partial = self._partial(seeds.join(ranked.select("term", "block"), "term"))
        top = rank_results(partial, k, "query_id", "item_id", "score")
        least = top.groupBy("query_id").agg(F.count("*").alias("__n"), F.min("score").alias("floor"))
        return least.filter(F.col("__n") == k).select("query_id", "floor")

    def _wanted(self, asked: DataFrame, heads: DataFrame, floors: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Blocks that can hold an item of a query's best, and what the other terms may add."""
        rising = Window.partitionBy("query_id").orderBy("most", "term")
        whole = Window.partitionBy("query_id")
        floor = F.coalesce("floor", F.lit(0.0)) - _SLACK
        judged = (
            asked.join(floors, "query_id", "left")
            .withColumn("__upto", F.sum("most").over(rising))
            .withColumn("__all", F.sum("most").over(whole))
        )
        needed = F.col("__upto") >= floor
        spare = judged.groupBy("query_id").agg(
            F.coalesce(F.sum(F.when(~needed, F.col("most"))), F.lit(0.0)).alias("spare"), F.max(floor).alias("floor")
        )
        reach = F.col("bound") * F.col("idf") + F.col("__all") - F.col("most")
        wanted = judged.filter(needed).join(heads, "term").filter(reach >= floor)
        return wanted.select("query_id", "term", "block", "idf", "n"), spare

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "text") -> DataFrame:
        """The k best items of every query: ``query_id, item_id, score, rank``."""
        hits, _ = self.search_with_reads(queries, k, query_id, text)
        return hits

    def search_with_reads(
        self, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "text"
    ) -> tuple[DataFrame, DataFrame]:
        """The hits, and per query its postings: those of all its terms and those looked up."""
        own = queries.filter(F.col(text).isNotNull())
        terms = reliable_checkpoint(query_terms(own, query_id, text).withColumnRenamed(query_id, "query_id"))
        asked, heads = self._asked(terms)
        floors = reliable_checkpoint(self._floors(asked, heads, k))
        wanted, spare = self._wanted(asked, heads, floors)
        wanted = stored(wanted)
        partial = stored(self._partial(wanted.drop("n")))
        # No item's score is below its partial score, so the k-th of these is a better floor.
        least = rank_results(partial, k, "query_id", "item_id", "score").groupBy("query_id").agg(
            F.count("*").alias("__n"), F.min("score").alias("__least")
        )
        raised = F.greatest("floor", F.when(F.col("__n") == k, F.col("__least") - _SLACK))
        bounds = spare.join(least, "query_id").select("query_id", "spare", raised.alias("floor"))
        near = partial.join(bounds, "query_id").filter(F.col("score") + F.col("spare") >= F.col("floor"))
        lists = asked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("asked"))
        # Where all terms were looked up, partial scores are whole for all that can be among the best.
        done = near.filter(F.col("spare") == 0).select("query_id", "item_id", "score")
        rows = near.filter(F.col("spare") > 0).select("query_id", "item_id").join(self.items, "item_id")

        def gain(total, entry):
            tf = F.element_at("terms", entry["term"])
            own = entry["idf"] * _weight(tf, F.col("length"), self.average)
            return total + F.coalesce(own, F.lit(0.0))

        exact = F.aggregate("asked", F.lit(0.0), gain).alias("score")
        both = done.unionByName(rows.join(lists, "query_id").select("query_id", "item_id", exact))
        scored = both.select(
            F.col("query_id").alias(query_id), "item_id", F.round("score", SCORE_DIGITS).alias("score")
        ).filter("score > 0")
        whole = asked.groupBy("query_id").agg(F.sum("df").alias("postings"))
        looked = wanted.groupBy("query_id").agg(F.sum("n").alias("looked_up"))
        reads = whole.join(looked, "query_id", "left").select(
            F.col("query_id").alias(query_id), "postings", F.coalesce("looked_up", F.lit(0)).alias("looked_up")
        )
        return rank_results(scored, k, query_id, "item_id", "score"), reads
