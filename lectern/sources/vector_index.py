"""A stored vector index for exact cosine search that leaves most items untouched.

Vectors are kept by the nearest of some centres, and inside a centre in rings of growing angle
to it, ``RING`` rows or so to a block. The angle between a query and any item of a block is at
least the gap between the query's angle to the centre and the block's range of angles. A query
first meets the blocks that may hold its nearest items; the k-th similarity found there is a
floor, and of all other blocks only those are looked at whose bound is not below it. The result
is that of ``operators.dense.dense_topk``: recall is 1, whatever the centres are; they decide
only how much is skipped.

For the floors, tiles of queries are sent to the few blocks that they meet first. With its floor
a query is cheap to turn away, so then the queries go to where the blocks are read, in slices
of bounded size, and nothing is shuffled or stored for the pairs that meet. What a search
broadcasts besides is the table of blocks and centres: at most ``MOST_BLOCKS`` rows, for blocks
grow with the index beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.vectors import SCORE_DIGITS, matrix, unit_rows
from lectern.operators.dense import few_copies, query_slices, search_block
from lectern.operators.topk import RunningBest, best_per_query, id_order, rank_results
from lectern.session import bound_batches, lean, reliable_checkpoint, spread

CENTRES, RING, MOST_BLOCKS = 1024, 512, 200_000
_TILE = 512
_CELLS = 1 << 20
_SLACK = 1e-6


def _units(batch: pa.RecordBatch, vector: str) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows with a vector that is not zero, and their vectors at length 1."""
    batch = batch.filter(pa.array(np.asarray(batch.column(vector).is_valid())))
    rows = unit_rows(matrix(batch.column(vector)))
    good = ~np.isnan(rows).any(axis=1) if rows.size else np.zeros(batch.num_rows, bool)
    return batch.filter(pa.array(good)), rows[good]


def _gaps(angle: np.ndarray, low, high) -> np.ndarray:
    """Least angle between a query and the items of a block, by their angles to its centre."""
    return np.maximum(np.maximum(angle - high, low - angle), 0.0)


def _angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centres.T, -1.0, 1.0))


def write_vector_index(
    items: DataFrame, path: str, item_id: str = "item_id", vector: str = "vector", centres: int = CENTRES, ring: int = RING
) -> None:
    """Store ``items`` by centre and angle; vectors that are null or zero are left out.

    Centres are the ``centres`` vectors with the smallest hash of their id, about the square
    root of the items if those are fewer: a bounded sample that steers the layout only.
    """
    spark = items.sparkSession
    own = items.select(F.col(item_id).alias("item_id"), F.col(vector).alias("vector")).filter(F.col("vector").isNotNull())
    n_items = own.count()
    wanted = max(1, min(centres, int(n_items**0.5)))
    rows = max(ring, -(-n_items // MOST_BLOCKS))
    sample = own.orderBy(F.xxhash64("item_id", F.lit(3)), "item_id").limit(wanted).toArrow()
    middle = unit_rows(matrix(sample["vector"])) if len(sample) else np.zeros((0, 0))
    middle = middle[~np.isnan(middle).any(axis=1)] if len(sample) else middle
    if n_items and not len(middle):
        middle = np.eye(1, len(sample["vector"][0]))
    shared = spark.sparkContext.broadcast(middle)
    kind = own.schema["item_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, units = _units(batch, "vector")
            for low in range(0, batch.num_rows, 4096):
                part = units[low : low + 4096]
                angles = _angles(part, shared.value)
                centre = angles.argmin(axis=1)
                flat = pa.array(part.ravel())
                offsets = pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32())
                yield pa.RecordBatch.from_pydict(
                    {
                        "centre": pa.array(centre, pa.int32()),
                        "angle": pa.array(angles[np.arange(len(part)), centre]),
                        "item_id": batch.column("item_id").slice(low, 4096),
                        "vector": pa.ListArray.from_arrays(offsets, flat),
                    }
                )

    placed = own.mapInArrow(lean(place), f"centre int, angle double, item_id {kind}, vector array<double>")
    order = ["centre", "angle", "item_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centre, angle = np.asarray(batch.column("centre")), np.asarray(batch.column("angle"))
            changes = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]])
            inside = np.arange(len(centre)) - np.repeat(changes, np.diff(np.r_[changes, len(centre)]))
            begins = np.flatnonzero(inside % rows == 0)
            ends = np.r_[begins[1:], len(centre)]
            units = matrix(batch.column("vector"))
            yield pa.RecordBatch.from_pydict(
                {
                    "centre": pa.array(centre[begins]),
                    "n": pa.array((ends - begins).astype(np.int32)),
                    "low": pa.array(angle[begins]),
                    "high": pa.array(angle[ends - 1]),
                    "ids": pa.ListArray.from_arrays(pa.array(np.r_[begins, len(centre)], pa.int32()), batch.column("item_id")),
                    "units": pa.array([units[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()),
                }
            )

    packed = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pack, f"centre int, n int, low double, high double, ids array<{kind}>, units binary"
    )
    packed.withColumn("block", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/blocks")
    listed = [(i, row.tolist()) for i, row in enumerate(middle)]
    spark.createDataFrame(listed, "centre int, vector array<double>").write.mode("overwrite").parquet(f"{path}/centres")


class VectorIndex:
    """An index folder opened for search."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.blocks = spark.read.parquet(f"{path}/blocks")
        centres = spark.read.parquet(f"{path}/centres").orderBy("centre").toArrow()
        heads = self.blocks.select("block", "centre", "n", "low", "high").orderBy("block").toArrow()
        self.n_items = int(np.asarray(heads["n"]).sum())
        self._heads = [np.asarray(heads[c]) for c in ("block", "centre", "n", "low", "high")]
        self._centres = matrix(centres["vector"]) if len(centres) else np.zeros((0, 0))

    def _deal(self, queries: DataFrame, query_id: str, vector: str, k: int) -> DataFrame:
        """Tiles of queries for the blocks of the best bounds that hold k items or more."""
        shared = self.spark.sparkContext.broadcast((self._heads, self._centres))
        kind = queries.schema[query_id].dataType.simpleString()

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (block, centre, n, low, high), centres = shared.value
            tile = max(1, min(_TILE, _CELLS // max(1, len(block))))
            for whole in batches:
                whole, all_units = _units(whole, vector)
                for at in range(0, whole.num_rows, tile):
                    batch, units = whole.slice(at, tile), all_units[at : at + tile]
                    if units.shape[1] != centres.shape[1]:
                        raise ValueError(f"query vectors have {units.shape[1]} dimensions, not {centres.shape[1]}")
                    least = _gaps(_angles(units, centres)[:, centre], low, high)
                    wanted = np.zeros(least.shape, bool)
                    order = np.argsort(least, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    np.put_along_axis(wanted, order, before < k, axis=1)
                    for b in np.flatnonzero(wanted.any(axis=0)):
                        own = np.flatnonzero(wanted[:, b])
                        yield pa.RecordBatch.from_pydict(
                            {
                                "block": pa.array([block[b]], pa.int64()),
                                "asked": pa.array([batch.column(query_id).take(pa.array(own)).to_pylist()], pa.list_(batch.column(query_id).type)),
                                "vectors": pa.array([units[own].tobytes()], pa.binary()),
                            }
                        )

        return queries.mapInArrow(lean(deal), f"block long, asked array<{kind}>, vectors binary")

    def _meet(self, dealt: DataFrame, k: int, query_id: str, kind: str) -> DataFrame:
        """The k best of every tile and block, by a matrix product."""
        item_kind = self.blocks.schema["ids"].dataType.elementType.simpleString()
        pairs = dealt.join(self.blocks.select("block", "n", "ids", "units"), "block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, asked = batch.column("ids")[i].values, batch.column("asked")[i].values
                    items = np.frombuffer(batch.column("units")[i].as_buffer()).reshape(len(ids), -1)
                    own = np.frombuffer(batch.column("vectors")[i].as_buffer()).reshape(len(asked), -1)
                    scores = np.round(own @ items.T, SCORE_DIGITS)
                    rows, cols = best_per_query(scores, id_order(ids), k)
                    best = RunningBest(len(asked), k)
                    best.add(rows, ids.take(pa.array(cols)), scores[rows, cols])
                    rows, found, values = best.result()
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(rows)), found, pa.array(values)], names=[query_id, "item_id", "similarity"])

        return pairs.mapInArrow(lean(run), f"`{query_id}` {kind}, item_id {item_kind}, similarity double")

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
        """The k most similar items of every query: ``query_id, item_id, similarity, rank``."""
        return self.search_with_reads(queries, k, query_id, vector)[0]

    def _scan(self, asked: DataFrame, k: int, query_id: str, vector: str, kind: str):
        """One slice of queries, each with its floor, over all blocks: broadcast, hits, pairs compared."""
        table = asked.toArrow()
        ids = table[query_id].combine_chunks()
        units = unit_rows(matrix(table[vector], ids))
        good = ~np.isnan(units).any(axis=1) if units.size else np.zeros(len(ids), bool)
        floor = np.asarray(table["floor"].fill_null(-np.inf))
        shared = self.spark.sparkContext.broadcast((ids.filter(pa.array(good)), units[good], floor[good], self._centres))
        item_kind = self.blocks.schema["ids"].dataType.elementType.simpleString()

        def angles_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            """Every block of a batch with its least possible angle to the queries."""
            _, units, _, centres = shared.value
            last = None
            for i in range(batch.num_rows):
                centre, low, high = (batch.column(c)[i].as_py() for c in ("centre", "low", "high"))
                if centre != last:
                    last, angle = centre, _angles(units, centres[centre : centre + 1])[:, 0]
                yield i, np.minimum(_gaps(angle, low, high), np.pi)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, units, floor, _ = shared.value
            if not len(ids):
                return
            best = RunningBest(len(ids), k)
            best.floor[:] = floor
            for batch in batches:
                for i, least in angles_of(batch):
                    own = np.flatnonzero(np.cos(least) >= best.floor - _SLACK)
                    if not len(own):
                        continue
                    found = batch.column("ids")[i].values
                    items = np.frombuffer(batch.column("units")[i].as_buffer()).reshape(len(found), -1)
                    few = few_copies(items, found, k)
                    search_block(units[own], own, items[few], found.take(pa.array(few)), best, k)
            if best.parts:
                rows, found, values = best.result()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), found, pa.array(values)], names=[query_id, "item_id", "similarity"])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floor = shared.value[2]
            for batch in batches:
                met = [int((np.cos(least) >= floor - _SLACK).sum()) * batch.column("n")[i].as_py() for i, least in angles_of(batch)]
                yield pa.RecordBatch.from_pydict({"compared": pa.array(met, pa.int64())})

        blocks = spread(self.blocks.select("centre", "low", "high", "ids", "units"))
        hits = blocks.mapInArrow(lean(scan), f"`{query_id}` {kind}, item_id {item_kind}, similarity double")
        return shared, hits, self.blocks.select("centre", "low", "high", "n").mapInArrow(count, "compared long")

    def search_with_reads(
        self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "vector"
    ) -> tuple[DataFrame, DataFrame]:
        """The hits, and how many ``(query, item)`` pairs the floors let meet of how many there are."""
        bound_batches(self.spark)
        own = reliable_checkpoint(queries.select(query_id, vector).filter(F.col(vector).isNotNull()))
        kind = own.schema[query_id].dataType.simpleString()
        seeds = reliable_checkpoint(self._deal(own, query_id, vector, k))
        first = rank_results(self._meet(seeds, k, query_id, kind), k, query_id, "item_id", "similarity")
        floors = first.groupBy(query_id).agg(F.count("*").alias("__n"), F.min("similarity").alias("floor"))
        floors = floors.filter(F.col("__n") == k).select(F.col(query_id).alias("__query"), "floor")
        floored = own.join(floors, F.col(query_id) == F.col("__query"), "left").select(query_id, vector, "floor")
        parts = query_slices(reliable_checkpoint(floored), query_id, vector, [])
        hits = compared = None
        for part in parts:
            shared, found, met = self._scan(part, k, query_id, vector, kind)
            if len(parts) > 1:
                found = reliable_checkpoint(rank_results(found, k, query_id, "item_id", "similarity").drop("rank"))
                shared.unpersist()
            hits = found if hits is None else hits.unionByName(found)
            compared = met if compared is None else compared.unionByName(met)
        total = compared.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
        reads = total.select("compared", (F.lit(own.count()) * F.lit(self.n_items)).alias("pairs"))
        return rank_results(hits, k, query_id, "item_id", "similarity"), reads
