"""Exact best-k search by integer inner product: tiles of queries against shards of items.

Vectors are packed into matrices where they lie: shards of all items, tiles of the queries.
Tiles and shards meet in a grid of cells (a slice of the tiles, a group of the shards), so each
is copied once per row or column of the grid and not once per partner. A task multiplies the
tiles and shards of its cells block by block, keeps a tile's best k so far, and drops every
score below them before anything is sorted. The lists of the tasks are then merged in a tree,
``FAN_IN`` at a time, until one per tile is left. No list of all scores exists anywhere, and
neither vectors nor lists pass through the driver.

Results in special cases:

* Vectors that are null or empty of meaning (a component null, NaN or infinite) take no part.
* Vectors of unequal length do not meet; vectors without components score 0 with each other.
* Components are floor(scale * x), kept within 64 bits; scores are exact, and beyond 64 bits
  they stop at the ends of that range.
* Ties go to the smaller id, null ids last. A row with a null id is an item and no query.
* Repeated rows: each is an item of its own, may fill several ranks, and is a query of its own;
  only the query's own row is left out. They are counted before packing, so thousands of equal
  rows cost as much as one.
* Queries with fewer than k items get all of them; no items or queries give no rows.
* Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import bound_batches
from lectern.session import scratch_path

SCALE = 1024
SHARD_ROWS, TILE_ROWS, BLOCK_ROWS = 8192, 2048, 1024
TILES_PER_SLICE, SHARDS_PER_GROUP = 16, 64
FAN_IN = 16

_ROWS = "id long, asks boolean, weight long, ints array<long>"
_PACKED = "number long, dim int, n int, asks int, ids binary, known binary, weights binary, asking binary, data binary"
_LISTS = (
    "tile long, part int, query_ids binary, query_weights binary, "
    "slots binary, scores binary, ids binary, known binary, weights binary"
)
_HITS = "query_id long, rank int, vec_id long, score long"


def _raw(values: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _narrow(data: np.ndarray) -> bytes:
    """Integers in the fewest of 2, 4 or 8 bytes; the reader tells the width by the length."""
    most = max((abs(int(data.min())), abs(int(data.max())))) if data.size else 0
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return _raw(data, kind)


def _wide(data: bytes, n: int, dim: int) -> np.ndarray:
    width = len(data) // (n * dim) if n * dim else 8
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[width]).reshape(n, dim)


def _packer(rows_per_tile: int):
    """Rows ``id, asks, weight, ints`` to matrices, one length of vectors each, sorted by id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[list[np.ndarray]]] = {}

        def emit(dim: int, size: int) -> pa.RecordBatch:
            nonlocal made
            ids, known, weights, asks, data = (np.concatenate(x) for x in zip(*held[dim], strict=True))
            held[dim] = [[x[size:] for x in (ids, known, weights, asks, data)]]
            ids, known, weights, asks, data = (x[:size] for x in (ids, known, weights, asks, data))
            by = np.lexsort((ids, ~known))
            made += 1
            return pa.RecordBatch.from_pydict(
                {
                    "number": [(part << 32) + made],
                    "dim": pa.array([dim], pa.int32()),
                    "n": pa.array([len(ids)], pa.int32()),
                    "asks": pa.array([int(asks.sum())], pa.int32()),
                    "ids": [_raw(ids[by], np.int64)],
                    "known": [_raw(known[by], np.bool_)],
                    "weights": [_raw(weights[by], np.int64)],
                    "asking": [_raw(asks[by], np.bool_)],
                    "data": [_narrow(data[by])],
                }
            )

        for batch in batches:
            ids = batch.column("id")
            known = np.asarray(ids.is_valid())
            number = np.asarray(ids.fill_null(0))
            weight, asks = np.asarray(batch.column("weight")), np.asarray(batch.column("asks").fill_null(False))
            lists = batch.column("ints")
            lengths = np.asarray(lists.value_lengths()).astype(np.int64)
            values = np.asarray(lists.flatten())
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                data = values[(ends[rows] - dim)[:, None] + np.arange(dim)].reshape(len(rows), dim)
                held.setdefault(int(dim), []).append([number[rows], known[rows], weight[rows], asks[rows], data])
                while sum(len(x[0]) for x in held[int(dim)]) >= rows_per_tile:
                    yield emit(int(dim), rows_per_tile)
        for dim in held:
            rest = sum(len(x[0]) for x in held[dim])
            if rest:
                yield emit(dim, rest)

    return pack


def _queries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asking rows of shards, as rows again."""
    for batch in batches:
        for row in batch.to_pylist():
            asking = np.frombuffer(row["asking"], np.bool_)
            data = _wide(row["data"], row["n"], row["dim"])[asking].astype(np.int64)
            n = len(data)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array(np.frombuffer(row["ids"], np.int64)[asking]),
                    "asks": pa.array(np.ones(n, bool)),
                    "weight": pa.array(np.frombuffer(row["weights"], np.int64)[asking]),
                    "ints": pa.ListArray.from_arrays(
                        pa.array(np.arange(n + 1) * row["dim"], pa.int32()), pa.array(data.ravel())
                    ),
                }
            )


def _products(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Exact inner products: by float BLAS where that is exact, else by integers."""
    if not queries.size or not items.size:
        return np.zeros((len(queries), len(items)))
    largest = int(np.abs(queries.astype(object)).max() if queries.dtype == np.int64 else np.abs(queries.astype(np.int64)).max())
    largest *= int(np.abs(items.astype(object)).max() if items.dtype == np.int64 else np.abs(items.astype(np.int64)).max())
    largest *= items.shape[1]
    if largest < 1 << 53:
        return queries.astype(np.float64) @ items.astype(np.float64).T
    if largest < 1 << 63:
        return queries.astype(np.int64) @ items.astype(np.int64).T
    scores = queries.astype(object) @ items.astype(object).T
    return np.clip(scores, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


class _Best:
    """The k best items so far of every query of one tile, as flat arrays."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.slots, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.known, self.weights = np.zeros(0, bool), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, slots, scores, ids, known, weights) -> None:
        slots, scores = np.concatenate([self.slots, slots]), np.concatenate([self.scores, scores])
        ids, known = np.concatenate([self.ids, ids]), np.concatenate([self.known, known])
        weights = np.concatenate([self.weights, weights])
        by = np.lexsort((ids, ~known, ~scores, slots))  # ~x falls as x rises, without overflow
        first = np.searchsorted(slots[by], np.arange(self.n + 1))
        place = np.arange(len(by)) - first[slots[by]]
        by = by[place < self.k]
        self.slots, self.scores, self.ids = slots[by], scores[by], ids[by]
        self.known, self.weights = known[by], weights[by]
        counts = np.bincount(self.slots, minlength=self.n)
        full = counts >= self.k
        self.least[full] = self.scores[np.cumsum(counts)[full] - 1]

    def add_block(self, scores, own, ids, known, weights) -> None:
        """A block of scores, queries by items; ``own`` is each query's own item here, or -1."""
        lone = own >= 0
        lone[lone] = weights[own[lone]] == 1
        out = np.ones(scores.shape, bool)
        out[np.flatnonzero(lone), own[lone]] = False
        # Floats round, so a score that ties with the least one may only be kept, not lost.
        keep = out & (scores >= self.least[:, None])
        if np.count_nonzero(keep) > 4 * self.k * self.n and scores.shape[1] > self.k + 1:
            # One more than k, for the query's own row may be among them.
            kth = np.partition(scores, scores.shape[1] - self.k - 1, axis=1)[:, scores.shape[1] - self.k - 1]
            keep &= scores >= kth[:, None]
        slots, cols = np.nonzero(keep)
        weight = weights[cols] - (cols == own[slots])
        self.add(slots, scores[slots, cols].astype(np.int64), ids[cols], known[cols], weight)

    def row(self, tile: int, part: int, query_ids: bytes, query_weights: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "tile": [tile],
                "part": pa.array([part], pa.int32()),
                "query_ids": [query_ids],
                "query_weights": [query_weights],
                "slots": [_raw(self.slots, np.int32)],
                "scores": [_raw(self.scores, np.int64)],
                "ids": [_raw(self.ids, np.int64)],
                "known": [_raw(self.known, np.bool_)],
                "weights": [_raw(self.weights, np.int64)],
            }
        )


def _own_items(query_ids, queries, ids, known, items) -> np.ndarray:
    """Position of each query's own row among the items, or -1."""
    own = np.full(len(query_ids), -1)
    sorted_ids = ids[: np.count_nonzero(known)]  # known ids come first, in order
    low, high = np.searchsorted(sorted_ids, query_ids), np.searchsorted(sorted_ids, query_ids, "right")
    for slot in np.flatnonzero(low < high):
        same = np.flatnonzero((items[low[slot] : high[slot]] == queries[slot]).all(axis=1))
        if len(same):
            own[slot] = low[slot] + same[0]
    return own


def _cell_products(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        best: dict[int, tuple[_Best, bytes, bytes]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if row["tile"] not in best:
                    if len(best) >= 4 * TILES_PER_SLICE:
                        for tile, (found, *about) in best.items():
                            yield found.row(tile, part, *about)
                        best.clear()
                    best[row["tile"]] = (_Best(row["q_n"], k), row["q_ids"], row["q_weights"])
                found = best[row["tile"]][0]
                queries = _wide(row["q_data"], row["q_n"], row["dim"])
                items = _wide(row["data"], row["n"], row["dim"])
                ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.bool_)
                weights = np.frombuffer(row["weights"], np.int64)
                own = _own_items(np.frombuffer(row["q_ids"], np.int64), queries, ids, known, items)
                for low in range(0, row["n"], BLOCK_ROWS):
                    cut = slice(low, low + BLOCK_ROWS)
                    here = np.where((own >= low) & (own < low + BLOCK_ROWS), own - low, -1)
                    found.add_block(_products(queries, items[cut]), here, ids[cut], known[cut], weights[cut])
        for tile, (found, *about) in best.items():
            yield found.row(tile, part, *about)

    return run


def _merge_lists(k: int):
    def merge(table: pa.Table) -> tuple[_Best, dict]:
        rows = table.to_pylist()
        best = _Best(len(rows[0]["query_ids"]) // 8, k)
        for r in rows:
            best.add(
                np.frombuffer(r["slots"], np.int32).astype(np.int64),
                np.frombuffer(r["scores"], np.int64),
                np.frombuffer(r["ids"], np.int64),
                np.frombuffer(r["known"], np.bool_),
                np.frombuffer(r["weights"], np.int64),
            )
        return best, rows[0]

    def lists(table: pa.Table) -> pa.Table:
        best, about = merge(table)
        row = best.row(about["tile"], about["part"] // FAN_IN, about["query_ids"], about["query_weights"])
        return pa.Table.from_batches([row])

    def hits(table: pa.Table) -> pa.Table:
        best, about = merge(table)
        query_ids = np.frombuffer(about["query_ids"], np.int64)
        repeats = np.frombuffer(about["query_weights"], np.int64)
        # An item that stands for several rows fills as many ranks, at most k of them.
        copies = np.minimum(best.weights, k)
        at = np.repeat(np.arange(len(copies)), copies)
        slots = best.slots[at]
        rank = np.arange(len(at)) - np.searchsorted(slots, np.arange(best.n + 1))[slots] + 1
        at, slots, rank = at[rank <= k], slots[rank <= k], rank[rank <= k]
        again = np.repeat(np.arange(len(at)), repeats[slots])
        at, slots, rank = at[again], slots[again], rank[again]
        return pa.table(
            {
                "query_id": pa.array(query_ids[slots], pa.int64()),
                "rank": pa.array(rank, pa.int32()),
                "vec_id": pa.array(best.ids[at], pa.int64(), mask=~best.known[at]),
                "score": pa.array(best.scores[at], pa.int64()),
            }
        )

    return lists, hits


def usable(vector: Column) -> Column:
    """True for a vector all of whose components are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def exact_top_k(
    items: DataFrame,
    is_query: Column,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    scale: int = SCALE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's ``k`` best other rows.

    ``is_query`` tells from an item's columns whether it is a query as well.
    """
    spark = items.sparkSession
    bound_batches(spark)
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = items.filter(usable(F.col(vector))).select(
        F.col(id).cast("long").alias("id"),
        (is_query & F.col(id).isNotNull()).alias("asks"),
        ints.alias("ints"),
    )
    counted = rows.groupBy("id", "asks", "ints").agg(F.count("*").alias("weight"))
    stored = scratch_path(spark, "shards")
    counted.mapInArrow(_packer(SHARD_ROWS), _PACKED).write.parquet(stored)
    shards = spark.read.parquet(stored)
    n_shards, asking = shards.agg(F.count("*"), F.coalesce(F.sum("asks"), F.lit(0))).first()
    tiles_stored = scratch_path(spark, "tiles")
    asked = shards.filter("asks > 0").mapInArrow(_queries_of, _ROWS)
    packed = asked.repartition(max(1, -(-asking // TILE_ROWS))).mapInArrow(_packer(TILE_ROWS), _PACKED)
    packed.write.parquet(tiles_stored)
    tiles = spark.read.schema(shards.schema).parquet(tiles_stored)
    n_tiles = tiles.count()
    cores = spark.sparkContext.defaultParallelism
    n_slices = max(1, -(-n_tiles // TILES_PER_SLICE))
    n_groups = max(1, -(-n_shards // SHARDS_PER_GROUP), min(n_shards, -(-2 * cores // n_slices)))
    n_parts = max(1, min(n_slices * n_groups, 8 * cores))
    left = shards.select(
        "dim", "n", "ids", "known", "weights", "data",
        F.pmod(F.xxhash64("number"), F.lit(n_groups)).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"),
    )
    right = tiles.select(
        F.col("number").alias("tile"), "dim", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"),
        F.col("weights").alias("q_weights"), F.col("data").alias("q_data"),
        F.pmod(F.xxhash64("number"), F.lit(n_slices)).cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"),
    )
    cell = ["slice", "group"]
    met = left.repartition(n_parts, *cell).join(right.repartition(n_parts, *cell).hint("merge"), [*cell, "dim"])
    lists = met.mapInArrow(_cell_products(k), _LISTS)
    merge, finish = _merge_lists(k)
    # The check's and AQE's own partition counts may exceed n_parts; the tree covers them all.
    width = max(n_parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while width > FAN_IN:
        parent = F.floor(F.col("part") / FAN_IN).alias("parent")
        lists = lists.groupBy("tile", parent).applyInArrow(merge, _LISTS)
        width = -(-width // FAN_IN)
    return lists.groupBy("tile").applyInArrow(finish, _HITS)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::DOUBLE) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.ints, i.ints) DESC, i.vec_id)::INTEGER AS rank,
  i.vec_id, list_dot_product(q.ints, i.ints)::BIGINT AS score
FROM v q JOIN v i ON q.vec_id <> i.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10"""
