"""Exact cosine search of a query set over a vector table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lectern.functions.vectors import SCORE_DIGITS, matrix, unit_rows
from lectern.operators.topk import RunningBest, _head_mask, best_per_query, id_order, rank_results
from lectern.session import bound_batches, lean, reliable_checkpoint

# Queries go to the tasks in slices of about this size, one pass over the items each.
BROADCAST_BYTES = 16 << 20
_TILE = 1 << 10
_CELLS = 1 << 20
_SLACK = 10.0 ** -SCORE_DIGITS


def few_copies(items: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Places without the copies of a vector that k copies with smaller ids precede.

    Copies tie with every query, so those are among no query's k best.
    """
    if len(items) <= k or not items.shape[1]:
        return np.arange(len(items))
    raw = np.ascontiguousarray(items).view(np.dtype((np.void, items.shape[1] * items.itemsize)))[:, 0]
    _, vector = np.unique(raw, return_inverse=True)
    by = np.lexsort((id_order(ids), vector))
    return np.sort(by[_head_mask(vector[by], k)])


def search_block(
    queries: np.ndarray, places: np.ndarray, items: np.ndarray, ids: pa.Array, best: RunningBest, k: int
) -> None:
    """Fold a block of items of length 1 into the running best of the queries at ``places``.

    Tiles of queries meet tiles of items in matrix products. Once k items of a query are
    known, only scores that reach its floor are looked at any further.
    """
    step = max(1, _CELLS // max(1, min(len(queries), _TILE)))
    for start in range(0, len(items), step):
        block, part = items[start : start + step], ids.slice(start, step)
        for low in range(0, len(queries), _TILE):
            own = places[low : low + _TILE]
            scores = queries[low : low + _TILE] @ block.T
            floor = best.floor[own]
            if (floor > -np.inf).all():
                rows, cols = np.nonzero(scores >= floor[:, None] - _SLACK)
                values = np.round(scores[rows, cols], SCORE_DIGITS)
            else:
                scores = np.round(scores, SCORE_DIGITS)
                scores = np.where(np.isnan(scores), -np.inf, scores)
                rows, cols = best_per_query(scores, id_order(part), k)
                values = scores[rows, cols]
                best.raise_floor(own[rows], values)
            best.add(own[rows], part.take(pa.array(cols)), values)


def _search(
    queries: np.ndarray, places: np.ndarray, items: np.ndarray, ids: pa.Array, best: RunningBest, k: int
) -> None:
    few = few_copies(items, ids, k)
    search_block(queries, places, unit_rows(items[few]), ids.take(pa.array(few)), best, k)


def _labels(column: pa.Array | pa.ChunkedArray) -> dict:
    """Places of every label; rows without one are in no group."""
    groups: dict = {}
    for place, label in enumerate(column.to_pylist()):
        if label is not None:
            groups.setdefault(label, []).append(place)
    return {label: np.array(places) for label, places in groups.items()}


def query_slices(
    queries: DataFrame, query_id: str, vector: str, extra: list[str], broadcast_bytes: int = BROADCAST_BYTES
) -> list[DataFrame]:
    """The queries, cut by a hash of their id into parts of about ``broadcast_bytes``."""
    own = F.coalesce(F.sum(F.size(vector)), F.lit(0)) * 8
    for name in (query_id, *extra):
        own = own + F.coalesce(F.sum(F.octet_length(F.col(name).cast("string"))), F.lit(0)) + 16 * F.count("*")
    slices = max(1, -(-queries.agg(own.alias("bytes")).first()["bytes"] // broadcast_bytes))
    if slices == 1:
        return [queries]
    part = F.pmod(F.xxhash64(query_id), F.lit(slices))
    return [queries.filter(part == number) for number in range(slices)]


def dense_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query_id: str = "query_id",
    item_id: str = "item_id",
    vector: str = "vector",
    within: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The k most similar items of every query: ``query_id, item_id, similarity, rank``.

    Every query is compared with every item by block matrix products inside the tasks; only
    the k best per task and query leave it, and the items stay where they are scanned, with
    no shuffle of vectors. Queries beyond ``broadcast_bytes`` (vectors, ids and labels,
    measured) are cut into slices; each slice is searched, and its result stored, before the
    next is sent. ``within`` names a column whose value must be equal on both sides: items of
    a label only meet that label's queries. Items with a zero vector have no similarity and
    are not returned. Vectors of unequal size are an error.
    """
    extra = [within] if within else []
    # The query vectors may come from a model: they are computed once and kept.
    queries = reliable_checkpoint(queries.select(query_id, vector, *extra))
    queries = queries.filter(F.col(vector).isNotNull())
    items = items.select(item_id, vector, *extra)
    schema = StructType(
        [queries.schema[query_id], items.schema[item_id], StructField("similarity", DoubleType())]
    )
    bound_batches(items.sparkSession)
    parts = query_slices(queries, query_id, vector, extra, broadcast_bytes)
    hits = None
    for part in parts:
        shared, found = _scan(part, items, k, query_id, item_id, vector, within, schema)
        if len(parts) > 1:
            found = reliable_checkpoint(
                rank_results(found, k, query_id, item_id, "similarity").drop("rank")
            )
            shared.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    return rank_results(hits, k, query_id, item_id, "similarity")


def _scan(queries, items, k, query_id, item_id, vector, within, schema):
    """One slice of queries over all items."""
    table = queries.toArrow()
    if within:
        table = table.sort_by(within)
    ids = table[query_id].combine_chunks()
    shared = items.sparkSession.sparkContext.broadcast(
        (ids, unit_rows(matrix(table[vector], ids)), _labels(table[within]) if within else None)
    )
    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, groups = shared.value
        if len(ids) == 0:
            return
        best = RunningBest(len(ids), k)
        # A zero vector is similar to nothing.
        best.floor[np.isnan(vectors).any(axis=1)] = np.inf
        for batch in batches:
            # A filter before this stage would compute the vectors a second time.
            batch = batch.filter(pc.is_valid(batch.column(vector)))
            if not batch.num_rows:
                continue
            found_in = batch.column(item_id)
            rows = matrix(batch.column(vector), found_in, vectors.shape[1])
            if groups is None:
                _search(vectors, np.arange(len(ids)), rows, found_in, best, k)
                continue
            for label, places in _labels(batch.column(within)).items():
                asked = groups.get(label)
                if asked is not None:
                    # Queries stand by label, so those of one are a slice and no copy.
                    _search(vectors[asked[0] : asked[-1] + 1], asked, rows[places], found_in.take(pa.array(places)), best, k)
        if best.parts:
            rows, found, scores = best.result()
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), found, pa.array(scores)], names=names
            )

    return shared, items.mapInArrow(lean(scan), schema)
