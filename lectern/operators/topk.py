"""Exact best-k selection: inside batches with numpy, across tasks with a window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_per_query(scores: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best entries of every row, ties by ``order``.

    ``scores`` is queries x items, ``-inf`` marking items that are no candidates; ``order``
    ranks the items by id.
    """
    n = scores.shape[1]
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > k:
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        keep = scores >= floor
    else:
        keep = np.ones(scores.shape, bool)
    keep &= scores > -np.inf
    rows, cols = np.nonzero(keep)
    by = np.lexsort((order[cols], -scores[rows, cols], rows))
    rows, cols = rows[by], cols[by]
    return _head(rows, k), cols[_head_mask(rows, k)]


def _head_mask(rows: np.ndarray, k: int) -> np.ndarray:
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.zeros(0, np.int64)
    first = np.zeros(len(rows), np.int64)
    first[starts] = starts
    return np.arange(len(rows)) - np.maximum.accumulate(first) < k if len(rows) else first.astype(bool)


def _head(rows: np.ndarray, k: int) -> np.ndarray:
    return rows[_head_mask(rows, k)]


class RunningBest:
    """The k best items per query seen so far by one task.

    ``floor`` is a score that the k best of a query are known to reach, ``-inf`` until then.
    """

    def __init__(self, n_queries: int, k: int):
        self.k, self.bound = k, max(2 * n_queries * k, 1 << 16)
        self.floor = np.full(n_queries, -np.inf)
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.held = 0

    def add(self, rows: np.ndarray, ids: pa.Array, scores: np.ndarray) -> None:
        if not len(rows):
            return
        self.parts.append((rows, ids, scores))
        self.held += len(rows)
        if self.held > self.bound:
            self.parts = [self.result()]
            self.held = len(self.parts[0][0])
            self.raise_floor(self.parts[0][0], self.parts[0][2])

    def raise_floor(self, rows: np.ndarray, scores: np.ndarray) -> None:
        """Take the least of k scores of a query as its floor; both are sorted, best first."""
        last = np.flatnonzero(np.r_[rows[1:] != rows[:-1], True]) if len(rows) else rows
        last = last[np.diff(np.r_[-1, last]) >= self.k]
        self.floor[rows[last]] = np.maximum(self.floor[rows[last]], scores[last])

    def result(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        rows = np.concatenate([p[0] for p in self.parts])
        ids = pa.concat_arrays([p[1] for p in self.parts])
        scores = np.concatenate([p[2] for p in self.parts])
        by = np.lexsort((id_order(ids), -scores, rows))
        by = by[_head_mask(rows[by], self.k)]
        return rows[by], ids.take(pa.array(by)), scores[by]


def id_order(ids: pa.Array) -> np.ndarray:
    """Rank of every id in ascending order (equal ids in any order)."""
    by = np.asarray(pc.sort_indices(ids))
    order = np.empty(len(by), np.int64)
    order[by] = np.arange(len(by))
    return order


def rank_results(hits: DataFrame, k: int, query_id: str, item_id: str, score: str) -> DataFrame:
    """Keep the k best rows per query and number them from 1.

    The window group limit runs before the shuffle too, so each map task sends at most k
    rows per query.
    """
    by = Window.partitionBy(query_id).orderBy(F.desc_nulls_last(score), F.asc(item_id))
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
