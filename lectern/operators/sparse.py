"""Keyword search: BM25 of a query set over a text table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lectern.functions import fixed
from lectern.functions.arrays import rows_of
from lectern.functions.vectors import SCORE_DIGITS
from lectern.operators.topk import RunningBest, rank_results
from lectern.session import bound_batches, lean, reliable_checkpoint

# Query terms go to the tasks in slices of about this many, one pass over the texts each.
BROADCAST_TERMS = 200_000
_CELLS = 1 << 19


def words(text: Column) -> Column:
    """Lower-cased words of a text, punctuation left out."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{fixed.W}+"), F.lit(0))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    found = F.array_distinct(words(F.col(text)))
    return rows_of(queries, [query_id], found, "__i", "term").drop("__i")


def bm25_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query_id: str = "query_id",
    item_id: str = "item_id",
    query_text: str = "text",
    item_text: str = "text",
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """The k best items of every query: ``query_id, item_id, score, rank``.

    Only items sharing a word with the query are returned; items and queries whose text is
    NULL do not count at all, empty ones count as items without words. Texts are scored where
    they are scanned: no posting leaves its task, only its k best per query do, and a very
    common word costs no shuffle. Query terms beyond ``broadcast_terms`` are cut into slices
    of whole queries; each slice is searched, and its result stored, before the next is sent.
    """
    bound_batches(items.sparkSession)
    terms = query_terms(queries.filter(F.col(query_text).isNotNull()), query_id, query_text)
    texts = items.filter(F.col(item_text).isNotNull()).select(
        item_id, words(F.col(item_text)).alias("words")
    )
    schema = StructType(
        [queries.schema[query_id], items.schema[item_id], StructField("score", DoubleType())]
    )
    slices = max(1, -(-terms.count() // broadcast_terms))
    hits = None
    for number in range(slices):
        inside = F.pmod(F.xxhash64(query_id), F.lit(slices)) == number
        own = terms if slices == 1 else terms.filter(inside)
        shared, found = _score_in_place(own, texts, k, query_id, item_id, schema)
        if slices > 1:
            found = reliable_checkpoint(rank_results(found, k, query_id, item_id, "score").drop("rank"))
            shared.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    return rank_results(hits, k, query_id, item_id, "score")


def _statistics(terms: DataFrame, texts: DataFrame) -> tuple[dict[str, int], int, float]:
    """Items with each query term, items in all, and their mean number of words."""
    # The empty word stands for the item itself: its row counts the items and their words.
    vocabulary = terms.select("term").distinct().unionByName(
        texts.sparkSession.sql("SELECT '' AS term")
    )
    sized = texts.select(F.size("words").alias("length"), "words")
    with_item = F.array_append(F.array_distinct("words"), F.lit(""))
    found = (
        rows_of(sized, ["length"], with_item, "__i", "term")
        .join(F.broadcast(vocabulary), "term")
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("length").alias("total"))
        .toArrow()
        .to_pylist()
    )
    counts = {row["term"]: row for row in found}
    whole = counts.pop("", {"df": 0, "total": 0})
    average = whole["total"] / whole["df"] if whole["total"] else 1.0
    return {term: row["df"] for term, row in counts.items()}, whole["df"], average


def _score_in_place(terms, texts, k, query_id, item_id, schema):
    df, n_items, average = _statistics(terms, texts)
    weighted = terms.toArrow()
    weighted = weighted.filter(pc.is_in(weighted["term"], value_set=pa.array(list(df), pa.string())))
    query_ids = pc.unique(weighted[query_id])
    query_ids = query_ids.take(pc.sort_indices(query_ids))
    all_terms = pc.unique(weighted["term"])
    term_of = pc.index_in(weighted["term"], all_terms).to_numpy().astype(np.int64)
    query_of = pc.index_in(weighted[query_id], query_ids).to_numpy().astype(np.int64)
    idf = np.array(
        [math.log(1.0 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) for t in all_terms.to_pylist()]
    )
    # Queries of every term, one after the other.
    order = np.argsort(term_of, kind="stable")
    starts = np.searchsorted(term_of[order], np.arange(len(all_terms) + 1))
    shared = texts.sparkSession.sparkContext.broadcast(
        (query_ids, all_terms, query_of[order], starts, idf)
    )
    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, all_terms, queries, starts, idf = shared.value
        if len(query_ids) == 0:
            return
        best = RunningBest(len(query_ids), k)
        for batch in batches:
            ids, lists = batch.column(item_id), batch.column("words")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            index = pc.index_in(lists.flatten(), all_terms)
            present = np.asarray(pc.is_valid(index))
            row = np.repeat(np.arange(len(ids)), sizes)[present]
            term = index.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            # Matched terms of every item with their frequency, then the queries of each.
            found, tf = np.unique(row * len(all_terms) + term, return_counts=True)
            row, term = found // len(all_terms), found % len(all_terms)
            length = fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * sizes[row] / average)
            gain = idf[term] * tf * (fixed.BM25_K1 + 1) / (tf + length)
            fan = starts[term + 1] - starts[term]
            done = np.cumsum(fan)
            low = 0
            while low < len(row):
                # Whole items, about a bounded number of (query, item) additions at a time.
                base = done[low - 1] if low else 0
                high = int(np.searchsorted(done, base + _CELLS, "right"))
                high = max(high, low + 1)
                high = int(np.searchsorted(row, row[high - 1], "right")) if high < len(row) else high
                part = slice(low, high)
                total = int(fan[part].sum())
                within = np.arange(total) - np.repeat(np.cumsum(fan[part]) - fan[part], fan[part])
                asked = queries[np.repeat(starts[term[part]], fan[part]) + within]
                pair = asked * len(ids) + np.repeat(row[part], fan[part])
                pairs, place = np.unique(pair, return_inverse=True)
                scores = np.round(np.bincount(place, weights=np.repeat(gain[part], fan[part])), SCORE_DIGITS)
                keep = scores > 0
                best.add(
                    pairs[keep] // len(ids), ids.take(pa.array(pairs[keep] % len(ids))), scores[keep]
                )
                low = high
        if best.parts:
            rows, found, scores = best.result()
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(rows)), found, pa.array(scores)], names=names
            )

    return shared, texts.mapInArrow(lean(scan), schema)
