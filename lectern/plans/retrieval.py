"""Question answering retrieval: dense, sparse, fused and reranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators.dense import dense_topk
from lectern.operators.fusion import reciprocal_rank_fusion
from lectern.operators.metrics import gold_matches, retrieval_metrics
from lectern.operators.rerank import rerank
from lectern.operators.sparse import bm25_topk
from lectern.session import bound_batches, reliable_checkpoint

Embed = Callable[[Column], Column]
Score = Callable[[Column, Column], Column]


def with_vectors(texts: DataFrame, key: str, embed: Embed, text: str = "text") -> DataFrame:
    bound_batches(texts.sparkSession)
    return texts.select(key, embed(F.col(text)).alias("vector"))


# Ranked rows are sent to the scan of the items only up to this many; beyond it Spark joins
# by shuffle.
BROADCAST_RANKED = 1_000_000


def with_texts(ranked: DataFrame, questions: DataFrame, items: DataFrame) -> DataFrame:
    """Put question and item texts back beside ranked ids.

    Ranking moves ids and scores only. Its result, k rows per question, is checkpointed and
    counted: within the bound it goes to where the items are scanned, so that only the
    texts that were found leave the scan.
    """
    ranked = reliable_checkpoint(ranked)
    found = F.broadcast(ranked) if ranked.count() <= BROADCAST_RANKED else ranked
    asked = questions.select("query_id", F.col("text").alias("query"))
    return items.select("item_id", "text").join(found, "item_id").join(asked, "query_id")


def hybrid_retrieve(
    questions: DataFrame,
    items: DataFrame,
    embed_query: Embed,
    embed_item: Embed,
    score: Score | None = None,
    breadth: int = fixed.HYBRID_K,
    top_k: int = fixed.HYBRID_TOP_K,
) -> DataFrame:
    """Dense and keyword lists fused by reciprocal rank, reranked if a scorer is given.

    ``questions``: ``query_id, text``; ``items``: ``item_id, text``.
    """
    dense = dense_topk(
        with_vectors(questions, "query_id", embed_query),
        with_vectors(items, "item_id", embed_item),
        breadth,
    )
    sparse = bm25_topk(questions, items, breadth)
    if score is None:
        return reciprocal_rank_fusion([dense, sparse], top_k)
    fused = reciprocal_rank_fusion([dense, sparse], 2 * breadth).drop("score")
    return rerank(with_texts(fused, questions, items), score, top_k).select(
        "query_id", "item_id", "score", "rank"
    )


def evaluate_retrieval(
    questions: DataFrame,
    items: DataFrame,
    gold: DataFrame,
    embed_query: Embed,
    embed_item: Embed,
    score: Score | None = None,
    retrieve_k: int = fixed.RETRIEVE_K,
    k_values: tuple[int, ...] = fixed.K_VALUES,
) -> DataFrame:
    """Hit rate and MRR of dense retrieval, with a second stage if a scorer is given."""
    ranked = dense_topk(
        with_vectors(questions, "query_id", embed_query),
        with_vectors(items, "item_id", embed_item),
        retrieve_k,
    )
    if score is not None:
        ranked = rerank(with_texts(ranked, questions, items), score, max(k_values))
    return retrieval_metrics(questions, gold_matches(ranked, gold), k_values=k_values)
