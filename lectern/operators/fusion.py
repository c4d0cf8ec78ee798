"""Combining ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.vectors import SCORE_DIGITS
from lectern.operators.topk import rank_results


def reciprocal_rank_fusion(
    lists: list[DataFrame],
    k: int,
    query_id: str = "query_id",
    item_id: str = "item_id",
    constant: int = fixed.RRF_K,
) -> DataFrame:
    """Items by the sum of ``1 / (constant + rank)`` over the lists they appear in."""
    ranked = reduce(
        DataFrame.unionByName, [hits.select(query_id, item_id, "rank") for hits in lists]
    )
    share = F.lit(1.0) / (F.lit(constant) + F.col("rank"))
    fused = ranked.groupBy(query_id, item_id).agg(
        F.round(F.sum(share), SCORE_DIGITS).alias("score")
    )
    return rank_results(fused, k, query_id, item_id, "score")
