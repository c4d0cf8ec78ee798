"""Retrieval quality against gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed


def normalise_gold(items: DataFrame) -> DataFrame:
    """Bring the three forms of evaluation items to ``question, gold_chunk_ids``.

    Accepted: ``gold_chunk_ids`` (array); ``chunk_id`` (string); ``Question`` with
    ``Gold_chunk_id`` (string, array, or the JSON text of either).
    """
    names = set(items.columns)

    def gold(name: str) -> Column | None:
        if name not in names:
            return None
        if items.schema[name].dataType.typeName() == "array":
            return F.col(name)
        text = F.col(name)
        listed = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))
        return F.coalesce(listed, F.when(text.isNotNull(), F.array(text)))

    found = [c for c in map(gold, ("gold_chunk_ids", "Gold_chunk_id", "chunk_id")) if c is not None]
    asked = [F.col(name) for name in ("question", "Question") if name in names]
    # Spark resolves names without regard to case unless told otherwise.
    return items.withColumns(
        {"question": F.coalesce(*asked[:1]), "gold_chunk_ids": F.coalesce(*found)}
    )


def gold_matches(ranked: DataFrame, gold: DataFrame, query_id: str = "query_id", item_id: str = "item_id") -> DataFrame:
    """Ranked rows whose item is gold for its query.

    ``ranked`` is small (k rows per query); gold may be large, so it only takes part in a
    semi join and is never gathered per query.
    """
    return ranked.join(gold.select(query_id, item_id), [query_id, item_id], "left_semi")


def retrieval_metrics(
    questions: DataFrame,
    matches: DataFrame,
    query_id: str = "query_id",
    k_values: tuple[int, ...] = fixed.K_VALUES,
) -> DataFrame:
    """``k, hit_rate, mrr`` over all questions, those without any gold item included.

    ``matches`` holds the ranked rows that are gold; the lowest rank counts. No rows when
    there are no questions.
    """
    hits = (
        matches.filter(F.col("rank") <= max(k_values))
        .groupBy(query_id)
        .agg(F.min("rank").alias("hit_rank"))
    )
    joined = questions.select(query_id).join(hits, query_id, "left")
    sums = [F.count("*").alias("n")]
    for k in k_values:
        inside = F.col("hit_rank") <= k
        sums.append(F.count_if(inside).alias(f"hits_{k}"))
        sums.append(
            F.sum(F.when(inside, F.lit(1.0) / F.col("hit_rank")).otherwise(0.0)).alias(f"mrr_{k}")
        )
    entries = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                (F.col(f"hits_{k}") / F.col("n")).alias("hit_rate"),
                (F.col(f"mrr_{k}") / F.col("n")).alias("mrr"),
            )
            for k in k_values
        ]
    )
    return joined.agg(*sums).filter("n > 0").select(F.explode(entries).alias("e")).select("e.*")
