"""Second-stage ranking of retrieved candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.models import rerank_prompt, yes_probability
from lectern.functions.vectors import sigmoid


def rerank(
    candidates: DataFrame,
    score: Callable[[Column, Column], Column],
    top_k: int = max(fixed.K_VALUES),
    query_id: str = "query_id",
    query: str = "query",
    text: str = "text",
) -> DataFrame:
    """Order each query's candidates by ``score(query, text)`` and keep the best.

    ``candidates`` carry their first-stage ``rank``; equal scores keep that order. The
    costly scorer sees only the candidates that first stage kept.
    """
    scored = candidates.withColumn("score", score(F.col(query), F.col(text)))
    by = Window.partitionBy(query_id).orderBy(F.desc_nulls_last("score"), F.asc("rank"))
    return (
        scored.withColumn("__rank", F.row_number().over(by))
        .filter(F.col("__rank") <= top_k)
        .withColumn("rank", F.col("__rank"))
        .drop("__rank")
    )


def rerank_by_answer(
    candidates: DataFrame,
    ask: Callable[[Column], Column],
    top_k: int = max(fixed.K_VALUES),
    task: str = fixed.RERANK_TASK,
    **names: str,
) -> DataFrame:
    """Order candidates by the probability that a model answers "yes" to the prompt.

    ``ask`` takes prompts and returns the logits of both answers
    (``functions.models.answer_logits``).
    """

    def score(query: Column, text: Column) -> Column:
        logits = ask(rerank_prompt(query, text, task))
        return yes_probability(logits["no"], logits["yes"])

    return rerank(candidates, score, top_k, **names)


def rerank_by_logit(
    candidates: DataFrame,
    logit: Callable[[Column, Column], Column],
    top_k: int = max(fixed.K_VALUES),
    **names: str,
) -> DataFrame:
    """Order candidates by a cross-encoder's relevance, the sigmoid of its logit."""
    return rerank(candidates, lambda query, text: sigmoid(logit(query, text)), top_k, **names)
