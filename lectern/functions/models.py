"""Extension points for models: embedding and scoring inside Spark tasks.

A model is handed over as a factory. It runs once per Python worker, on first use, so a
model file is loaded by the workers and never travels with the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType

from lectern.functions import fixed

EmbedModel = Callable[[list[str], str], np.ndarray]
ScoreModel = Callable[[list[str], list[str]], np.ndarray]


def embedder(load: Callable[[], EmbedModel], mode: str, batch: int = 32) -> Callable[[Column], Column]:
    """Column function that embeds texts with a loaded model.

    ``mode`` is ``document`` or ``query`` and is passed on as the prompt name. A blank text
    fails the job, whichever it is.
    """

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            if not texts.fillna("").str.strip().astype(bool).all():
                raise ValueError(f"{mode} text must be a non-empty string")
            vectors: list[list[float]] = []
            for start in range(0, len(texts), batch):
                part = texts.iloc[start : start + batch].tolist()
                vectors.extend(np.asarray(model(part, mode), dtype=np.float32).tolist())
            yield pd.Series(vectors, index=texts.index, dtype=object)

    return embed


class ModelCounter:
    """Token counter that asks a loaded tokenizer, for packing and profiles.

    The tokenizer takes a list of texts and returns their numbers of tokens. ``counter(text)``
    counts a column of texts, ``counter.each(texts)`` a column of lists; a null text is not
    sent and counts null. Equal texts of a batch are counted once.
    """

    # Whether a text's count is the sum of its lines' counts; not so for most tokenizers.
    additive = False

    def __init__(self, load: Callable[[], Callable[[list[str]], list[int]]], batch: int = 1024):
        def counted(model, texts: list) -> list:
            known = dict.fromkeys(t for t in texts if t is not None)
            wanted = list(known)
            for start in range(0, len(wanted), batch):
                part = wanted[start : start + batch]
                known.update(zip(part, map(int, model(part)), strict=True))
            return [None if t is None else known[t] for t in texts]

        @F.pandas_udf(IntegerType())
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series(counted(model, texts.tolist()), index=texts.index, dtype="Int32")

        @F.pandas_udf(ArrayType(IntegerType()))
        def count_each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for lists in batches:
                flat = counted(model, [t for row in lists if row is not None for t in row])
                out, at = [], 0
                for row in lists:
                    size = 0 if row is None else len(row)
                    out.append(None if row is None else flat[at : at + size])
                    at += size
                yield pd.Series(out, index=lists.index, dtype=object)

        # Called so, a count is a step of its own: the optimizer would otherwise write it anew
        # at each of its uses, inside expressions over elements too, where it cannot run.
        self._count, self._count_each = count, count_each.asNondeterministic()

    def __call__(self, text: Column) -> Column:
        return self._count(text)

    def each(self, texts: Column) -> Column:
        return self._count_each(texts)


def scorer(
    load: Callable[[], ScoreModel], batch: int = fixed.RERANK_BATCH
) -> Callable[[Column, Column], Column]:
    """Column function that scores ``(query, text)`` pairs with a loaded model."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            scores: list[float] = []
            for start in range(0, len(queries), batch):
                stop = start + batch
                scores.extend(
                    float(s)
                    for s in model(queries.iloc[start:stop].tolist(), texts.iloc[start:stop].tolist())
                )
            yield pd.Series(scores, index=queries.index, dtype="float64")

    return score


def answer_logits(
    load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = fixed.RERANK_BATCH
) -> Callable[[Column], Column]:
    """Column function that asks a loaded model; a struct of the logits of ``no`` and ``yes``.

    The model takes prompts and returns two columns. Prompts reach it whole: what a model
    cannot read is its own to cut.
    """

    @F.pandas_udf("no double, yes double")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for prompts in batches:
            parts = [
                np.asarray(model(prompts.iloc[start : start + batch].tolist()), dtype=np.float64)
                for start in range(0, len(prompts), batch)
            ]
            logits = np.concatenate(parts) if parts else np.zeros((0, 2))
            yield pd.DataFrame(logits, columns=["no", "yes"], index=prompts.index)

    return ask


def rerank_prompt(query: Column, text: Column, task: str = fixed.RERANK_TASK) -> Column:
    """Prompt a yes/no reranking model is asked with."""
    return F.format_string(fixed.RERANK_PROMPT, F.lit(task), query, text)


def yes_probability(no_logit: Column, yes_logit: Column) -> Column:
    """Softmax over the two answers, the share of "yes"."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(no_logit - yes_logit))
