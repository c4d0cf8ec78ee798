"""Token-length profiles and value frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.text import TokenCounter, count_tokens, count_words


def token_counts(texts: DataFrame, text: str = "text", counter: TokenCounter = count_tokens) -> DataFrame:
    """Length measures and limit flags of every text."""
    others = [name for name in texts.columns if name != text]
    measured = texts.select(
        *others,
        F.length(text).alias("characters"),
        count_words(F.col(text)).alias("words_approx"),
        counter(F.col(text)).alias("tokens"),
    )
    return measured.select(
        "*",
        (F.col("tokens") > fixed.MODEL_MAX_TOKENS).alias("exceeds_2048"),
        (F.col("tokens") > fixed.SAFE_TOKENS).alias("exceeds_safe_limit"),
    )


def token_histogram(counts: DataFrame) -> DataFrame:
    """How many texts have each token count.

    Every statistic below is computed from this table: its size is the number of distinct
    lengths, not of texts, so the final one-row aggregates stay small at any scale.
    """
    return counts.groupBy("tokens").agg(F.count("*").alias("n"))


def token_distribution(counts: DataFrame) -> DataFrame:
    """Minimum, percentiles, maximum, mean and sample deviation, exact, in one row."""
    t, n = F.col("tokens").cast("decimal(19,0)"), F.col("n").cast("decimal(19,0)")
    grid = F.array(*[F.lit(float(p)) for p in fixed.TOKEN_PERCENTILES])
    moments = token_histogram(counts).agg(
        F.min("tokens").cast("double").alias("minimum"),
        F.percentile("tokens", grid, F.col("n")).alias("p"),
        F.max("tokens").cast("double").alias("maximum"),
        F.sum("n").alias("total"),
        F.sum(t * n).cast("double").alias("s1"),
        F.sum((t * t * n).cast("decimal(38,0)")).alias("s2"),
        F.sum((t * n).cast("decimal(38,0)")).alias("s1_exact"),
    )
    names = ("p1", "p5", "p10", "p25", "median", "p75", "p90", "p95", "p99")
    total = F.col("total").cast("double")
    spread = (F.col("s2") * F.col("total") - F.col("s1_exact") * F.col("s1_exact")).cast("double")
    return moments.filter("total > 0").select(
        "minimum",
        *[F.col("p")[i].alias(name) for i, name in enumerate(names)],
        "maximum",
        (F.col("s1") / total).alias("mean"),
        F.when(F.col("total") > 1, F.sqrt(spread / (total * (total - 1)))).alias("standard_deviation"),
    )


def token_thresholds(
    counts: DataFrame, thresholds: tuple[int, ...] = fixed.TOKEN_THRESHOLDS
) -> DataFrame:
    """Number and share of texts within each threshold."""
    within = [
        F.sum(F.when(F.col("tokens") <= limit, F.col("n")).otherwise(0)).alias(f"t{limit}")
        for limit in thresholds
    ]
    totals = token_histogram(counts).agg(F.sum("n").alias("total"), *within)
    entries = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n_texts")) for t in thresholds]
    )
    return (
        totals.filter("total > 0")
        .select("total", F.explode(entries).alias("e"))
        .select(
            "e.threshold", "e.n_texts", (F.col("e.n_texts") / F.col("total") * 100).alias("percentage")
        )
    )


def recommended_limit(p95: Column) -> Column:
    chosen = F.when(p95 <= fixed.RECOMMENDED_LIMITS[0], fixed.RECOMMENDED_LIMITS[0])
    for limit in fixed.RECOMMENDED_LIMITS[1:]:
        chosen = chosen.when(p95 <= limit, limit)
    return chosen.otherwise(fixed.RECOMMENDED_FALLBACK)


def token_recommendation(counts: DataFrame) -> DataFrame:
    """Suggested chunk limit from the 95th percentile, with the margin to the model's."""
    limit = recommended_limit(F.col("p95"))
    return token_distribution(counts).select(
        "p90",
        "p95",
        limit.alias("recommendation"),
        (F.lit(fixed.MODEL_MAX_TOKENS) - limit).alias("safety_margin"),
    )


def largest_texts(counts: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The longest texts (a top-k report), ties by key."""
    return (
        counts.orderBy(F.desc("tokens"), key)
        .limit(n)
        .select(key, "tokens", "characters", "exceeds_2048")
    )


def most_common(values: DataFrame, value: Column, position: Column, n: int) -> DataFrame:
    """The most frequent values (a top-k report); ties by first occurrence."""
    return (
        values.groupBy(value.alias("value"))
        .agg(F.count("*").alias("n"), F.min(position).alias("first_at"))
        .orderBy(F.desc("n"), "first_at")
        .limit(n)
    )


def text_sample(text: Column, chars: int = 800) -> Column:
    """Opening of a text, to be looked at."""
    return F.substring(text, 1, chars)
