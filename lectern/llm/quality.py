"""Quality rules with thresholds that adapt to each language and source.

Every document gets word, symbol, line and repetition counts, all from array expressions in
its own row. Thresholds are quantiles from Spark's mergeable quantile summaries
(``percentile_approx``: partial summaries per task, merged per group, so a group of any size
is never brought together), one set per ``(lang, source)``. The upper fence of a measure is

    q75 + reach * max(q75 - q25, q95 - q75, the same spread over all documents)

and the lower fence its mirror. The spread over all documents keeps a small or very even
group from a fence of no width. A document goes if it fails the base rule or lies outside a
fence of its group; fences are joined to the documents by language and source.

Defined results: a null text has no words and fails the base rule; null languages and sources
are groups of their own; documents without words set no thresholds; texts of any length are counted whole; repeated rows count as
often as they occur; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import bind
from lectern.session import reliable_checkpoint

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REACH = 3.0
ACCURACY = 10_000
WINDOW = 3
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_NOT_SYMBOL = r"[^#*$%&|<>]+"

UPPER = ("word_length", "symbol_share", "dup_line_share", "repeat_share")
LOWER = ("word_length",)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more.

    Windows are compared by their 64-bit hash. Only a text with a repeated window sorts them:
    neighbours with equal hashes give the repeated positions, and each position adds the
    words its window does not share with the previous one.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(rows: Column) -> Column:
            repeated = F.filter(
                rows,
                lambda r, i: (F.get(rows, i - 1)["h"] == r["h"]) | (F.get(rows, i + 1)["h"] == r["h"]),
            )
            return F.sort_array(F.transform(repeated, lambda r: r["i"]))

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            bind(placed, positions),
            start,
            lambda acc, p: F.struct(
                p.alias("last"),
                (acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total"),
            ),
            lambda acc: acc["total"],
        )

    windows = F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        F.lit(1),
        F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)),
    )
    return bind(
        windows,
        lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            covered(hashes)
        ),
    )


def _measures(text: Column) -> Column:
    """Struct of the counts of one text."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    from_words = bind(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    from_lines = bind(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    symbols = F.length(F.regexp_replace(text, _NOT_SYMBOL, "")).cast("long")
    return F.struct(
        from_words.alias("words"), from_lines.alias("lines"), symbols.alias("n_symbols")
    )


def document_measures(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang``, ``source`` and the counts and shares of every document."""
    counted = docs.select(
        *keep,
        F.col("lang").alias("__lang"),
        F.col("source").alias("__source"),
        _measures(F.coalesce(F.col("text"), F.lit(""))).alias("__m"),
    )
    words, lines = F.col("__m.words"), F.col("__m.lines")
    n_words, n_lines = words["n_words"], lines["n_lines"]
    return counted.select(
        *keep,
        "__lang",
        "__source",
        n_words.alias("n_words"),
        words["word_chars"].alias("word_chars"),
        F.col("__m.n_symbols").alias("n_symbols"),
        lines["n_dup_lines"].alias("n_dup_lines"),
        words["n_repeat_words"].alias("n_repeat_words"),
        F.when(n_words > 0, words["word_chars"] / n_words).alias("word_length"),
        F.when(n_words > 0, F.col("__m.n_symbols") / words["word_chars"]).alias("symbol_share"),
        F.when(n_lines > 0, lines["n_dup_lines"] / n_lines).alias("dup_line_share"),
        F.when(n_words > 0, words["n_repeat_words"] / n_words).alias("repeat_share"),
    )


def _quantiles(rows: DataFrame, keys: Sequence[str], accuracy: int) -> DataFrame:
    points = [0.05, 0.25, 0.75, 0.95]
    return rows.groupBy(*keys).agg(
        *[F.percentile_approx(name, points, accuracy).alias(f"q_{name}") for name in UPPER]
    )


def adaptive_fences(
    measures: DataFrame, reach: float = REACH, accuracy: int = ACCURACY
) -> DataFrame:
    """``(__lang, __source, high_*, low_*)``: the fences of every language and source."""

    def spread(q: str, upper: bool) -> Column:
        inner = F.get(q, 2) - F.get(q, 1)
        outer = F.get(q, 3) - F.get(q, 2) if upper else F.get(q, 1) - F.get(q, 0)
        return F.greatest(inner, outer)

    groups = _quantiles(measures, ["__lang", "__source"], accuracy)
    overall = _quantiles(measures, [], accuracy).select(
        *[spread(f"q_{n}", True).alias(f"up_{n}") for n in UPPER],
        *[spread(f"q_{n}", False).alias(f"down_{n}") for n in LOWER],
    )
    both = groups.join(F.broadcast(overall))  # one row
    return both.select(
        "__lang",
        "__source",
        *[
            (F.get(f"q_{n}", 2) + reach * F.greatest(spread(f"q_{n}", True), f"up_{n}")).alias(
                f"high_{n}"
            )
            for n in UPPER
        ],
        *[
            (F.get(f"q_{n}", 1) - reach * F.greatest(spread(f"q_{n}", False), f"down_{n}")).alias(
                f"low_{n}"
            )
            for n in LOWER
        ],
    )


def quality_rules(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    reach: float = REACH,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document, beside the columns in ``keep``.

    The counts are stored once (narrow rows, no texts) in the shared folder and read for the
    thresholds and for the verdict.
    """
    measures = reliable_checkpoint(document_measures(docs, keep))
    fences = adaptive_fences(measures, reach, accuracy).select(
        F.col("__lang").alias("__fence_lang"),
        F.col("__source").alias("__fence_source"),
        *[f"high_{n}" for n in UPPER],
        *[f"low_{n}" for n in LOWER],
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    outside = F.lit(False)
    for name in UPPER:
        outside = outside | F.coalesce(F.col(name) > F.col(f"high_{name}"), F.lit(False))
    for name in LOWER:
        outside = outside | F.coalesce(F.col(name) < F.col(f"low_{name}"), F.lit(False))
    joined = measures.join(
        fences,
        F.col("__lang").eqNullSafe(F.col("__fence_lang"))
        & F.col("__source").eqNullSafe(F.col("__fence_source")),
        "left",
    )
    return joined.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~outside).alias("kept"),
    )
