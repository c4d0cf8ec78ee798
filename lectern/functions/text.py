"""String expressions with Python's Unicode rules, evaluated inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lectern.functions import fixed

TokenCounter = Callable[[Column], Column]


def count_tokens(text: Column) -> Column:
    """Default token counter: runs of word characters and single other marks."""
    return F.regexp_count(text, F.lit(fixed.TOKEN)).cast("int")


def tokens(text: Column) -> Column:
    """Lower-cased tokens, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """``str.strip()``: trims every Unicode blank, not only the space."""
    return F.regexp_replace(text, rf"^{fixed.S}+|{fixed.S}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{fixed.S}+$", "")


def collapse(text: Column) -> Column:
    """Every run of blanks becomes one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, rf"{fixed.S}+", " "))


def count_words(text: Column) -> Column:
    """``len(text.split())``."""
    return F.regexp_count(text, F.lit(rf"{fixed.NOT_S}+")).cast("int")


def split_lines(text: Column) -> Column:
    """``str.splitlines()``: no empty entry after a final line break."""
    body = F.regexp_replace(text, rf"(?:{fixed.LINE_BREAK})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, fixed.LINE_BREAK, -1)
    )


def clean_text(text: Column) -> Column:
    """Right-trim each line, squeeze runs of blank lines to one, trim the whole."""
    trimmed = F.regexp_replace(text, rf"(?m){fixed.S_BUT_NEWLINE}+$", "")
    return strip(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    """Blank-line separated blocks, trimmed, without empty ones."""
    parts = F.transform(F.split(text, rf"\n{fixed.S}*\n", -1), strip)
    return F.filter(parts, lambda part: part != "")


def block_lines(text: Column) -> Column:
    """Lines of a block, trimmed, without empty ones."""
    return F.filter(F.transform(split_lines(text), strip), lambda line: line != "")


def sentence_units(text: Column) -> Column:
    """Sentence-like units long enough to carry an answer."""
    pieces = F.transform(F.split(text, fixed.UNIT_SPLIT, -1), collapse)
    return F.filter(
        pieces,
        lambda unit: (F.length(unit) >= fixed.UNIT_MIN_CHARS) & ~unit.rlike(fixed.UNIT_JUNK),
    )


def short_numeric_lines(text: Column) -> Column:
    """Number of short lines that hold a digit: a rough sign of tables."""
    return F.size(
        F.filter(
            F.split(text, "\n", -1),
            lambda line: line.rlike(fixed.DIGIT) & (F.length(strip(line)) < 40),
        )
    )


def python_round1(value: Column) -> Column:
    """``round(x, 1)`` exactly as Python does it.

    Python rounds the exact binary value, ties to even. ``x * 10`` is taken together
    with its exact rounding error (two-product), so values such as 6.55, whose binary
    form lies just below the tie, fall on the correct side.
    """
    split = F.lit(134217729.0) * value
    high = split - (split - value)
    low = value - high
    scaled = value * F.lit(10.0)
    error = (high * F.lit(10.0) - scaled) + low * F.lit(10.0)
    base = F.floor(scaled).cast("double")
    offset = (scaled - base) - F.lit(0.5)
    even = base % F.lit(2.0) == 0
    up = (offset > 0) | ((offset == 0) & ((error > 0) | ((error == 0) & ~even)))
    return (base + F.when(up, 1.0).otherwise(0.0)) / F.lit(10.0)


# --------------------------------------------------------------------------------------
# Normalisation: compatibility composition, blanks to one space, full case folding.
# --------------------------------------------------------------------------------------

_INLINE_EXPANSIONS = {"ß": "ss", "…": "..."}
_PLAIN_PUNCTUATION = "‐–—‘’“”•€●"


def _fold(text: str) -> str:
    composed = unicodedata.normalize("NFKC", text)
    return " ".join(composed.split()).casefold()


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str]:
    """A translate pair for characters that fold one to one, and a class for the rest.

    Built by rule from the Unicode data over the Latin blocks: such a character folds to
    exactly one character and neither combines nor composes, so it can be mapped alone.
    A text with any other character takes the Python path.
    """
    easy = [chr(point) for point in range(0x180)] + list(_PLAIN_PUNCTUATION)
    source, target, allowed = [], [], []
    for char in easy:
        folded = unicodedata.normalize("NFKC", char).casefold()
        if char in _INLINE_EXPANSIONS or len(folded) != 1:
            continue
        allowed.append(ord(char))
        if folded != char and not char.isspace():
            source.append(char)
            target.append(folded)
    allowed += [ord(char) for char in _INLINE_EXPANSIONS]
    spans: list[list[int]] = []
    for point in sorted(allowed):
        if spans and point == spans[-1][1] + 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    ranges = "".join(rf"\x{{{first:x}}}-\x{{{last:x}}}" for first, last in spans)
    return "".join(source), "".join(target), f"[^{ranges}]"


# Latin-1 characters that do not fold alone, and all beyond: a quick first test.
_BEYOND_LATIN = r"[\xa8\xaf\xb4\xb8\xbc\xbd\xbe\x{100}-\x{10ffff}]"


def needs_python_fold(text: Column) -> Column:
    return text.rlike(_BEYOND_LATIN) & text.rlike(_fold_tables()[2])


def _native_fold(text: Column) -> Column:
    source, target, _ = _fold_tables()
    for char, expansion in _INLINE_EXPANSIONS.items():
        text = F.replace(text, F.lit(char), F.lit(expansion))
    return collapse(F.translate(text, source, target))


@F.pandas_udf(StringType())
def _fold_series(texts: pd.Series) -> pd.Series:
    return texts.map(_fold, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _fold_lists(lists: pd.Series) -> pd.Series:
    return lists.map(lambda items: [_fold(item) for item in items], na_action="ignore")


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _fold_nested(rows: pd.Series) -> pd.Series:
    return rows.map(lambda lists: [[_fold(item) for item in items] for items in lists], na_action="ignore")


def normalise(text: Column) -> Column:
    """Comparison form of a text.

    Computed in the JVM by a character mapping; only texts that hold combining or
    expanding characters are sent to a Python worker (others travel as NULL).
    """
    hard = needs_python_fold(text)
    return F.coalesce(_fold_series(F.when(hard, text)), _native_fold(text))


def normalise_all(items: Column, hard: Column) -> Column:
    """``normalise`` over an array; ``hard`` tells whether its row needs Python.

    It is a step of its own: what is built on it, and folded again, is not merged with it.
    """
    folded = _fold_lists.asNondeterministic()(F.when(hard, items))
    return F.coalesce(folded, F.transform(items, _native_fold))


def normalise_hard(lists: Column, hard: Column) -> Column:
    """``normalise`` over an array of arrays in rows that need Python, NULL in others."""
    return _fold_nested.asNondeterministic()(F.when(hard, lists))


def native_normalise(text: Column) -> Column:
    """The JVM-only form, for use inside array lambdas."""
    return _native_fold(text)
