"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text. A text is
parsed greedily into the longest phrases that occur in the sample; the entropy estimate is
the number of phrases, times the logarithm of the sample's length, over the text's length.
The language with the smallest estimate is predicted.

The automata are one table of states by symbols, and the parse advances many pieces of text
through all languages at once: one table look-up per symbol. A missing transition is stored
as the complement of the state that the failing symbol starts from, so it is a phrase's end
and the next phrase's begin in one. Texts are read whole, in pieces of ``PIECE`` symbols; a
cut adds at most one phrase, to every language alike.

The sample is bounded by rows: ``DOCS_PER_LANG`` documents of each language and ``DOCS`` of all,
of each a piece of ``CHARS_PER_DOC`` characters from a place that a hash gives. It covers every
language that occurs in the rows it may learn from; the automata are broadcast and have at most
two states per symbol.

Defined results: repeated rows are predicted alike, and learned from once; texts of any length
are read whole; columns ``lang_pred`` and ``lang_score`` are replaced, others passed on; a null text, or one without letters, is ``und`` with score 0; so is every
text if there is nothing to learn from; equal estimates give the language first in code point
order, with score 0; with one language its score is 1; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import bound_batches, lean
from lectern.llm.sampling import labelled_sample, remainder
from lectern.llm.textkit import LOWER, Texts, slices

FOLDS = 5
DOCS_PER_LANG, DOCS = 256, 8192
CHARS_PER_DOC = 96
PIECE = 256
UNKNOWN = "und"


@dataclass
class LanguageModel:
    langs: list[str]
    symbol_of: np.ndarray  # of every byte
    blank: int
    pad: int
    table: np.ndarray  # all languages' transitions, flat, by state and symbol
    roots: np.ndarray
    scale: np.ndarray  # logarithm of each sample's length


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the automaton of one sequence, ``-1`` where there is none."""
    step = np.full((2 * len(symbols) + 2, width), -1, dtype=np.int32)
    link = [-1]
    length = [0]
    last, size = 0, 1
    for c in symbols:
        new = size
        size += 1
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and step[p, c] < 0:
            step[p, c] = new
            p = link[p]
        if p != -1:
            q = int(step[p, c])
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = size
                size += 1
                length.append(length[p] + 1)
                link.append(link[q])
                step[copy] = step[q]
                while p != -1 and step[p, c] == q:
                    step[p, c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step[:size]


def _letters(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes, everything of ASCII but letters as a blank."""
    folded = LOWER[data]
    plain = (folded < 0x61) | ((folded > 0x7A) & (folded < 0x80))
    folded[plain] = 0x20
    return folded


def _squeezed(folded: np.ndarray) -> np.ndarray:
    """Which bytes stay when runs of blanks are one blank."""
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 0x20) | (folded[:-1] != 0x20)
    return keep


def train(samples: dict[str, list[str]]) -> LanguageModel:
    texts = {}
    for lang, parts in samples.items():
        data = _letters(np.frombuffer(" ".join(parts).encode(), dtype=np.uint8))
        data = data[_squeezed(data)]
        if len(data):
            texts[lang] = data
    used = np.unique(np.concatenate([*texts.values(), np.array([0x20], np.uint8)]))
    width = len(used) + 2
    symbol_of = np.full(256, len(used), dtype=np.int32)  # a byte no sample has
    symbol_of[used] = np.arange(len(used))
    tables, roots, base = [], [], 0
    for data in texts.values():
        step = suffix_automaton(symbol_of[data].tolist(), width)
        # One more state, after a symbol that the sample lacks: any symbol begins a phrase.
        dead = len(step)
        step = np.concatenate([step, np.full((1, width), -1, np.int32)])
        restart = np.where(step[0] >= 0, step[0], dead)  # where a failing symbol's phrase goes on
        step[0] = restart  # the root is left once, with the first phrase open
        step = np.where(step >= 0, (step + base) * width, ~((restart + base) * width)[None, :])
        step[:, width - 1] = (np.arange(len(step)) + base) * width  # padding stays and costs nothing
        tables.append(step.astype(np.int32))
        roots.append(base * width)
        base += len(step)
    table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)
    scale = np.array([np.log2(len(d) + 1) for d in texts.values()])
    return LanguageModel(
        list(texts), symbol_of, int(symbol_of[0x20]), width - 1, table, np.array(roots, np.int32), scale
    )


def phrase_counts(model: LanguageModel, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of every text in every language, and the symbols of every text."""
    n = len(texts)
    counts = np.zeros((len(model.langs), n), dtype=np.int64)
    folded = _letters(texts.data)
    keep = _squeezed(folded)
    inner = texts.offsets[:-1]
    keep[inner[inner < len(keep)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    offsets = kept[texts.offsets]
    symbols = model.symbol_of[folded[keep]]
    lengths = np.diff(offsets)
    pieces = -(-lengths // PIECE)
    total = int(pieces.sum())
    if total == 0 or not model.langs:
        return counts, lengths
    text_of = np.repeat(np.arange(n), pieces)
    number = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[:-1][text_of] + number * PIECE
    size = np.minimum(PIECE, offsets[1:][text_of] - start)
    at = start[:, None] + np.arange(PIECE)[None, :]
    inside = np.arange(PIECE)[None, :] < size[:, None]
    grid = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], model.pad)
    grid = np.ascontiguousarray(grid.T.astype(np.int32))
    state = np.repeat(model.roots[:, None], total, axis=1)
    phrases = np.ones((len(model.langs), total), dtype=np.int32)
    table = model.table
    for column in grid:
        found = table[state + column[None, :]]
        sign = found >> 31
        phrases -= sign
        state = found ^ sign
    for k in range(len(model.langs)):
        counts[k] = np.bincount(text_of, weights=phrases[k], minlength=n).astype(np.int64)
    return counts, lengths


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "ignore"))


def predict(model: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    langs: list[str] = []
    scores = np.zeros(len(column))
    for low, high, texts in slices(column):
        n = high - low
        counts, lengths = phrase_counts(model, texts)
        ascii_letter = np.concatenate(
            [[0], np.cumsum((LOWER[texts.data] >= 0x61) & (LOWER[texts.data] <= 0x7A))]
        )
        plain = np.diff(ascii_letter[texts.offsets]) > 0
        if not model.langs:
            langs += [UNKNOWN] * n
            continue
        entropy = counts * model.scale[:, None] / np.maximum(lengths, 1)[None, :]
        best = np.argmin(entropy, axis=0)
        ordered = np.sort(entropy, axis=0)
        if len(model.langs) > 1:
            margin = (ordered[1] - ordered[0]) / np.maximum(ordered[1], 1e-12)
        else:
            margin = np.ones(n)
        for i in range(n):
            raw = None if plain[i] else texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
            if plain[i] or _has_letter(raw):
                langs.append(model.langs[best[i]])
                scores[low + i] = min(1.0, max(0.0, float(margin[i])))
            else:
                langs.append(UNKNOWN)
    return langs, scores


def fit(docs: DataFrame, folds: int = FOLDS) -> LanguageModel:
    """Model from the documents that are not held out and have a language."""
    rows = docs.select("doc_id", F.col("lang").alias("label")).filter(
        (remainder(F.col("doc_id"), folds) != 0) & F.col("label").isNotNull()
    )
    langs = rows.agg(F.count_distinct("label")).first()[0]
    return train(labelled_sample(docs, rows, max(1, min(DOCS_PER_LANG, DOCS // max(langs, 1))), CHARS_PER_DOC))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``lang_score``; such columns are replaced."""
    docs = docs.drop("lang_pred", "lang_score")
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for batch in batches:
            langs, scores = predict(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(langs, pa.string()), pa.array(scores)],
                [*names, "lang_pred", "lang_score"],
            )

    return docs.mapInArrow(lean(run), f"{fields}, lang_pred string, lang_score double")


def language_table(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    predicted = identify(docs.select("doc_id", "text"), fit(docs))
    return predicted.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )
