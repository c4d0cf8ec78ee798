"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text, that is on the
words of toxic documents which mark them (below). Every text is cut at blanks into windows of
about ``WINDOW_BYTES`` bytes; each window is compressed twice, with the ordinary dictionary and
with the toxic one put before it. Both see the same ordinary text at the same distance, so the
lengths of an ordinary window hardly differ, while a window with toxic words gets shorter. The
windows that gain most in a fast setting are compressed again in a thorough one.

A document's features are its largest gains and how many windows gain. A logistic function of
them, fitted on gains from dictionaries that the documents did not train, is the score, and
0.7 its threshold.

A word marks toxic text if it follows many different words (copies of one passage count
once), and does so much more often than in ordinary text. All labelled documents that are not
held out may be learned from; a bounded sample of them is (``DOCS_PER_LABEL`` documents of
each label, ``CHARS_PER_DOC`` characters of each from a place that a hash gives, of these
``ORDINARY_SAMPLES`` runs of eight ordinary words, and ``TOXIC_BYTES`` of the strongest marking
words). Scoring reads whole texts of all documents.

Defined results: null and empty texts have no window and get the score of a document without
gain; without labels of both kinds to learn from, every score is the share of toxic labels (0
if there are none); labels other than 0 and 1 are not learned from; contradicting labels of
one document both count; repeated rows are scored alike; a very long text is all its windows,
of which more can gain by chance; an empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import bound_batches
from lectern.llm.sampling import labelled_sample, remainder
from lectern.llm.textkit import LOWER, NOT_SPACE, Texts, find_words, slices

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
DOCS_PER_LABEL = 3_000
CHARS_PER_DOC = 4_000
WINDOW_BYTES = 48
TOXIC_BYTES = 8_192
ORDINARY_BYTES = 32_768
ORDINARY_SAMPLES = 60_000
MIN_CONTEXTS = 4
MIN_CONTEXT_SHARE = 0.003  # of the toxic documents, if that is more
MIN_LOG_ODDS = 3.8
RECHECK_GAIN = 2
_PUNCTUATION = b".,!?;:\"'()|#*$%&<>"


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _contexts(texts: list[str]) -> Counter:
    """How many different words each word follows."""
    pairs = set()
    for text in texts:
        before = b""
        for word in _words(text):
            word = word.strip(_PUNCTUATION)
            pairs.add((before, word))
            before = word
    return Counter(word for _, word in pairs)


def marking_words(toxic: list[str], ordinary: list[str]) -> dict[bytes, int]:
    """Words that mark toxic text, with the number of words they follow there."""
    t, o = _contexts(toxic), _contexts(ordinary)
    least = max(MIN_CONTEXTS, MIN_CONTEXT_SHARE * len(toxic))
    shift = math.log((sum(o.values()) + 1) / (sum(t.values()) + 1))
    return {
        w: n
        for w, n in t.items()
        if len(w) >= 3
        and n >= least
        and math.log((n + 0.5) / (o[w] + 0.5)) + shift > MIN_LOG_ODDS
    }


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; too few samples for training are its content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _compressor(content: bytes, thorough: bool):
    how = (
        {"strategy": zstandard.STRATEGY_BTULTRA, "min_match": 3}
        if thorough
        else {"strategy": zstandard.STRATEGY_LAZY2, "min_match": 4}
    )
    parameters = zstandard.ZstdCompressionParameters.from_level(
        12,
        source_size=WINDOW_BYTES,
        dict_size=len(content),
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
        **how,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress


class Gains:
    """Gains of windows from the toxic dictionary; built anew in every worker."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        both = toxic + ordinary
        self.fast = _compressor(ordinary, False), _compressor(both, False)
        self.thorough = _compressor(ordinary, True), _compressor(both, True)

    def features(self, windows: Iterator[bytes]) -> tuple[float, ...]:
        """Largest fast gain, windows with one, largest and summed thorough gain, windows."""
        (a, b), (c, d) = self.fast, self.thorough
        best = hits = best_thorough = total = 0
        for window in windows:
            gain = len(a(window)) - len(b(window))
            if gain >= RECHECK_GAIN:
                hits += 1
                if gain > best:
                    best = gain
                gain = len(c(window)) - len(d(window))
                if gain > 0:
                    total += gain
                    if gain > best_thorough:
                        best_thorough = gain
        return best, math.log1p(hits), best_thorough, math.log1p(total), math.log1p(best_thorough)


def _windows(texts: Texts) -> Iterator[Iterator[bytes]]:
    """Windows of every text: runs of whole words, lower-cased, a blank at both ends."""
    folded = LOWER[texts.data]
    folded[~NOT_SPACE[folded]] = 0x20
    words = find_words(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    number = (words.starts - texts.offsets[text_of]) // WINDOW_BYTES
    new = np.ones(len(words.starts), dtype=bool)
    new[1:] = (number[1:] != number[:-1]) | (text_of[1:] != text_of[:-1])
    first = np.flatnonzero(new)
    starts = words.starts[first]
    ends = words.ends[np.append(first[1:], len(new)) - 1] if len(first) else starts
    bounds = np.searchsorted(first, words.bounds)
    raw = folded.tobytes()
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ranges = zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)
        yield (b" " + raw[s:e] + b" " for s, e in ranges)


def features(gains: Gains, column: pa.Array) -> np.ndarray:
    rows = [
        gains.features(windows) for _, _, texts in slices(column) for windows in _windows(texts)
    ]
    return np.array(rows, dtype=np.float64).reshape(len(rows), 5)


class ToxicityModel:
    """Dictionaries and the fitted logistic function."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(rows @ self.weights[1:] + self.weights[0])))


def _logistic(rows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; no feature lowers the score."""
    active = np.arange(rows.shape[1])
    while True:
        x = np.column_stack([np.ones(len(rows)), rows[:, active]])
        beta = np.zeros(x.shape[1])
        ridge = np.full(x.shape[1], 1e-2)
        ridge[0] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            gradient = x.T @ (weight * (labels - p)) - ridge * beta
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            change = np.linalg.solve(curve, gradient)
            beta += change
            if np.abs(change).max() < 1e-8:
                break
        if (beta[1:] >= 0).all():
            out = np.zeros(rows.shape[1] + 1)
            out[0] = beta[0]
            out[active + 1] = beta[1:]
            return out
        active = active[beta[1:] >= 0]


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    marks = sorted(marking_words(toxic, ordinary).items(), key=lambda x: (x[1], x[0]))
    # zstandard's trainer needs samples longer than a word. A content dictionary is laid out
    # as the trainer would: every word once, the strongest last, next to the text.
    words = b"".join(b" " + word for word, _ in marks) + b" "
    plain = [
        b" ".join(w[i : i + 8]) for w in map(_words, ordinary) for i in range(0, len(w), 8)
    ]
    return (
        _dictionary(plain[:ORDINARY_SAMPLES], ORDINARY_BYTES),
        words[-TOXIC_BYTES:],
    )


def train(samples: dict[int, list[str]], share: float) -> ToxicityModel:
    """Dictionaries from all samples; the logistic function from gains out of fold.

    Dictionaries of the even documents give the gains of the odd ones and the reverse, so the
    function sees what unseen documents gain. ``share`` is the share of toxic labels; the
    sample's labels are weighted to it.
    """
    toxic, ordinary = samples.get(1, []), samples.get(0, [])
    if len(toxic) < 2 or len(ordinary) < 2:
        base = math.log((share + 1e-6) / (1 - share + 1e-6))
        return ToxicityModel(b" ", b" ", np.array([base, 0, 0, 0, 0, 0.0]))
    rows, labels = [], []
    for fold in (0, 1):
        gains = Gains(*_dictionaries(toxic[fold::2], ordinary[fold::2]))
        texts = [*toxic[1 - fold :: 2], *ordinary[1 - fold :: 2]]
        rows.append(features(gains, pa.array(texts, pa.large_string())))
        labels += [1.0] * len(toxic[1 - fold :: 2]) + [0.0] * len(ordinary[1 - fold :: 2])
    y = np.array(labels)
    drawn = y.mean()
    weight = np.where(y == 1, share / drawn, (1 - share) / (1 - drawn))
    return ToxicityModel(
        *_dictionaries(toxic, ordinary), _logistic(np.concatenate(rows), y, weight)
    )


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Model from the labelled documents that are not held out."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    )
    share = own.agg(F.avg("label")).first()[0]
    return train(labelled_sample(docs, own, DOCS_PER_LABEL, CHARS_PER_DOC), share or 0.0)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the score of every text."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col("text").alias("__text"))
    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        own = shared.value
        gains = Gains(own.ordinary, own.toxic)
        for batch in batches:
            scores = own.scores(features(gains, batch.column("__text")))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(scores)], [*keep, "score"]
            )

    return source.mapInArrow(run, f"{fields}, score double")


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score_toxicity(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
