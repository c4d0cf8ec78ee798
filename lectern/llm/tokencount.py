"""Token counts by rank-synchronous array merging.

Texts are normalised and cut into pre-tokens as the vocabulary file says; distinct
pre-tokens are counted once. Those not seen before are merged together: their byte symbols
lie in one ragged numpy array, and in every round each sequence merges its lowest-ranked pair
(the leftmost of equals), all sequences at once, until no sequence has a pair with a rank.
What is left of a sequence is its number of tokens.

Only byte-pair vocabularies are read whose base symbols are single bytes, with or without a
word end. The file's path is a parameter; each worker reads the file for itself, so it must
be installed where the workers run.

Defined results: a null or empty text has no tokens; a special string of the vocabulary
inside a text is one token; texts of any length are read whole; repeated rows are counted
each; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import bound_batches

LIMIT = 2048
CACHE_WORDS = 300_000
BATCH_WORDS = 50_000

# How this kind of vocabulary cuts lower-case text.
_WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
)
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


def _byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes, as byte-level vocabularies write them."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Ranks of pairs in an open-addressing table, looked up for whole arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        vocab: dict[str, int] = model["vocab"]
        self.first = np.zeros(256, dtype=np.int64)
        self.last = np.zeros(256, dtype=np.int64)
        for symbol, byte in _byte_symbols().items():
            self.first[byte] = vocab[symbol]
            self.last[byte] = vocab[symbol + self.suffix]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self._fill(left * self.size + right)

    def _fill(self, keys: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, len(keys), dtype=np.int64)
        slots = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):  # place one key per free slot, move the others on
            free = self.keys[slots[todo]] == -1
            place, first = np.unique(slots[todo[free]], return_index=True)
            chosen = todo[free][first]
            self.keys[place], self.ranks[place] = keys[chosen], chosen
            todo = np.setdiff1d(todo, chosen, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & self.mask
        self.none = len(keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        slots = self._slot(keys)
        out = np.full(len(keys), self.none, dtype=np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
            slots[open_] = (slots[open_] + 1) & self.mask
        return out

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of every word; words are not empty."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(b) for b in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.first[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[data[ends - 1]]
        out = lengths.copy()
        alive = np.arange(len(words))
        rank = self.rank(symbols[:-1], symbols[1:])
        rank = np.append(rank, self.none)
        rank[ends - 1] = self.none  # no pair across words
        while len(alive):
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            key = (rank << 32) | np.arange(len(rank))
            best = np.minimum.reduceat(key, starts)
            at, lowest = best & 0xFFFFFFFF, best >> 32
            merging = lowest < self.none
            if not merging.all():
                keep = np.repeat(merging, lengths)
                moved = np.cumsum(keep) - 1
                symbols, rank = symbols[keep], rank[keep]
                out[alive[~merging]] = lengths[~merging]
                alive, lengths = alive[merging], lengths[merging]
                at, lowest = moved[at[merging]], lowest[merging]
                if not len(alive):
                    break
            symbols[at] = self.made[lowest]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            shift = np.arange(len(at))  # one symbol fewer per earlier sequence
            rank[at] = rank[at + 1]  # whether another symbol follows in the word
            symbols, rank, at = symbols[keep], rank[keep], at - shift
            lengths = lengths - 1
            last = np.cumsum(lengths) - 1
            follows = at < last
            a = at[follows]
            rank[at[~follows]] = self.none
            rank[a] = self.rank(symbols[a], symbols[a + 1])
            first = last - lengths + 1
            precedes = at > first
            b = at[precedes] - 1
            rank[b] = self.rank(symbols[b], symbols[b + 1])
        return out


@functools.lru_cache(maxsize=4)
def _merges(path: str) -> Merges:
    return Merges(path)


def _lower(text: str) -> str:
    if "Σ" in text or "ς" in text:  # the vocabulary's rule looks at single letters
        return "".join(c.lower() for c in text)
    return text.lower()


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text without special strings."""
    if text.isascii():
        return _ASCII_WORDS.findall(text.lower())
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return _WORDS.findall(_lower(text))


class Counter:
    """Token counts of texts, with a bounded memory of pre-tokens."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.merges = _merges(path)
        self.limit = cache_words
        self.known: dict[str, int] = {}
        specials = sorted(self.merges.specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > self.limit:
            self.known.clear()
        for i in range(0, len(words), BATCH_WORDS):
            part = words[i : i + BATCH_WORDS]
            self.known.update(zip(part, self.merges.count(part).tolist(), strict=True))

    def _pieces(self, text: str) -> tuple[int, list[str]]:
        if self.special is None or not self.special.search(text):
            return 0, pre_tokens(text)
        pieces = self.special.split(text)
        return len(pieces) - 1, [w for piece in pieces for w in pre_tokens(piece)]

    def count(self, texts: list[str]) -> list[int]:
        cut = [self._pieces(t) for t in texts]
        new = {w for _, words in cut for w in words}.difference(self.known)
        known = self.known
        if new:
            self._learn(sorted(new))
            missing = {w for _, words in cut for w in words}.difference(known)
            if missing:  # the memory was emptied: these texts' other words
                words = sorted(missing)
                for i in range(0, len(words), BATCH_WORDS):
                    part = words[i : i + BATCH_WORDS]
                    known.update(zip(part, self.merges.count(part).tolist(), strict=True))
        get = known.__getitem__
        return [extra + sum(map(get, words)) for extra, words in cut]


_GROUP_CHARS = 1 << 20


def _counts(column: pa.Array, counter: Counter) -> list[int]:
    out: list[int] = []
    group: list[str] = []
    size = 0
    for value in column:
        text = value.as_py() or ""
        group.append(text)
        size += len(text)
        if size >= _GROUP_CHARS:
            out += counter.count(group)
            group, size = [], 0
    return out + counter.count(group)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every text."""
    bound_batches(docs.sparkSession)
    source = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        counter = Counter(path)
        for batch in batches:
            texts = batch.column("__text")
            n = pa.array(_counts(texts, counter), pa.int64())
            columns = [batch.column(c) for c in keep]
            size = pa.compute.cast(pa.compute.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, size, n], [*keep, "n_bytes", "n_tokens"])

    counted = source.mapInArrow(run, f"{fields}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
