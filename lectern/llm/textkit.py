"""Words and hashes of many texts at once, as numpy arrays over an Arrow column.

Texts are read where Arrow holds them; nothing is decoded. A column is worked through in
slices of about a million bytes, so memory does not follow the size of a batch; one longer
text is a slice of its own. Word hashes have 64 bits: sums of random byte values times
powers of an odd base, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_PIECE = 1 << 15


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 booleans, true inside the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


# Everything but blank and the five controls from tab to carriage return.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
# Digits, lower-case letters and all bytes of letters beyond ASCII (after lower-casing).
WORD_BYTES = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_random = np.random.default_rng(20240229)
_VALUES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
_ONE = np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(_BASE, 2 * _PIECE), _powers(_INVERSE, 2 * _PIECE)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Texts:
    """Bytes of some texts, with ``offsets`` of one more than their number; null is empty."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """``(first row, row after the last, texts)`` over a string or binary column."""
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high, Texts(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


@dataclass
class Words:
    """Words of some texts: byte ranges, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def find_words(texts: Texts, table: np.ndarray = NOT_SPACE) -> Words:
    inside = table[texts.data]
    n = len(inside)
    edges = texts.offsets[1:-1]
    edges = edges[edges < n]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[edges] = inside[edges]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(start)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, texts.offsets))


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """64-bit hash of every word."""
    starts, ends = words.starts, words.ends
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        low = starts[i]
        j = max(int(np.searchsorted(ends, low + _PIECE, "right")), i + 1)
        size = int(ends[j - 1] - low)
        if size <= len(_POW):
            power, inverse = _POW, _INV
        else:  # one very long word
            power, inverse = _powers(_BASE, size), _powers(_INVERSE, size)
        sums = np.empty(size + 1, dtype=np.uint64)
        sums[0] = 0
        values = _VALUES[data[low : low + size]]
        values *= power[:size]
        np.cumsum(values, out=sums[1:])
        first = starts[i:j] - low
        h = sums[ends[i:j] - low] - sums[first]
        h *= inverse[first]
        h += (ends[i:j] - starts[i:j]).astype(np.uint64) << np.uint64(50)
        out[i:j] = h
        i = j
    return mix(out)


_STEP = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                                0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside each text, and each text's bounds.

    A text with fewer words, but not none, has its whole sequence as one window.
    """
    counts = np.diff(bounds)
    per_text = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(per_text)])
    total = int(out_bounds[-1])
    if total == 0:
        return np.empty(0, np.uint64), out_bounds
    text_of = np.repeat(np.arange(len(counts)), per_text)
    at = np.arange(total) - out_bounds[text_of] + bounds[text_of]
    end = bounds[1:][text_of]
    h = np.zeros(total, dtype=np.uint64)
    for k in range(width):
        inside = at + k < end
        part = mix(hashes[np.minimum(at + k, len(hashes) - 1)] * _STEP[k % 5] + np.uint64(k + 1))
        h = np.where(inside, (h ^ part) * np.uint64(0x9FB21C651E98DF25) + _ONE, h)
    return mix(h), out_bounds


def strings_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges as an Arrow binary column."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    at = np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))]
    )

