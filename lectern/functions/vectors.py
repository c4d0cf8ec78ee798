"""Vector expressions and the Arrow kernels that run inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

# Similarities are compared after rounding to this many digits, so that equal vectors tie
# whatever block of a matrix product they were computed in; ties are broken by id.
SCORE_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; NULL where one of them is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def matrix(column: pa.Array, ids: pa.Array | None = None, dim: int | None = None) -> np.ndarray:
    """List column without NULLs as a two-dimensional float64 array.

    Lists of unequal size, or of another size than ``dim``, are an error that names the id.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    if len(sizes) and dim is None:
        dim = int(sizes[0])
    wrong = np.flatnonzero(sizes != dim)
    if len(wrong):
        name = ids[int(wrong[0])].as_py() if ids is not None else int(wrong[0])
        raise ValueError(f"vector of {name} has {sizes[wrong[0]]} dimensions, not {dim}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows become NaN."""
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    with np.errstate(divide="ignore", invalid="ignore"):
        return vectors / np.where(lengths == 0, np.nan, lengths)[:, None]


def token_buckets(words: pa.Array, dim: int) -> np.ndarray:
    """Bucket of each word: the first 32 bits of its MD5, modulo ``dim``."""
    encoded = words.dictionary_encode()
    table = np.array(
        [
            int(hashlib.md5(word.encode("utf-8"), usedforsecurity=False).hexdigest()[:8], 16) % dim
            for word in encoded.dictionary.to_pylist()
        ],
        dtype=np.int64,
    )
    return table[encoded.indices.to_numpy(zero_copy_only=False)] if len(words) else table


def hash_embedder(dim: int):
    """Deterministic stand-in for an embedding model: hashed term counts, length 1.

    Takes a column of token arrays. Each distinct token of a batch is hashed once and the
    counts of a whole batch are formed by one ``bincount``.
    """

    @F.arrow_udf(ArrayType(FloatType()))
    def embed(tokens: pa.Array) -> pa.Array:
        lengths = np.diff(tokens.offsets.to_numpy()) if len(tokens) else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(tokens)), lengths)
        cells = rows * dim + token_buckets(tokens.flatten(), dim)
        counts = np.bincount(cells, minlength=len(tokens) * dim).astype(np.float64)
        counts = counts.reshape(len(tokens), dim)
        vectors = np.nan_to_num(unit_rows(counts)).astype(np.float32)
        offsets = pa.array(np.arange(0, (len(tokens) + 1) * dim, dim), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel(), pa.float32()))

    return embed
