import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import vectorsearch
from lectern.llm.vectorsearch import exact_top_k

SCHEMA = "vec_id long, embedding array<double>, label int, n int, data string, part string"
LARGEST = (1 << 63) - 1


def brute(rows, k=10, scale=1024):
    clip = lambda x: max(-LARGEST, min(LARGEST, x))
    whole = lambda x: max(-(1 << 63), min(LARGEST, math.floor(scale * x)))
    own = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    hits = []
    for at, (i, q) in enumerate(own):
        if i is None or i % 100:
            continue
        others = [(clip(sum(a * b for a, b in zip(q, v))), j) for o, (j, v) in enumerate(own) if o != at and len(v) == len(q)]
        others.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        hits += [(i, rank, j, s) for rank, (s, j) in enumerate(others[:k], 1)]
    return Counter(hits)


def search(spark, rows, k=10):
    frame = spark.createDataFrame([(i, v, 0, 0, "clash", "clash") for i, v in rows], SCHEMA)
    found = exact_top_k(frame.repartition(3), F.col("vec_id") % 100 == 0, k=k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return Counter(map(tuple, found.collect()))


ODD = [
    (0, [0.5, -0.25]), (0, [0.5, -0.25]), (0, [0.5, 0.25]), (1, [0.5, -0.25]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]),
    (5, [float("inf"), 0.0]), (None, [0.5, -0.25]), (None, [2.0, 2.0]), (100, [0.0, 0.0]), (200, [1.0]), (300, [1.0, 2.0, 3.0]), (6, [0.3]),
    (400, []), (7, []), (500, None), (600, [1e-9, -1e-9]),
] + [(8, [0.1, 0.1])] * 13


def test_odd_rows_equal_brute_force(spark):
    assert search(spark, ODD) == brute(ODD)
    assert search(spark, ODD, k=2) == brute(ODD, k=2)


def test_scores_beyond_floats_and_beyond_64_bits(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 1.0]), (2, [3e6, 1.001]), (100, [1e30, 1e30]), (3, [1e30, -1e30]), (4, [-1e30, -1e30]), (5, [1e15, 7.0])]
    assert search(spark, rows) == brute(rows)


@pytest.mark.parametrize("sizes", [(8192, 2048, 1024), (16, 3, 5)])
def test_many_rows_with_ties_equal_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("SHARD_ROWS", "TILE_ROWS", "BLOCK_ROWS"), sizes, strict=True):
        monkeypatch.setattr(vectorsearch, name, size)
    monkeypatch.setattr(vectorsearch, "TILES_PER_SLICE", 2)
    monkeypatch.setattr(vectorsearch, "FAN_IN", 2)
    rng = random.Random(3)
    rows = [(i * 10 % 2000, [rng.randint(-2, 2) / 4 for _ in range(4)]) for i in range(400)]
    rows += [(i, [0.25, 0.25, 0.25, 0.25]) for i in range(50, 350)]
    assert search(spark, rows) == brute(rows)


def test_nothing_to_search(spark):
    assert not search(spark, [])
    assert not search(spark, [(1, [1.0]), (2, [1.0])])
    assert not search(spark, [(0, [1.0])])
