"""Stored indexes against searches that read everything."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators.dense import dense_topk
from lectern.operators.sparse import bm25_topk
from lectern.sources.keyword_index import KeywordIndex, add_to_index
from lectern.sources.vector_index import VectorIndex, write_vector_index


def corpus(seed, items, vocabulary, longest=30):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(rng.choices([f"w{j}" for j in range(vocabulary)], weights, k=rng.randint(0, longest)))) for i in range(items)]


def hits(frame):
    return sorted((r.query_id, r.rank, r.item_id, round(r.score, 7)) for r in frame.collect())


def test_keyword_index_equals_the_full_search(spark, tmp_path):
    items = spark.createDataFrame(corpus(1, 3000, 400) + [(9001, None), (9002, ""), (9003, "w0 " * 50)], "item_id long, text string")
    asked = [(i, t) for i, t in corpus(2, 40, 400, 6)] + [(100, "unknown"), (101, None), (102, "w0 w399"), (103, "w1 w1 W1")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    path = str(tmp_path / "index")
    for part in range(3):  # added to without a rebuild
        add_to_index(items.filter(F.col("item_id") % 3 == part), path)
    index = KeywordIndex(spark, path)
    for k in (1, 5):
        found, reads = index.search_with_reads(queries, k)
        assert hits(found) == hits(bm25_topk(queries, items, k))
        whole, looked_up = reads.agg(F.sum("postings"), F.sum("looked_up")).first()
        assert 0 < looked_up < 0.8 * whole


def test_common_words_beside_rare_ones_are_not_looked_up(spark, tmp_path):
    rows = [(i, f"common common{i % 3} filler" + (" rare rare" if i % 500 == 0 else "")) for i in range(5000)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    queries = spark.createDataFrame([(1, "common rare")], "query_id long, text string")
    path = str(tmp_path / "index")
    add_to_index(items, path)
    found, reads = KeywordIndex(spark, path).search_with_reads(queries, 5)
    assert hits(found) == hits(bm25_topk(queries, items, 5))
    r = reads.first()
    assert (r.postings, r.looked_up) == (5010, 10)


def test_a_folder_without_an_index_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        KeywordIndex(spark, str(tmp_path / "none"))


def clustered(seed, n, dim, clusters):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    return [(i, [x + rng.gauss(0, 0.1) for x in middles[i % clusters]]) for i in range(n)]


def near(frame):
    return sorted((r.query_id, r.rank, r.item_id, r.similarity) for r in frame.collect())


@pytest.mark.parametrize(("centres", "ring"), [(1024, 16), (1, 7), (5, 512)])
def test_vector_index_equals_the_full_search(spark, tmp_path, centres, ring):
    rows = clustered(3, 1500, 8, 20)
    rows += [(5000 + i, rows[0][1]) for i in range(30)] + [(6000, None), (6001, [0.0] * 8), (6002, [-x for x in rows[1][1]])]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>")
    asked = [(i, v) for i, v in rows[:25] + rows[-3:]] + [(7000, [1.0] + [0.0] * 7)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    path = str(tmp_path / "index")
    write_vector_index(items, path, centres=centres, ring=ring)
    index = VectorIndex(spark, path)
    for k in (1, 10):
        found, reads = index.search_with_reads(queries, k)
        assert near(found) == near(dense_topk(queries, items, k))
        compared, pairs = reads.first()
        assert 0 < compared <= pairs
        if centres == 1024:
            assert compared < 0.35 * pairs


def test_vector_index_edges(spark, tmp_path):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    few = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "item_id long, vector array<double>")
    write_vector_index(few, str(tmp_path / "few"))
    assert [r.item_id for r in VectorIndex(spark, str(tmp_path / "few")).search(queries, 5).collect()] == [2]
    write_vector_index(few.limit(0), str(tmp_path / "none"))
    assert VectorIndex(spark, str(tmp_path / "none")).search(queries.limit(0), 5).collect() == []
