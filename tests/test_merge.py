"""Merging by key: versions, whole documents, replay, counts."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from lectern.functions.vectors import hash_embedder
from lectern.functions import text as T
from lectern.sources import collection
from lectern.sources.files import write_chunks
from lectern.streaming.indexing import applied_batches, merge_stream

BATCH = "id string, vector array<float>, version long, document string"


@pytest.fixture
def name(spark):
    table = "merge_" + uuid.uuid4().hex
    collection.ensure_collection(spark, table, 2, versioned=True)
    yield table
    collection.drop_collection(spark, table)


def batch(spark, rows):
    kind = spark.createDataFrame([], collection._COLUMNS).schema["payload"].dataType.simpleString()
    frame = spark.createDataFrame([(i, v and [float(v), 0.0], version, d) for i, v, version, d in rows], BATCH)
    payload = F.from_json(F.to_json(F.struct(F.col("document").alias("document_id"))), kind).alias("payload")
    return frame.select("id", "vector", payload, "version")


def held(spark, name):
    return {r.id: (r.vector[0], r.version) for r in spark.table(name).collect()}


def test_the_newest_wins_and_a_replay_changes_nothing(spark, name):
    first = batch(spark, [("a", 1, 10, "d"), ("b", 2, 10, "d"), ("b", 3, 11, "d"), (None, 4, 10, "d"), ("c", None, 10, "d")])
    assert collection.merge_points(first, name) == {"added": 2, "replaced": 0, "late": 0, "removed": 0, "set_aside": 2}
    assert held(spark, name) == {"a": (1, 10), "b": (3, 11)}
    again = collection.merge_points(first, name)
    assert again["added"] == 0 and held(spark, name) == {"a": (1, 10), "b": (3, 11)}
    late = collection.merge_points(batch(spark, [("a", 9, 12, "d"), ("b", 8, 5, "d"), ("n", 7, 1, "e")]), name)
    assert (late["added"], late["replaced"], late["late"]) == (1, 1, 1)
    assert held(spark, name) == {"a": (9, 12), "b": (3, 11), "n": (7, 1)}
    assert collection.merge_points(batch(spark, []), name)["added"] == 0


def test_points_that_a_document_no_longer_has_go(spark, name):
    rows = [(f"{d}{i}", i + 1, 10, d) for d in "xyz" for i in range(20)]
    collection.merge_points(batch(spark, rows), name, whole_documents=True)
    counts = collection.merge_points(batch(spark, [("x0", 50, 20, "x"), ("x99", 51, 20, "x")]), name, whole_documents=True)
    assert counts == {"added": 1, "replaced": 1, "late": 0, "removed": 19, "set_aside": 0}
    now = held(spark, name)
    assert {i for i in now if i[0] == "x"} == {"x0", "x99"} and len(now) == 42
    # An older version of the document that arrives late changes nothing.
    counts = collection.merge_points(batch(spark, [("x0", 1, 15, "x"), ("x5", 1, 15, "x")]), name, whole_documents=True)
    assert counts["late"] == 2 and held(spark, name) == now


def test_an_emptied_slot_is_empty(spark, name):
    collection.merge_points(batch(spark, [("only", 1, 1, "d")]), name, whole_documents=True)
    collection.merge_points(batch(spark, [("other", 1, 2, "d")]), name, whole_documents=True)
    assert set(held(spark, name)) == {"other"}


def embed(column):
    return hash_embedder(2)(T.tokens(column))


def test_stream_merges_files_and_keeps_its_counts(spark, name, tmp_path):
    def chunks(path, rows):
        frame = spark.createDataFrame(
            [(c, d, t, 1, ["s"], None, None) for c, d, t in rows],
            "chunk_id string, document_id string, text string, token_count int, section_path array<string>, page_start int, page_end int",
        )
        write_chunks(frame, str(tmp_path / "in" / path))

    chunks("one", [("d1_0", "d1", "old"), ("d1_1", "d1", "gone"), ("d2_0", "d2", "stays")])
    marks = str(tmp_path / "marks")
    merge_stream(spark, str(tmp_path / "in"), name, marks, embed).awaitTermination()
    time.sleep(0.02)
    chunks("two", [("d1_0", "d1", "new")])
    merge_stream(spark, str(tmp_path / "in"), name, marks, embed).awaitTermination()
    merge_stream(spark, str(tmp_path / "in"), name, marks, embed).awaitTermination()
    texts = {r.payload.id: r.payload.text for r in spark.table(name).collect()}
    assert texts == {"d1_0": "new", "d2_0": "stays"}
    counts = [(r.batch, r.added, r.replaced, r.removed) for r in applied_batches(spark, f"{marks}/applied").orderBy("batch").collect()]
    assert counts == [(0, 3, 0, 0), (1, 0, 1, 1)]
    assert os.path.isdir(f"{marks}/stream")


def test_counts_of_upserts_and_appends(spark):
    table = "upsert_" + uuid.uuid4().hex
    collection.ensure_collection(spark, table, 2)
    rows = batch(spark, [("a", 1, 1, "d"), ("b", 2, 1, "d"), ("b", 3, 2, "d")])
    assert collection.append_points(rows.drop("version"), table) == 3
    found = collection.upsert_points(batch(spark, [("b", 5, 1, "d"), ("c", 6, 1, "d"), ("c", 7, 2, "d")]), table, "version")
    assert found == {"added": 1, "replaced": 2, "repeated": 1}
    assert sorted((r.id, r.vector[0]) for r in spark.table(table).collect()) == [("a", 1.0), ("b", 5.0), ("c", 7.0)]
    collection.drop_collection(spark, table)
