"""Files of bounded size with offsets."""

import os
import random

from pyspark.sql import functions as F

from lectern.sources.files import CHUNK_SCHEMA, read_by_document, write_by_size, write_chunks

SCHEMA = "doc string, at int, line string"


def folders(path):
    return [name for name in os.listdir(path) if name.startswith("file=")]


def test_files_follow_bytes_and_not_documents(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"d{i}", k, "x" * 20) for i in range(2000) for k in range(2)]
    rows += [("hot", k, "y" * 20) for k in range(4000)] + [(None, 0, "nobody's")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "out")
    write_by_size(frame, path, "doc", ["at"], file_bytes=50_000)
    assert 4 <= len(folders(path)) <= 12
    offsets = spark.read.parquet(f"{path}/_offsets")
    hot = offsets.filter("doc = 'hot'").orderBy("file").collect()
    assert len(hot) > 2 and sum(r["last"] - r["first"] + 1 for r in hot) == 4000
    ids = spark.createDataFrame([("d7",), ("hot",), (None,), ("absent",), ("d7",)], "doc string")
    found = read_by_document(spark, path, "doc", SCHEMA, ids)
    assert found.columns == ["doc", "at", "line"]
    got = sorted(map(str, found.collect()))
    assert got == sorted(str(r) for r in frame.filter("doc IN ('d7', 'hot') OR doc IS NULL").collect())


def test_lines_stand_in_order_in_their_files(spark, tmp_path):
    frame = spark.range(5000).select(F.lit("one").alias("doc"), F.col("id").cast("int").alias("at"), F.col("id").cast("string").alias("line"))
    path = str(tmp_path / "out")
    write_by_size(frame.orderBy(F.rand(3)), path, "doc", ["at"], file_bytes=30_000)
    for name in folders(path):
        read = [r.at for r in spark.read.schema(SCHEMA).json(f"{path}/{name}").coalesce(1).collect()]
        assert read == sorted(read)


def test_chunks_by_document_have_no_task_of_their_own(spark, tmp_path):
    rows = [(f"d{i % 500}_chunk_{i:04d}", f"d{i % 500}", "text", 1, ["s"], 1, None) for i in range(1500)]
    path = str(tmp_path / "chunks")
    write_chunks(spark.createDataFrame(rows, CHUNK_SCHEMA), path, by_document=True)
    assert len(folders(path)) == 1
    found = read_by_document(spark, path, "document_id", CHUNK_SCHEMA, spark.createDataFrame([("d3",)], "document_id string"))
    assert sorted(r.chunk_id for r in found.collect()) == sorted(r[0] for r in rows if r[1] == "d3")


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    write_by_size(spark.createDataFrame([], SCHEMA), path, "doc", ["at"])
    assert spark.read.parquet(f"{path}/_offsets").count() == 0
