"""Rows move once: short documents in cells, merges by id, keyword counts where texts are read."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from lectern.operators import longsections
from lectern.operators.sections import line_chunks
from lectern.sources import collection
from lectern.sources.keyword_index import KeywordIndex, add_to_index

TEXT = ["CHAPITRE 1", "un deux trois", "", "## A", "quatre cinq six sept", "<!-- page: 2 -->", "CHAPITRE 1", "## B", "huit", "CHAPITRE 2", "neuf dix"]


def chunks(frame):
    return sorted(str(r) for r in frame.collect())


def test_short_documents_equal_the_scans(spark):
    rows = [(d, i, t) for d in ("a", "b", None) for i, t in enumerate(TEXT)]
    rows += [("null", 0, "CHAPITRE 1"), ("null", 1, None), ("null", 2, "mot")]
    rows += [("twice", i, t) for i, t in enumerate(TEXT) for _ in range(2)]
    rows += [("long", i, t) for i, t in enumerate(TEXT * 4)]
    frame = spark.createDataFrame(rows, "doc string, pos int, line string")
    segment = F.floor(F.col("pos") / 4)
    for use_anchor in (False, True):
        def run(doc_lines, use_anchor=use_anchor):
            return chunks(line_chunks(frame, ["doc"], ["pos"], segment, limit=4, use_anchor=use_anchor, doc_lines=doc_lines))

        def known(rows):
            return [r for r in rows if not r.startswith("Row(doc=None")]

        wanted, some, all_of_them = run(0), run(len(TEXT)), run(1024)
        assert known(some) == known(wanted) == known(all_of_them) and len(known(wanted)) > 20
        nobody = [r.replace("doc='a'", "doc=None") for r in some if "doc='a'" in r]
        assert sorted(nobody) == [r for r in some if r not in known(some)]


def test_short_documents_move_once(spark):
    frame = spark.createDataFrame([(d, i, t) for d in range(40) for i, t in enumerate(TEXT)], "doc long, pos int, line string")
    found = line_chunks(frame, ["doc"], ["pos"], F.floor(F.col("pos") / 4), use_anchor=False)
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "Window" not in plan and "Exchange" not in plan


def test_segments_are_put_together(spark, monkeypatch):
    units = spark.createDataFrame(
        [("k", i if i % 9 else None, i, 0, 1 + i % 3, -1) for i in range(400)],
        "key string, seg long, par int, sub int, n long, run long",
    ).withColumn("seg", F.floor(F.col("par") / 3))
    got = {}
    for size in (1, 64, 4096):
        monkeypatch.setattr(longsections, "UNITS", size)
        packed = longsections.pack_rows(units, ["key"], ["par", "sub"], "seg", "n", "run", 7)
        got[size] = [r.chunk for r in packed.orderBy("par").collect()]
    assert got[1] == got[64] == got[4096] and len(got[1]) == 400
    lost = units.withColumn("seg", F.lit(None).cast("long"))
    assert longsections.pack_rows(lost, ["key"], ["par", "sub"], "seg", "n", "run", 7).count() == 400


@pytest.fixture
def name(spark):
    table = "moved_" + uuid.uuid4().hex
    collection.ensure_collection(spark, table, 2, versioned=True)
    yield table
    collection.drop_collection(spark, table)


def test_new_points_leave_stored_files_alone(spark, name):
    kind = spark.table(name).schema["payload"].dataType.simpleString()

    def batch(ids, version, document):
        frame = spark.createDataFrame([(i, [1.0, 2.0], version) for i in ids], "id string, vector array<float>, version long")
        payload = F.from_json(F.to_json(F.struct(F.lit(document).alias("document_id"))), kind).alias("payload")
        return frame.select("id", "vector", payload, "version")

    collection.merge_points(batch([f"a{i}" for i in range(200)], 1, "one"), name, True)
    before = set(spark.table(name).inputFiles())
    counts = collection.merge_points(batch([f"b{i}" for i in range(200)], 2, "two"), name, True)
    assert counts == {"added": 200, "replaced": 0, "late": 0, "removed": 0, "set_aside": 0}
    spark.catalog.refreshTable(name)
    assert before < set(spark.table(name).inputFiles()) and spark.table(name).count() == 400
    assert collection.merge_points(batch(["b1"], 3, "two"), name, True)["removed"] == 199
    assert spark.table(name).count() == 201


def test_rows_of_one_id_are_one_item(spark, tmp_path):
    rows = [(1, "mot mot cle"), (1, "cle"), (1, ""), (None, "mot"), (None, "fin"), (2, ""), (3, None), (4, "Mot")]
    path = str(tmp_path / "index")
    add_to_index(spark.createDataFrame(rows, "item_id long, text string"), path)
    index = KeywordIndex(spark, path)
    found = sorted(((r.item_id, tuple(sorted(r.terms.items())), r.length) for r in index.items.collect()), key=str)
    assert found == sorted(
        [(1, (("cle", 2), ("mot", 2)), 4), (1, (), 0), (None, (("fin", 1), ("mot", 1)), 2), (2, (), 0), (4, (("mot", 1),), 1)], key=str
    )
    assert len(os.listdir(f"{path}/items")) == 1
    asked = spark.createDataFrame([(9, "mot")], "query_id long, text string")
    assert {r.item_id for r in index.search(asked, 5).collect()} == {1, None, 4}
