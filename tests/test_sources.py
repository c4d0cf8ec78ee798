import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.vectors import hash_embedder
from lectern.operators import quarantine
from lectern.operators.layout import document_lines, page_stats
from lectern.operators.metrics import normalise_gold
from lectern.plans.corpus import chunk_folder, chunk_table
from lectern.sources import collection, files
from lectern.streaming.indexing import index_stream


def embed(text):
    return hash_embedder(8)(T.tokens(text))


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "text" / "DRR-2025_full_document"
    folder.mkdir(parents=True)
    (folder / "x_full_document.md").write_bytes("CHAPITRE 1\nété \n## A\nmot".encode() + b"\xff")
    (folder / "page_0001.md").write_bytes(b"un deux\xff")
    (folder / "Page_0002.md").write_text("trois")
    bare = tmp_path / "text" / "-_-"
    bare.mkdir()
    (bare / "Y_full_document.md").write_text("CHAPITRE 2\nfin")
    return tmp_path


def test_documents_pages_and_ids(spark, corpus):
    rows = {r.doc_id: r for r in files.read_full_documents(spark, str(corpus / "text")).collect()}
    assert set(rows) == {"drr-2025", "Y_full_document"}
    assert rows["drr-2025"].text.endswith("mot") and rows["drr-2025"].source_file == "x_full_document.md"
    pages = {r.file: r.text for r in files.read_page_files(spark, str(corpus / "text")).collect()}
    assert pages == {"page_0001.md": "un deux�", "Page_0002.md": "trois"}
    (corpus / "none").mkdir()
    for read in (files.read_full_documents, files.read_page_files):
        with pytest.raises(FileNotFoundError):
            read(spark, str(corpus / "none"))


def test_chunk_files_round_trip(spark, corpus):
    out = str(corpus / "chunks")
    counts = {r.document_id: r.n_chunks for r in chunk_folder(spark, str(corpus / "text"), out).collect()}
    assert counts == {"drr-2025": 2, "Y_full_document": 1}
    record = spark.read.text(out).filter("value like '%drr-2025_chunk_0000%'").first().value
    assert list(json.loads(record)) == files.CHUNK_SCHEMA.names and "été" in record


def test_chunk_records_are_checked(spark, tmp_path):
    good = {"chunk_id": "a", "document_id": "d", "text": "t", "section_path": None, "page_start": 1, "page_end": None}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(good) + "\n")
    assert files.read_chunks(spark, str(tmp_path)).count() == 2
    assert files.read_chunks(spark, str(tmp_path)).first().page_start == 1
    del good["page_end"]
    (tmp_path / "b.jsonl").write_text(json.dumps(good))
    with pytest.raises(Exception, match="bad chunk record"):
        files.read_chunks(spark, str(tmp_path)).collect()


def test_questions_from_file_or_folder(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "q1", "gold_chunk_ids": ["a"]}\n\n')
    (tmp_path / "b.jsonl").write_text('{"question": "q2", "gold_chunk_ids": ["b"]}\n')
    (tmp_path / "c.txt").write_text("no")
    assert files.read_questions(spark, str(tmp_path)).count() == 2
    assert files.read_questions(spark, str(tmp_path / "a.jsonl")).count() == 1
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        files.read_questions(spark, str(tmp_path / "empty"))
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        files.read_questions(spark, str(tmp_path / "missing"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.jsonl").write_text('{"question": "q1"}\nno json\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_questions(spark, str(tmp_path / "bad")).select("question").collect()


def test_curated_questions(spark, tmp_path):
    items = [
        {"Question": "q1", "Gold_chunk_id": "a", "golden_answer": "x"},
        {"Question": "q2", "Gold_chunk_id": ["a", "b"], "golden_answer": "y"},
    ]
    (tmp_path / "c.json").write_text(json.dumps(items, indent=2))
    rows = normalise_gold(files.read_curated_questions(spark, str(tmp_path))).orderBy("question").collect()
    assert [(r.question, r.gold_chunk_ids, r.golden_answer) for r in rows] == [
        ("q1", ["a"], "x"),
        ("q2", ["a", "b"], "y"),
    ]


def test_line_limit_counts_blank_and_bad_lines(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"question": "a"}\n\nnot json\n{"question": "b"}\n{"question": "c"}\n')
    rows = files.read_question_lines(spark, str(path), "question string", limit=4).orderBy("line_no").collect()
    assert [(r.line_no, r.question) for r in rows] == [(1, "a"), (4, "b")]
    many = tmp_path / "many.jsonl"
    many.write_text("".join(f'{{"question": "{n}"}}\n' for n in range(2000)))
    rows = files.read_question_lines(spark, str(many), "question string").orderBy("line_no").collect()
    assert [(r.line_no, r.question) for r in rows] == [(n + 1, str(n)) for n in range(2000)]


def test_index_round_trip(spark, tmp_path):
    items = spark.createDataFrame(
        [("d", 0, 1, "title", "T"), ("d", 1, 2, "text", "x")],
        "doc_id string, item_pos int, page_no int, label string, text string",
    )
    stats = page_stats(items)
    files.write_index(stats, str(tmp_path / "index"))
    read = files.read_page_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, read.drop("doc_id").collect())) == sorted(
        map(tuple, stats.select("page_no", "n_chars", "n_items", "n_headings", "n_tables").collect())
    )
    files.write_page_texts(items, str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 2
    files.write_statistics(stats, str(tmp_path / "stats"))
    assert spark.read.csv(str(tmp_path / "stats"), header=True).count() == 2


def chunks(spark, n):
    texts = [(f"d{i}", "s.md", f"CHAPITRE 1\nmot {i}") for i in range(n)]
    return chunk_table(spark.createDataFrame(texts, "doc_id string, source_file string, text string"))


def test_collection_life_cycle(spark):
    name = "points_test"
    assert collection.ensure_collection(spark, name, dim=8)
    assert not collection.ensure_collection(spark, name, dim=8)
    batch = collection.points(chunks(spark, 3), embed)
    collection.append_points(collection.check_dimension(batch, name), name)
    collection.append_points(batch, name)
    assert collection.open_collection(spark, name).count() == 6
    collection.drop_collection(spark, name)
    collection.ensure_collection(spark, name, dim=8)
    collection.upsert_points(batch, name)
    collection.upsert_points(collection.points(chunks(spark, 5), embed), name)
    stored = collection.open_collection(spark, name)
    assert stored.count() == 5 and stored.select("payload.id").distinct().count() == 5
    assert collection.collection_properties(spark, name)["dim"] == "8"
    stats = collection.vector_stats(stored).first()
    assert (stats.n_vectors, stats.min_dim, stats.max_dim, stats.n_zero) == (5, 8, 8, 0)
    wrong = batch.withColumn("vector", F.slice("vector", 1, 3))
    with pytest.raises(Exception, match="vector size is not 8"):
        collection.check_dimension(wrong, name).collect()
    assert collection.drop_collection(spark, name) and not collection.drop_collection(spark, name)


def test_upsert_leaves_other_slots_alone(spark):
    name = "slots_test"
    collection.ensure_collection(spark, name, dim=8)
    collection.append_points(collection.points(chunks(spark, 40), embed), name)
    before = {f for f in spark.table(name).inputFiles()}
    one = collection.points(chunks(spark, 1), embed)
    slot = collection._slotted(one).first().slot
    older, newer = (one.withColumn("payload", F.col("payload").withField("text", F.lit(t))).withColumn("v", F.lit(v))
                    for t, v in (("zz older", 1), ("newer", 2)))
    collection.upsert_points(newer.union(older), name, order="v")
    after = {f for f in spark.table(name).inputFiles()}
    assert before - after and all(f"slot={slot}/" in f for f in before - after)
    stored = collection.open_collection(spark, name)
    assert stored.count() == 40 and stored.filter("payload.text = 'newer'").count() == 1
    collection.upsert_points(one.limit(0), name)
    assert collection.open_collection(spark, name).count() == 40
    collection.drop_collection(spark, name)


def test_index_stream_takes_each_file_once(spark, tmp_path):
    folder, store, mark = (str(tmp_path / n) for n in ("chunks", "points", "mark"))
    files.write_chunks(chunks(spark, 4), folder)
    index_stream(spark, folder, store, mark, embed, files_per_batch=2).awaitTermination()
    assert spark.read.parquet(store).count() == 4
    index_stream(spark, folder, store, mark, embed).awaitTermination()
    assert spark.read.parquet(store).count() == 4


def test_document_lines_round_trip(spark, tmp_path):
    items = spark.createDataFrame(
        [(d, i, i // 4, "text", f"bloc {i}\nfin") for d in ("a", "b") for i in range(300)],
        "doc_id string, item_pos int, page_no int, label string, text string",
    )
    lines = document_lines(items)
    files.write_document_lines(lines, str(tmp_path / "docs"))
    order = ["doc_id", "file", "block", "at"]
    read = [(r.doc_id, r.line) for r in files.read_document_lines(spark, str(tmp_path / "docs")).orderBy(*order).collect()]
    assert read == [(r.doc_id, r.line) for r in lines.orderBy("doc_id", "item_pos", "line_no").collect()]


def test_unusable_texts_are_set_aside(spark):
    rows = spark.createDataFrame(
        [("a", "text"), ("b", None), ("c", " "), ("d", "x\ufffd"), ("e", "more"), (None, None)], "name string, text string"
    )
    judged = quarantine.with_reason(rows, quarantine.text_rules(F.col("text")))
    assert sorted(r.name for r in quarantine.usable(judged).collect()) == ["a", "e"]
    assert {(r.name, r.reason) for r in quarantine.failures(judged, "name").collect()} == {
        ("b", "missing"), ("c", "blank"), ("d", "undecodable"), (None, "missing"),
    }
    counts = {r.reason: (r.n, r.first_name) for r in quarantine.failure_counts(judged, "name").collect()}
    assert counts == {None: (2, "a"), "missing": (2, "b"), "blank": (1, "c"), "undecodable": (1, "d")}
    with pytest.raises(ValueError, match="no usable input"):
        quarantine.usable(judged.filter("reason is not null"))
