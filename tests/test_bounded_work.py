"""Work that grows with the input and no faster: searches, packs, sized files, one Python stage."""

import os

import numpy as np
import pytest

from lectern.operators import dense
from lectern.operators.layout import page_stats
from lectern.plans.catalog import QUERIES
from lectern.sources import files, vector_index
from lectern.sources.vector_index import VectorIndex, write_vector_index


def near(frame):
    return sorted((r.query_id, r["rank"], r.item_id, r.similarity) for r in frame.collect())


@pytest.fixture(scope="module")
def embeddings(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    folder = str(tmp_path_factory.mktemp("vectors"))
    rows = [(i, rng.normal(size=6).tolist(), i % 3) for i in range(1, 90)] + [(None, [1.0] * 6, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def nearest(spark, folder, k, alike=False, other=False):
    """Similarity of every vector's k best items (of its label, without itself), by brute force."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    units = np.array([r.embedding for r in rows], dtype=float)
    units /= np.linalg.norm(units, axis=1)[:, None]
    scores = np.round(units @ units.T, 9)
    found = {}
    for i, row in enumerate(rows):
        allowed = [j for j in range(len(rows)) if not alike or rows[j].label == row.label]
        allowed = [j for j in allowed if not other or i != j]
        order = sorted(allowed, key=lambda j: (-scores[i, j], rows[j].vec_id is not None, rows[j].vec_id))[:k]
        found[row.vec_id] = [(rows[j].vec_id, round(float(scores[i, j]), 6), rows[j].label) for j in order]
    return found, {r.vec_id: r.label for r in rows}


WHOLE = [("vector_index_search", 10, False), ("knn_topk", 10, False), ("knn_filtered", 5, True)]


@pytest.mark.parametrize("name, k, alike", WHOLE)
def test_searches_ask_every_vector(spark, embeddings, name, k, alike):
    rows = sorted(QUERIES[name](spark, embeddings).collect(), key=lambda r: r["rank"])
    wanted, _ = nearest(spark, embeddings, k, alike)
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r.item_id, r.similarity))
    assert len(found) == 90
    assert found == {q: [x[:2] for x in best] for q, best in wanted.items()}


def rates(lists, labels):
    """Hit rate and mean reciprocal rank of lists of items by query."""
    firsts = [next((n for n, x in enumerate(best, 1) if x[2] == labels[q]), 99) for q, best in lists.items()]
    return {
        k: (round(sum(n <= k for n in firsts) / len(firsts), 6), round(sum(1 / n for n in firsts if n <= k) / len(firsts), 6))
        for k in (1, 3, 5, 10)
    }


@pytest.fixture(scope="module")
def named(spark, embeddings, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("named"))
    spark.read.parquet(f"{embeddings}/embeddings.parquet").filter("vec_id IS NOT NULL").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_dense_metrics_ask_every_vector(spark, named):
    lists, labels = nearest(spark, named, 10, other=True)
    found = QUERIES["retrieval_metrics_dense"](spark, named).collect()
    assert len(lists) == 89 and {r.k: (r.hit_rate, r.mrr) for r in found} == rates(lists, labels)


def test_reranked_metrics_ask_every_vector(spark, named):
    lists, labels = nearest(spark, named, 30, other=True)
    assert len(lists) == 89
    for q, best in lists.items():
        best.sort(key=lambda x: -1 / (1 + abs(labels[q] + 1 - x[2])))
    found = QUERIES["retrieval_metrics_reranked"](spark, named).collect()
    assert {r.k: (r.hit_rate, r.mrr) for r in found} == rates(lists, labels)


def test_index_search_in_slices_keeps_copies_in_order(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 - i, rows[0][1]) for i in range(300)]  # one vector many times
    items = spark.createDataFrame(rows, "item_id long, vector array<double>")
    queries = spark.createDataFrame([(i, v) for i, v in rows if i % 20 == 0] + [(7, [0.0] * 8)], "query_id long, vector array<double>")
    write_vector_index(items, str(tmp_path / "index"), ring=32)
    wanted = near(dense.dense_topk(queries, items, 12, broadcast_bytes=1 << 20))
    sizes = []
    few = dense.query_slices

    def small(*args):
        parts = few(*args, 800)
        sizes.append(len(parts))
        return parts

    monkeypatch.setattr(vector_index, "query_slices", small)
    assert near(VectorIndex(spark, str(tmp_path / "index")).search(queries, 12)) == wanted
    assert sizes[0] > 1 and len(wanted) == 12 * (queries.count() - 1)


def test_few_copies_keeps_the_smallest_ids():
    import pyarrow as pa

    items = np.array([[1.0, 2.0]] * 5 + [[2.0, 1.0]])
    kept = dense.few_copies(items, pa.array([9, 3, 8, 1, 5, 7]), 2)
    assert kept.tolist() == [1, 3, 5]


def test_documents_are_found_in_packs_and_alone(spark, tmp_path):
    folder = tmp_path / "text" / "A_full_document"
    folder.mkdir(parents=True)
    (folder / "a_full_document.md").write_text("allein")
    names = ["B_full_document/b_full_document.md", "_hidden/c_full_document.md", "D/page_1.md", "E/e.txt"]
    rows = [(name, f"in {name}".encode() + b"\xff") for name in names]
    packs = str(tmp_path / "packs")
    files.write_packs(spark.createDataFrame(rows, "path string, content binary"), packs)
    found = files.read_full_documents(spark, str(tmp_path / "text"), packs=packs).collect()
    assert {(r.doc_id, r.source_file) for r in found} == {("a", "a_full_document.md"), ("b", "b_full_document.md")}
    assert {r.text for r in found} == {"allein", f"in {names[0]}"}
    pages = files.read_page_files(spark, str(tmp_path / "text"), packs=packs).collect()
    assert [(r.file, r.text) for r in pages] == [("page_1.md", f"in {names[2]}�")]
    with pytest.raises(FileNotFoundError):
        files.read_full_documents(spark, str(tmp_path / "text"), "*.{pdf,doc}", packs)
    both = files.read_full_documents(spark, str(tmp_path / "text"), "*.{md,txt}", packs)
    assert both.count() == 4


def test_indexes_of_many_documents_share_files(spark, tmp_path):
    items = spark.createDataFrame(
        [(d, i, i + 1, "text", "x") for d in range(300) for i in range(2)],
        "doc_id long, item_pos int, page_no int, label string, text string",
    )
    path = str(tmp_path / "index")
    files.write_index(page_stats(items), path, by_size=True)
    assert len([n for n in os.listdir(path) if n.startswith("file=")]) == 1
    rows = files.read_by_size(spark, path, "doc_id long, page_no int, line string").collect()
    assert len(rows) == 900 and sum(r.line == "# Page index (2 pages)" for r in rows) == 300
