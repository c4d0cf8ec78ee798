import re

import pytest

import corpus_pipeline as P

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into and come out of every stage over the smallest tables."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs.collect()]
    for number, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
        seen.append(docs.collect())
    return seen


def test_stages_return_documents(spark, stages):
    for rows in stages[1:]:
        assert list(P.COLUMNS) == list(rows[0].asDict())[: len(P.COLUMNS)]
        assert all(r.n_chars == len(r.text) for r in rows)
    assert [name for name, _ in P.STAGES] == [
        "language id", "line dedup", "n-gram jaccard join", "benchmark decontamination", "source mixing",
    ]


def test_line_stage_equals_brute_force(stages):
    from test_text_operators import brute_lines

    before, after = stages[1], stages[2]
    want = brute_lines([(r.doc_id, r.text, r.lang, r.source) for r in before])
    kept = {i: t for i, t in want.items() if t == next(r.text for r in before if r.doc_id == i) or re.search(r"[^\x20\x09-\x0D]", t)}
    assert {r.doc_id: r.text for r in after} == kept


def test_near_duplicate_stage_equals_brute_force(stages):
    from test_similarity import brute

    before, after = stages[2], stages[3]
    groups, _ = brute([(r.doc_id, r.text) for r in before], P.WIDTH, P.PERCENT)
    assert sorted(r.doc_id for r in after) == sorted(i for i, c in groups.items() if i == c)


def test_benchmark_stage_leaves_no_window(spark, stages):
    from test_text_operators import brute_hits

    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in stages[3]}
    after = {r.doc_id: r.text for r in stages[4]}
    for i, text in before.items():
        n, hit, _ = brute_hits(text, items)
        assert (i in after) == (hit <= 0.5 * n)
        if hit == 0:
            assert after[i] == text
        elif i in after:
            assert len(after[i]) < len(text)


def test_nulls_and_repeated_rows(spark, documents):
    rows = [(1, None), (2, "12"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "A b c d e f g"), (None, "some words here")]
    docs = documents(rows)
    # Without labels nothing can be learned; only texts without a letter go.
    assert sorted(str(r.doc_id) for r in P.language(spark, docs, FOLDER).collect()) == ["3", "3", "4", "None"]
    kept = P.near_duplicates(spark, docs, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "4", "None"]
    assert P.repeated_lines(spark, docs, FOLDER).count() == 6
    assert P.benchmark_spans(spark, docs, FOLDER).count() == 6
    empty = documents([])
    assert all(stage(spark, empty, FOLDER).count() == 0 for _, stage in P.STAGES)


def test_texts_of_one_id_stay_unless_alike(spark, documents):
    words = [f"w{i}" for i in range(60)]
    alike, other = " ".join(words), " ".join(words[::-1])
    third = " ".join(f"x{i}" for i in range(30))
    rows = [(1, alike), (5, alike + " end"), (5, other), (6, third), (6, third), (7, third + " end"), (8, other), (9, ""), (9, None)]
    kept = P.near_duplicates(spark, documents(rows), FOLDER).collect()
    got = sorted((r.doc_id, r.text or "") for r in kept)
    assert got == [(1, alike), (7, third + " end"), (8, other), (9, ""), (9, "")]


def test_a_very_long_text_goes_through_every_stage(spark, documents):
    long_text = "\n".join(" ".join(f"wort{(i * 31 + k) % 9973}" for k in range(12)) for i in range(20_000))
    docs = documents([(1, long_text, "de", "a"), (2, "kurzer text hier", "de", "b")])
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, FOLDER)
        assert {r.doc_id: r.text for r in docs.collect()}[1] == long_text
    assert P.mixing(spark, docs, FOLDER).filter("doc_id = 1").first().n_chars == len(long_text)
