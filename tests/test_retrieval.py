import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import models
from lectern.functions import text as T
from lectern.functions.vectors import cosine, hash_embedder, sigmoid
from lectern.operators.dense import dense_topk
from lectern.operators.fusion import reciprocal_rank_fusion
from lectern.operators.metrics import gold_matches, normalise_gold, retrieval_metrics
from lectern.operators.rerank import rerank
from lectern.operators.sparse import bm25_topk
from lectern.plans import catalog, retrieval


def vectors(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} string, vector array<float>, g int")


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(3)
    items = [(f"i{n:03d}", rng.normal(size=5).tolist(), n % 3) for n in range(90)]
    items += [(f"j{n:03d}", items[0][1], 0) for n in range(40)]  # a hot group of copies
    items += [("zero", [0.0] * 5, 0)]
    queries = [(f"q{n}", rng.normal(size=5).tolist(), n % 3) for n in range(7)] + [("q9", items[0][1], 0)]
    return queries, items


def brute_force(queries, items, k, within):
    out = set()
    for key, q, group in queries:
        scored = []
        for item, v, other in items:
            a, b = np.float32(q).astype(float), np.float32(v).astype(float)
            if not b.any() or (within and group != other):
                continue
            scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), item))
        out |= {(key, item, rank) for rank, (_, item) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("within", [None, "g"])
@pytest.mark.parametrize("bound", [1 << 20, 200])
def test_dense_equals_brute_force(spark, pairs, within, bound):
    queries, items = pairs
    found = dense_topk(
        vectors(spark, queries, "query_id"),
        vectors(spark, items, "item_id").repartition(5),
        12,
        within=within,
        broadcast_bytes=bound,
    ).collect()
    assert {(r.query_id, r.item_id, r["rank"]) for r in found} == brute_force(queries, items, 12, within)


def test_cosine_of_zero_vector_is_null(spark):
    row = spark.sql("SELECT array(3f, 4f) a, array(0f, 0f) b, array(4f, 3f) c").select(
        cosine(F.col("a"), F.col("b")).alias("n"),
        cosine(F.col("a"), F.col("c")).alias("s"),
        sigmoid(F.lit(0.0)).alias("h"),
    ).first()
    assert row.n is None and row.s == pytest.approx(0.96) and row.h == 0.5


TEXTS = [("a", "le train part, le train arrive"), ("b", "le quai"), ("c", "train de nuit"), ("d", ""), ("e", "le quai")]


def bm25(queries, items, k):
    docs = {key: text.lower().replace(",", "").split() for key, text in items}
    average = sum(map(len, docs.values())) / len(docs)
    out = set()
    for key, text in queries:
        scores = {}
        for term in set(text.lower().split()):
            df = sum(term in words for words in docs.values())
            for item, words in docs.items():
                tf = words.count(term)
                if tf:
                    weight = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    gain = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
                    scores[item] = scores.get(item, 0) + weight * gain
        best = sorted((-round(s, 9), item) for item, s in scores.items())[:k]
        out |= {(key, item, rank) for rank, (_, item) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("bound", [1000, 1])
@pytest.mark.parametrize("texts", [TEXTS, [*TEXTS, *[(f"h{i:03}", "le " * i) for i in range(60)]]])
def test_bm25_equals_the_formula(spark, bound, texts):
    queries = [("q1", "Train quai"), ("q2", "nuit le"), ("q3", "rien"), ("q4", ""), ("q5", "le")]
    found = bm25_topk(
        spark.createDataFrame([*queries, ("q6", None)], "query_id string, text string"),
        spark.createDataFrame([*texts, ("n1", None), ("n2", None)], "item_id string, text string"),
        3,
        broadcast_terms=bound,
    ).collect()
    assert {(r.query_id, r.item_id, r["rank"]) for r in found} == bm25(queries, texts, 3)


def test_bm25_of_no_items_and_no_queries(spark):
    texts = spark.createDataFrame(TEXTS, "item_id string, text string")
    asked = spark.createDataFrame([("q", "train")], "query_id string, text string")
    assert bm25_topk(asked, texts.limit(0), 3).collect() == []
    assert bm25_topk(asked.limit(0), texts, 3).collect() == []


def test_dense_search_of_unequal_sizes_is_an_error(spark):
    good = spark.createDataFrame([("a", [1.0, 2.0])], "item_id string, vector array<float>")
    bad = spark.createDataFrame([("b", [1.0]), ("c", [1.0, 2.0, 3.0])], "item_id string, vector array<float>")
    asked = good.withColumnRenamed("item_id", "query_id")
    with pytest.raises(Exception, match="dimensions"):
        dense_topk(asked, good.union(bad).coalesce(1), 2).collect()
    with pytest.raises(ValueError, match="dimensions"):
        dense_topk(bad.withColumnRenamed("item_id", "query_id"), good, 2)


def test_labels_only_meet_their_own(spark):
    rows = [(i, [float(i + 1), 1.0], lab) for i, lab in enumerate(["x", "y", None, "x"])]
    frame = spark.createDataFrame(rows, "item_id long, vector array<float>, g string")
    asked = frame.withColumnRenamed("item_id", "query_id")
    for bound in (1 << 20, 100):
        found = dense_topk(asked, frame, 5, within="g", broadcast_bytes=bound).collect()
        assert {(r.query_id, r.item_id) for r in found} == {(0, 0), (0, 3), (3, 0), (3, 3), (1, 1)}


def test_a_blank_query_is_an_error(spark):
    embed = models.embedder(lambda: lambda texts, mode: np.ones((len(texts), 2)), "query")
    for text in ("", "  ", None):
        frame = spark.createDataFrame([(text,)], "text string")
        with pytest.raises(Exception, match="non-empty"):
            frame.select(embed(F.col("text"))).collect()


def test_fusion_and_hybrid(spark):
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, item_id string, rank int")
    second = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, item_id string, rank int")
    fused = reciprocal_rank_fusion([first, second], 2).orderBy("rank").collect()
    assert [r.item_id for r in fused] == ["b", "a"]
    assert fused[0].score == pytest.approx(1 / 61 + 1 / 62)
    embed = lambda c: hash_embedder(16)(T.tokens(c))
    asked = spark.createDataFrame([(1, "train de nuit")], "query_id int, text string")
    items = spark.createDataFrame(TEXTS, "item_id string, text string")
    plain = retrieval.hybrid_retrieve(asked, items, embed, embed).orderBy("rank").collect()
    assert plain[0].item_id == "c"
    scored = retrieval.hybrid_retrieve(asked, items, embed, embed, catalog.overlap, top_k=2)
    assert [r.item_id for r in scored.orderBy("rank").collect()] == ["c", "a"]
    gold = spark.createDataFrame([(1, "c")], "query_id int, item_id string")
    metrics = retrieval.evaluate_retrieval(asked, items, gold, embed, embed, catalog.overlap).collect()
    assert [(m.k, m.hit_rate, m.mrr) for m in metrics] == [(k, 1.0, 1.0) for k in (1, 3, 5, 10)]


def test_equal_scores_keep_first_stage_order(spark):
    rows = [(1, c, "q", "t", r) for r, c in enumerate("badc", 1)]
    frame = spark.createDataFrame(rows, "query_id int, item_id string, query string, text string, rank int")
    best = rerank(frame, lambda q, t: F.lit(0.5), top_k=3).orderBy("rank").collect()
    assert [r.item_id for r in best] == ["b", "a", "d"]


def test_models_run_inside_tasks(spark):
    def load_scorer():
        return lambda queries, texts: np.array([len(t) for t in texts], dtype=float)

    def load_embedder():
        return lambda texts, mode: np.array([[len(t), mode == "query"] for t in texts], dtype=float)

    frame = spark.createDataFrame([("q", "a"), ("q", "abc")], "q string, t string")
    score = models.scorer(load_scorer)
    assert [r.s for r in frame.select(score(F.col("q"), F.col("t")).alias("s")).collect()] == [1.0, 3.0]
    embed = models.embedder(load_embedder, "query")
    assert [list(r.v) for r in frame.select(embed(F.col("t")).alias("v")).collect()] == [[1, 1], [3, 1]]
    blank = spark.createDataFrame([(" ",)], "t string")
    with pytest.raises(Exception, match="non-empty"):
        blank.select(models.embedder(load_embedder, "document")(F.col("t"))).collect()
    prompt = frame.select(models.rerank_prompt(F.col("q"), F.col("t"), "T").alias("p")).first().p
    assert prompt == "<Instruct>: T\n<Query>: q\n<Document>: a"
    half = frame.select(models.yes_probability(F.lit(1.0), F.lit(1.0)).alias("p")).first().p
    assert half == 0.5


def test_metrics_with_several_gold_items(spark):
    questions = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    ranked = spark.createDataFrame(
        [(1, f"c{r}", r) for r in range(1, 12)] + [(2, "x", 1), (3, "c11", 11)],
        "query_id int, item_id string, rank int",
    )
    gold = spark.createDataFrame(
        [(1, "c4"), (1, "c2"), (2, "y"), (3, "c11"), (4, "z")], "query_id int, item_id string"
    )
    rows = {r.k: (r.hit_rate, r.mrr) for r in retrieval_metrics(questions, gold_matches(ranked, gold)).collect()}
    assert rows == {1: (0.0, 0.0), 3: (0.25, 0.125), 5: (0.25, 0.125), 10: (0.25, 0.125)}
    assert retrieval_metrics(questions.limit(0), gold_matches(ranked, gold)).count() == 0


def test_gold_forms(spark):
    listed = spark.createDataFrame([("q", ["a", "b"])], "question string, gold_chunk_ids array<string>")
    single = spark.createDataFrame([("q", "a")], "question string, chunk_id string")
    curated = spark.createDataFrame([("q", '["a", "b"]'), ("r", "a")], "Question string, Gold_chunk_id string")
    assert normalise_gold(listed).first().gold_chunk_ids == ["a", "b"]
    assert normalise_gold(single).first().gold_chunk_ids == ["a"]
    rows = normalise_gold(curated).orderBy("question").collect()
    assert [(r.question, r.gold_chunk_ids) for r in rows] == [("q", ["a", "b"]), ("r", ["a"])]


def test_passages_are_found_word_for_word(spark):
    rows = [(1, 7, 1, "ab", "xabcx"), (2, 7, 1, "", "ab"), (3, 8, 2, "ab", None), (4, 8, 1, None, "ab"), (5, 9, 1, "zz", "z z")]
    ranked = spark.createDataFrame(rows, "query_id long, item_id long, rank int, query string, text string")
    assert [r.query_id for r in catalog._containing(ranked).collect()] == [1]
