import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import as_rows
from lectern.plans.catalog import QUERIES
from lectern.plans.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "token_thresholds",
    "page_items",
    "page_asof",
    "section_paths",
    "chunk_pack_lines",
    "knn_filtered",
    "bm25_search",
    "eval_questions",
    "topic_rewrite",
    "document_assembly",
    "page_tracking",
    "document_files",
    "index_files",
    "rewritten_files",
    "passage_metrics_bm25",
    "yes_no_reranked",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_oracle(spark, db, name):
    frame = queries()[name](spark, FOLDER)
    result = db.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert as_rows(frame.columns, frame.collect()) == as_rows(columns, result.fetchall())


def test_entry_reports_every_k(spark):
    rows = entry(spark).orderBy("k").collect()
    assert [r.k for r in rows] == [1, 3, 5, 10]
    rates = [r.hit_rate for r in rows]
    assert rates == sorted(rates) and all(r.mrr <= r.hit_rate for r in rows)


@pytest.mark.parametrize("name", ["knn_topk", "rrf_hybrid", "label_quality_join", "chunk_pack_lines"])
def test_no_plan_pairs_all_rows(spark, name):
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_chunking_a_cell_needs_no_shuffle(spark):
    from pyspark.sql import functions as F

    from lectern.operators.sections import document_chunks

    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    chunks = document_chunks(documents).filter(F.col("token_count") > 10)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
