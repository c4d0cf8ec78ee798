"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores and
``BENCH_QUERIES`` (optional, comma-separated) a choice of queries. Each query is built and
run to the end once, after one small query has started the session and its workers.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from lectern.plans.catalog import QUERIES
from lectern.session import build_session

HEADLINES = (
    "token_distribution",
    "token_thresholds",
    "largest_documents",
    "value_frequency_topk",
    "numeric_line_signal",
    "page_items",
    "page_stats",
    "document_assembly",
    "page_asof",
    "section_paths",
    "conversation_chunks",
    "markdown_chunks",
    "content_anchor_lines",
    "sentence_units",
    "chunk_pack_lines",
    "chunk_summary",
    "knn_topk",
    "centroid_search",
    "upsert_collection",
    "retrieval_metrics_dense",
    "hash_embed",
    "dense_text_topk",
    "bm25_search",
    "rrf_hybrid",
    "hybrid_reranked",
    "passage_metrics_reranked",
    "eval_candidates",
    "eval_questions",
    "topic_rewrite",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINES
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="lectern-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["knn_topk"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
