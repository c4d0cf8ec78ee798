"""Queries of the training-data operators, one ``opN_`` each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.decontaminate import ORACLE as ITEM_ORACLE
from lectern.llm.decontaminate import contamination
from lectern.llm.langid import language_table
from lectern.llm.linededup import ORACLE as LINE_ORACLE
from lectern.llm.linededup import line_table
from lectern.llm.lm import score_documents
from lectern.llm.manifest import ORACLE as MANIFEST_ORACLE
from lectern.llm.manifest import manifest_table
from lectern.llm.mixing import ORACLE as MIX_ORACLE
from lectern.llm.mixing import mix_sources
from lectern.llm.ngramjoin import ORACLE as JOIN_ORACLE
from lectern.llm.ngramjoin import link_counts, similarity_components
from lectern.llm.pii import pii_digest
from lectern.llm.quality import quality_rules
from lectern.llm.tokencount import count_tokens
from lectern.llm.toxicity import toxicity_table
from lectern.llm.turnrepair import ORACLE as REPAIR_ORACLE
from lectern.llm.turnrepair import damage, repair_table
from lectern.llm.vectorsearch import ORACLE as SEARCH_ORACLE
from lectern.llm.vectorsearch import exact_top_k

TOKENIZER = "word_bpe_49k.json"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_components(_documents(spark, folder))


def op1_ngram_jaccard_links(spark: SparkSession, folder: str) -> DataFrame:
    return link_counts(_documents(spark, folder))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_table(_documents(spark, folder))


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(_documents(spark, folder))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_table(
        _documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    )


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(
        _documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")
    )


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_table(_documents(spark, folder))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_documents(spark, folder))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(_documents(spark, folder))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii_digest(_documents(spark, folder))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(_documents(spark, folder), public_tokenizers.path(TOKENIZER))


def op11_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return exact_top_k(vectors, F.col("vec_id") % 100 == 0)


def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_table(damage(spark.read.parquet(f"{folder}/conversations.parquet")))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest_table(_documents(spark, folder))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op1_ngram_jaccard_links": op1_ngram_jaccard_links,
    "op2_language_id": op2_language_id,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_source_mixing": op8_source_mixing,
    "op9_pii": op9_pii,
    "op10_token_counts": op10_token_counts,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_turn_repair": op12_turn_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": JOIN_ORACLE,
    "op5_benchmark_decontamination": ITEM_ORACLE,
    "op6_line_dedup": LINE_ORACLE,
    "op8_source_mixing": MIX_ORACLE,
    "op11_exact_top_k": SEARCH_ORACLE,
    "op12_turn_repair": REPAIR_ORACLE,
    "op13_merkle_manifest": MANIFEST_ORACLE,
}
