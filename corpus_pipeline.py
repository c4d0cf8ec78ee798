"""Corpus pipeline: language, repeated lines, near duplicates, benchmark spans, mixing.

Every stage takes all documents that the one before kept and gives back the columns of
``documents``; the last adds each document's size, its source's target and its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.decontaminate import remove_items
from lectern.llm.langid import UNKNOWN, fit, identify
from lectern.llm.linededup import remove_boilerplate
from lectern.llm.mixing import mix_sources
from lectern.llm.ngramjoin import similarity_components
from lectern.session import reliable_checkpoint, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Near duplicates: shingles of five words, a similarity of 0.8 or more.
WIDTH, PERCENT = 5, 80
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts that are null or without letters go.

    Where no document has a language to learn from, all texts with a letter stay.
    """
    own = docs.select(*COLUMNS)
    model = fit(own)
    if not model.langs:
        return own.filter(F.col("text").rlike(r"\p{L}"))
    return identify(own, model).filter(F.col("lang_pred") != UNKNOWN).select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, but for their first place; documents left without words go."""
    cut = remove_boilerplate(docs.select(*COLUMNS))
    return _documents(cut.filter((F.col("n_removed") == 0) | F.col("text").rlike(_HAS_WORD)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id stays, once.

    Documents without id cannot be told apart and stay. Different texts under one id are
    documents of their own, which come after all others in the choice; equal ones are one.
    """
    own = docs.select(*COLUMNS)
    repeated = own.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    repeated = reliable_checkpoint(repeated.withColumn("__several", F.lit(True)))
    nodes = own.withColumn("__node", F.col("doc_id")).withColumn("__several", F.lit(None).cast("boolean"))
    if not repeated.isEmpty():
        # From 2 ** 62 on, so that they do not meet ids and are larger.
        apart = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
        node = F.when(F.col("__several"), apart).otherwise(F.col("doc_id")).alias("__node")
        path = scratch_path(spark, "nodes")
        own.join(repeated, "doc_id", "left").select(*COLUMNS, node, "__several").write.parquet(path)
        nodes = spark.read.parquet(path)
    texts = nodes.select(F.col("__node").alias("doc_id"), "text")
    groups = reliable_checkpoint(similarity_components(texts, WIDTH, PERCENT))
    later = groups.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__node")).distinct()
    first = nodes.join(later, "__node", "left_anti")
    once = first.filter("__several").dropDuplicates(["__node"])
    return first.filter("__several IS NULL").unionByName(once).select(*COLUMNS)


def benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items are cut out; documents that are mostly such spans go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(remove_items(docs.select(*COLUMNS), items))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies (1 to 3)."""
    mixed = mix_sources(docs.select(*COLUMNS), keep=COLUMNS)
    return mixed.filter(F.col("copies") > 0).select(*COLUMNS, "size", "target", "copies")


STAGES = [
    ("language id", language),
    ("line dedup", repeated_lines),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_spans),
    ("source mixing", mixing),
]

# Language identification has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        out = scratch_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
