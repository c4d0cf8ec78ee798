"""From layout items to documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.arrays import rows_of
from lectern.functions.text import TokenCounter, count_tokens, split_lines
from lectern.operators.layout import SEGMENT_ITEMS, marked_blocks
from lectern.operators.sections import chunk_ids, document_chunks, line_chunks
from lectern.sources.files import read_chunks, read_full_documents, write_chunks


def chunk_items(
    items: DataFrame, counter: TokenCounter = count_tokens, limit: int = fixed.MAX_CHUNK_TOKENS
) -> DataFrame:
    """Chunks straight from layout items, without joining a document into one text."""
    lines = split_lines(F.concat("block", F.lit("\n\n")))
    blocks = rows_of(marked_blocks(items), ["doc_id", "item_pos"], lines, "line_pos", "line")
    return line_chunks(
        blocks,
        ["doc_id"],
        ["item_pos", "line_pos"],
        F.floor(F.col("item_pos") / SEGMENT_ITEMS),
        counter=counter,
        limit=limit,
    )


def chunk_table(
    documents: DataFrame, counter: TokenCounter = count_tokens, limit: int = fixed.MAX_CHUNK_TOKENS
) -> DataFrame:
    """Chunk records of ``doc_id, source_file, text`` documents, ids included."""
    return (
        document_chunks(documents, "text", counter, limit)
        .withColumnRenamed("doc_id", "document_id")
        .withColumn("chunk_id", chunk_ids(F.col("document_id"), F.col("chunk_index")))
    )


def chunk_folder(spark, root: str, out: str, limit: int = fixed.MAX_CHUNK_TOKENS) -> DataFrame:
    """Chunk all full-document files below ``root`` into JSON lines; counts per document."""
    chunks = chunk_table(read_full_documents(spark, root), limit=limit)
    write_chunks(chunks, out, by_document=True)
    return read_chunks(spark, out, "*.json").groupBy("document_id").agg(F.count("*").alias("n_chunks"))
