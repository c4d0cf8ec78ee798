"""Layout items to page text, page statistics and page-marked documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.arrays import rows_of
from lectern.functions.text import split_lines
from lectern.operators.scans import running_last, running_sum

SEGMENT_ITEMS = 4096


def usable_items(items: DataFrame) -> DataFrame:
    """Items with a page and a text; others carry nothing downstream."""
    return items.filter(F.col("page_no").isNotNull() & (F.col("text") != ""))


def is_table(label: Column) -> Column:
    return label == fixed.LABEL_TABLE


def is_heading(label: Column) -> Column:
    lowered = F.lower(label)
    named = lowered.contains(fixed.HEADING_LABEL_PARTS[0]) | lowered.contains(
        fixed.HEADING_LABEL_PARTS[1]
    )
    return ~is_table(label) & ((label == fixed.LABEL_SECTION_HEADER) | named)


def _marked_up(label: Column, text: Column, plain: Column) -> Column:
    return (
        F.when(is_table(label), F.concat(F.lit("### [TABLE]\n\n"), text))
        .when(is_heading(label), F.concat(F.lit("## ["), label, F.lit("] "), text))
        .otherwise(plain)
    )


def item_markdown(label: Column, text: Column) -> Column:
    """Item as it stands in the full document: plain items unlabelled."""
    return _marked_up(label, text, text)


def page_item_markdown(label: Column, text: Column) -> Column:
    """Item as it stands in a page file: plain items labelled."""
    return _marked_up(label, text, F.concat(F.lit("["), label, F.lit("] "), text))


def page_marker(page_no: Column) -> Column:
    return F.format_string(fixed.PAGE_MARKER_FORMAT, page_no)


def page_stats(items: DataFrame) -> DataFrame:
    """Characters, items, headings and tables per ``(doc_id, page_no)``.

    The length of the joined page text is computed from sums, so a page is never
    collected: the texts plus two characters between neighbours.
    """
    block = page_item_markdown(F.col("label"), F.col("text"))
    return (
        usable_items(items)
        .groupBy("doc_id", "page_no")
        .agg(
            (F.sum(F.length(block)) + 2 * (F.count("*") - 1)).alias("n_chars"),
            F.count("*").alias("n_items"),
            F.count_if(is_heading(F.col("label"))).alias("n_headings"),
            F.count_if(is_table(F.col("label"))).alias("n_tables"),
        )
    )


def corpus_totals(items: DataFrame) -> DataFrame:
    """Pages with items, items, headings, tables and characters of the whole corpus."""
    return page_stats(items).agg(
        F.count("*").alias("n_pages"),
        F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"),
        F.coalesce(F.sum("n_headings"), F.lit(0)).alias("n_headings"),
        F.coalesce(F.sum("n_tables"), F.lit(0)).alias("n_tables"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"),
    )


def index_lines(stats: DataFrame) -> DataFrame:
    """One index line per page, ``page_no`` giving the order."""
    line = F.format_string(
        "- **Page %04d** | %d chars | %d items | %d headings | %d tables -> `page_%04d.md`",
        F.col("page_no"),
        F.col("n_chars"),
        F.col("n_items"),
        F.col("n_headings"),
        F.col("n_tables"),
        F.col("page_no"),
    )
    return stats.select("doc_id", "page_no", line.alias("line"))


def preview_pages(stats: DataFrame, pages: int = 20) -> DataFrame:
    """Index lines of each document's first pages (a top-k report)."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    ranked = index_lines(stats).withColumn("__rank", rank)
    return ranked.filter(F.col("__rank") <= pages).drop("__rank")


def marked_blocks(items: DataFrame) -> DataFrame:
    """Blocks of the full document in item order, page markers put before page changes.

    The first block carries the marker of the document's lowest page, whatever its own.
    ``is_last`` marks the document's last block.
    """
    usable = usable_items(items)
    segment = F.floor(F.col("item_pos") / SEGMENT_ITEMS)
    scanned = running_last(
        usable,
        ["doc_id"],
        ["item_pos"],
        segment,
        {"__before": F.col("page_no")},
        exclusive=True,
        lowest={"__lowest": F.col("page_no"), "__end": -F.col("item_pos")},
    )
    body = item_markdown(F.col("label"), F.col("text"))
    page = F.when(F.col("__before").isNull(), F.col("__lowest")).when(
        F.col("__before") != F.col("page_no"), F.col("page_no")
    )
    block = F.when(page.isNotNull(), F.concat(page_marker(page), F.lit("\n\n"), body)).otherwise(body)
    is_last = F.col("item_pos") == -F.col("__end")
    return scanned.select(
        "doc_id", "item_pos", "page_no", block.alias("block"), is_last.alias("is_last")
    )


def document_lines(items: DataFrame) -> DataFrame:
    """Full documents as ordered rows ``doc_id, item_pos, line_no, line``.

    They are the lines of all blocks joined by a blank line. A document is never brought
    together in one cell, so its length does not matter.
    """
    joined = F.when(F.col("is_last"), F.col("block")).otherwise(F.concat("block", F.lit("\n\n")))
    blocks = marked_blocks(items)
    return rows_of(blocks, ["doc_id", "item_pos"], split_lines(joined), "line_no", "line")


def line_page_numbers(lines: DataFrame) -> DataFrame:
    """The rows of :func:`document_lines` with ``page``: the last page mark up to the line.

    Before any mark the document's first mark holds; without marks it is page 1.
    """
    mark = F.nullif(F.regexp_extract("line", fixed.PAGE_MARKER, 1), F.lit("")).cast("int")
    scanned = running_last(
        lines,
        ["doc_id"],
        ["item_pos", "line_no"],
        F.floor(F.col("item_pos") / SEGMENT_ITEMS),
        {"__mark": mark},
        first={"__opens": mark},
    )
    page = F.coalesce("__mark", "__opens", F.lit(1))
    return scanned.select(*lines.columns, page.alias("page"))


def document_digest(items: DataFrame) -> DataFrame:
    """``doc_id, n_blocks, n_chars, digest`` of the full documents, from their blocks.

    ``n_chars`` is the length of the blocks joined by a blank line; ``digest`` adds the first
    32 bits of each block's MD5 times its number, so it depends on texts and order.
    """
    blocks = marked_blocks(items)
    numbered = running_sum(
        blocks,
        ["doc_id"],
        ["item_pos"],
        F.floor(F.col("item_pos") / SEGMENT_ITEMS),
        {"number": F.lit(1).cast("long")},
    )
    own = F.conv(F.substring(F.md5("block"), 1, 8), 16, 10).cast("decimal(38,0)")
    return numbered.groupBy("doc_id").agg(
        F.count("*").alias("n_blocks"),
        (F.sum(F.length("block").cast("long")) + 2 * (F.count("*") - 1)).alias("n_chars"),
        F.sum(own * F.col("number")).cast("long").alias("digest"),
    )
