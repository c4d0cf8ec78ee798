"""Packing that carries headers: chunks of whole sections, each under the headers it belongs to.

Sections of a chapter are put together until a chunk would exceed a soft limit. A section that
would begin a chunk keeps whole up to a hard limit; a longer one is cut into paragraphs (and
paragraphs beyond the hard limit into lines), which are put together like sections. A chunk
repeats, above its text, the headers that are open where it begins, so that no part of a
chapter stands without its context. Chunks do not cross chapters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.arrays import bind, rows_of
from lectern.functions.text import TokenCounter, block_lines, count_tokens, paragraphs
from lectern.operators.packing import greedy_groups, in_phases
from lectern.operators.sections import parse_lines, sections_of

_PIECE = "array<struct<text:string,glue:string>>"


def _piece(text: Column, glue: str) -> Column:
    return F.struct(text.alias("text"), F.lit(glue).alias("glue"))


def _pieces(text: Column, counter: TokenCounter, hard: int) -> Column:
    """Paragraphs of a section's text, lines of those beyond the limit; the title with the first."""

    def cut(paragraph):
        def lines(own):
            first = F.transform(F.slice(own, 1, 1), lambda line: _piece(line, "\n\n"))
            more = F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0)))
            return F.concat(first, F.transform(more, lambda line: _piece(line, "\n")))

        whole = F.array(_piece(paragraph, "\n\n"))
        return F.when(counter(paragraph) <= hard, whole).otherwise(bind(block_lines(paragraph), lines))

    def with_title(pieces):
        first = F.array_join(F.transform(F.slice(pieces, 1, 2), lambda p: p["text"]), "\n\n")
        more = F.slice(pieces, 3, F.greatest(F.size(pieces) - 2, F.lit(0)))
        return F.concat(F.array(_piece(first, "\n\n")), more)

    return bind(F.flatten(F.transform(paragraphs(text), cut)).cast(_PIECE), with_title)


def _units(sections: Column, counter: TokenCounter, hard: int) -> Column:
    """What chunks are made of, each with the headers above it and the number of its chapter."""

    def unit(section, piece, index, n):
        path = section["section_path"]
        # Behind its first piece, a section's own title is one of the headers.
        depth = F.size(path) - F.when(index == 0, 1).otherwise(0)
        headers = F.array_join(F.slice(path, 1, F.greatest(depth, F.lit(0))), "\n")
        return F.struct(
            piece["text"].alias("text"),
            piece["glue"].alias("glue"),
            n.cast("int").alias("n"),
            headers.alias("headers"),
            section["run"].alias("run"),
            section["section_path"].alias("section_path"),
            section["chapter_number"].alias("chapter_number"),
            section["page_start"].alias("page_start"),
            section["page_end"].alias("page_end"),
        )

    def units_of(section):
        def divided(n):
            whole = F.array(unit(section, _piece(section["text"], "\n\n"), F.lit(0), n))
            parts = F.transform(
                _pieces(section["text"], counter, hard),
                lambda piece, index: unit(section, piece, index, counter(piece["text"])),
            )
            return F.when(n <= hard, whole).otherwise(parts)

        return bind(counter(section["text"]), divided)

    return F.flatten(F.transform(sections, units_of))


def pack_sections(
    sections: Column,
    counter: TokenCounter = count_tokens,
    soft: int = fixed.SOFT_TOKENS,
    hard: int = fixed.HARD_TOKENS,
) -> Column:
    """Chunks of an array of sections, as :func:`sections_of` gives them.

    Each has ``headers`` (the repeated lines, empty if none), ``text`` (headers and units),
    ``token_count`` of that text, ``token_sum`` of its parts, ``section_path`` and
    ``chapter_number`` of its first unit, the pages from its first unit to its last, ``n_units``.
    A unit beyond the soft limit is a chunk of its own.
    """

    def numbered(items):
        # A section of level 1 opens a chapter; a chapter number may come again later.
        opens = F.filter(
            F.transform(items, lambda s, i: F.when(s["level"] == 1, i)), lambda i: i.isNotNull()
        )

        def with_runs(heads):
            return F.transform(
                items, lambda s, i: s.withField("run", F.size(F.filter(heads, lambda h: h <= i)))
            )

        return bind(opens, with_runs)

    def build(units):
        def to_chunk(group):
            own = F.slice(units, group["start"], group["size"])

            def compose(first, last):
                rest = F.transform(
                    F.slice(own, 2, F.greatest(group["size"] - 1, F.lit(0))),
                    lambda u: F.concat(u["glue"], u["text"]),
                )
                above = F.when(first["headers"] == "", F.lit("")).otherwise(F.concat(first["headers"], F.lit("\n\n")))
                text = F.concat(above, first["text"], F.array_join(rest, ""))
                return bind(
                    text,
                    lambda t: F.struct(
                        first["headers"].alias("headers"),
                        t.alias("text"),
                        counter(t).cast("int").alias("token_count"),
                        group["total"].alias("token_sum"),
                        first["section_path"].alias("section_path"),
                        first["chapter_number"].alias("chapter_number"),
                        first["page_start"].alias("page_start"),
                        last["page_end"].alias("page_end"),
                        group["size"].alias("n_units"),
                    ),
                )

            return compose(F.get(own, F.lit(0)), F.get(own, group["size"] - 1))

        return F.transform(greedy_groups(units, soft, lambda u: u["n"] + counter(u["headers"])), to_chunk)

    return bind(bind(sections, numbered), lambda items: bind(_units(items, counter, hard), build))


def header_chunks(
    documents: DataFrame,
    text: str = "text",
    counter: TokenCounter = count_tokens,
    soft: int = fixed.SOFT_TOKENS,
    hard: int = fixed.HARD_TOKENS,
    use_anchor: bool = True,
    carry_page: bool = False,
) -> DataFrame:
    """Header-carrying chunks of each document row, numbered from 0; scan, project, generate.

    A document without a chapter has no sections and so no chunks, as in ``document_chunks``.
    """
    if in_phases(counter):
        raise TypeError("header_chunks packs with a counter that is an expression")
    if not 0 < soft <= hard:
        raise ValueError("the soft limit lies between 1 and the hard limit")
    others = [name for name in documents.columns if name != text]
    parsed = bind(parse_lines(F.col(text), use_anchor, carry_page), sections_of)
    chunks = pack_sections(parsed, counter, soft, hard)
    return rows_of(documents, others, chunks, "chunk_index", "c").select(*others, "chunk_index", "c.*")
