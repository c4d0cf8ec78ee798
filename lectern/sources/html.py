"""Layout items from raw HTML pages, with array and regex expressions only."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.arrays import bind, rows_of
from lectern.functions.text import collapse

# What is skipped, what separates items, what a table is made of.
SKIPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TABLE_OPEN = r"(?i)<table(?:\s[^>]*)?>"
TABLE_CLOSE = r"(?i)</table\s*>"
TABLE_ROW = r"(?is)<tr\b.*?(?=<tr\b|\z)"
TABLE_CELL = r"(?is)<t[dh]\b[^>]*>.*?(?=<t[dh]\b|</tr\b|\z)"
TABLE_SPAN = r"(?i)<t[dh]\s[^>]*\b(?:row|col)span\s*="
SPAN_VALUE = r"(?i)^<t[dh]\s[^>]*\b{}span\s*=\s*[\"']?\s*([0-9]{{1,9}})"
MOST_COLUMNS, MOST_ROWS = 1000, 65534
BLOCK = (
    "title|h[1-6]|p|li|ul|ol|dl|dt|dd|div|pre|blockquote|address|article|aside|section|header|"
    "footer|nav|main|head|body|html|form|fieldset|legend|figure|figcaption|details|summary|"
    "table|caption|colgroup|thead|tbody|tfoot|tr|td|th|hr"
)
BLOCK_TAG = rf"(?i)<(/?)({BLOCK})(?:\s[^>]*)?/?>"
ANY_TAG = r"<[^>]*>"
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
LABELS = {"title": "title", "li": "list_item"}

_ITEM, _BODY = "\x1e", "\x1f"


def decode_entities(text: Column) -> Column:
    """Numeric entities and those that HTML names, each decoded once; others stay as written."""
    named = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])

    def character(name):
        hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
        code = F.when(hexadecimal, F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(
            F.substring(name, 2, 7)
        ).try_cast("long")

        def numbered(c):
            valid = (c > 0) & (c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
            return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))

        return F.when(name.startswith("#"), bind(code, numbered)).otherwise(F.try_element_at(named, name))

    def decoded(part, index):
        def replaced(name):
            rest = F.substr(part, F.length(name) + 2)
            said = bind(character(name), lambda char: F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), part)))
            return F.when(name != "", said).otherwise(F.concat(F.lit("&"), part))

        return F.when(index == 0, part).otherwise(bind(F.regexp_extract(part, ENTITY, 1), replaced))

    def whole(own):
        joined = F.array_join(F.transform(F.split(own, "&", -1), decoded), "")
        return F.when(own.contains("&"), joined).otherwise(own)

    return bind(text, whole)


def plain_text(markup: Column) -> Column:
    """Markup without tags, entities decoded, blanks collapsed."""
    return collapse(decode_entities(F.regexp_replace(markup, ANY_TAG, " ")))


def _span(cell: Column, kind: str, most: int) -> Column:
    """A cell's ``rowspan`` or ``colspan`` as browsers read it: 1 if it has none that is valid."""
    said = F.regexp_extract(cell, SPAN_VALUE.format(kind), 1).try_cast("int")
    # No rows are all rows that follow; no columns are one.
    least = F.when(said == 0, F.lit(most if kind == "row" else 1)).otherwise(said)
    return F.least(F.coalesce(least, F.lit(1)), F.lit(most))


_SLOTS = "array<struct<text:string,left:int>>"


def _grid(rows: Column) -> Column:
    """Texts of all grid places, row by row, of an array of rows' arrays of cell markup.

    A cell that spans rows or columns fills all its places with its text. A row's cells go, left
    to right, to the places that no cell of an earlier row holds; ``left`` is the number of rows
    that a place's cell still reaches into.
    """
    none = F.array().cast(_SLOTS)

    def slot(text, left):
        return F.struct(text.alias("text"), left.cast("int").alias("left"))

    def add_row(acc, cells):
        held = acc["held"]

        def free(i):
            return F.coalesce(F.get(held, i)["left"], F.lit(0)) <= 0

        def put(row, cell):
            at = F.size(row)
            first = F.get(F.filter(F.sequence(at, F.greatest(at, F.size(held))), free), F.lit(0))
            wide = F.array_repeat(
                slot(plain_text(cell), _span(cell, "row", MOST_ROWS)), _span(cell, "col", MOST_COLUMNS)
            )
            return F.concat(row, F.slice(held, at + 1, first - at), wide)

        def rest(row):
            later = F.slice(held, F.size(row) + 1, F.greatest(F.size(held) - F.size(row), F.lit(0)))
            return F.concat(row, F.transform(later, lambda h: F.when(h["left"] > 0, h).otherwise(slot(F.lit(""), F.lit(0)))))

        def placed(row):
            after = F.transform(row, lambda h: slot(h["text"], F.greatest(h["left"] - 1, F.lit(0))))
            texts = F.transform(row, lambda h: h["text"])
            return F.struct(F.array_append(acc["rows"], texts).alias("rows"), after.alias("held"))

        filled = F.aggregate(cells, none, put)
        return bind(bind(filled, rest), placed)

    start = F.struct(F.array().cast("array<array<string>>").alias("rows"), none.alias("held"))
    return F.aggregate(rows, start, add_row, lambda acc: acc["rows"])


def table_markdown(table: Column) -> Column:
    """A table as pipe-separated rows of equal width with a rule under the first.

    Cells that span rows or columns stand in every place that they cover.
    """

    def layout(rows):
        width = F.array_max(F.transform(rows, F.size))

        def line(texts):
            full = F.concat(texts, F.array_repeat(F.lit(""), width - F.size(texts)))
            return F.concat(F.lit("| "), F.array_join(full, " | "), F.lit(" |"))

        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.greatest(width, F.lit(1))))
        return F.array_join(F.array_insert(F.transform(rows, line), 2, rule), "\n")

    def cells(markup):
        return F.regexp_extract_all(markup, F.lit(TABLE_CELL), F.lit(0))

    def texts(spans, rows):
        plain = F.transform(rows, lambda row: F.transform(row, plain_text))
        return F.when(spans, _grid(rows)).otherwise(plain)

    rows = F.transform(F.regexp_extract_all(table, F.lit(TABLE_ROW), F.lit(0)), cells)
    whole = bind(rows, lambda r: texts(table.rlike(TABLE_SPAN), r))
    return bind(whole, lambda r: F.when(F.size(r) > 0, layout(r)).otherwise(""))


def _runs(fragment: Column) -> Column:
    """Text runs between block tags, with the label of the tag they follow."""
    marked = F.regexp_replace(fragment, BLOCK_TAG, f"{_ITEM}$1$2{_BODY}")

    def run(segment):
        tagged = segment.contains(_BODY)
        tag = F.when(tagged, F.lower(F.substring_index(segment, _BODY, 1))).otherwise("")
        body = F.when(tagged, F.substring_index(segment, _BODY, -1)).otherwise(segment)
        label = F.when(tag.rlike("^h[1-6]$"), fixed.LABEL_SECTION_HEADER)
        for name, known in LABELS.items():
            label = label.when(tag == name, known)
        return F.struct(label.otherwise("text").alias("label"), plain_text(body).alias("text"))

    return F.transform(F.split(marked, _ITEM, -1), run)


def _items(html: Column) -> Column:
    """Items of a page: the text runs, and a table in the place of each innermost table.

    The page is cut where tables open. A part that closes its table is that table, then runs;
    one in which another table opens first belongs to an outer table, whose cells are runs.
    """

    def item(part, index):
        closed = F.regexp_instr(part, F.lit(TABLE_CLOSE)) > 0
        halves = F.split(part, TABLE_CLOSE, 2)
        table = F.struct(
            F.lit(fixed.LABEL_TABLE).alias("label"),
            bind(F.get(halves, F.lit(0)), table_markdown).alias("text"),
        )
        return F.when(
            (index > 0) & closed, F.concat(F.array(table), _runs(F.get(halves, F.lit(1))))
        ).otherwise(_runs(part))

    def parse(source):
        return F.filter(
            F.flatten(F.transform(F.split(source, TABLE_OPEN, -1), item)), lambda i: i["text"] != ""
        )

    return bind(F.regexp_replace(html, SKIPPED, " "), parse)


def html_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per block item of each page row: ``item_pos, label, text``.

    Every text run between two block tags is an item, so no text is lost: a title, heading
    or list item if it follows that tag, else a text (also what follows a nested block's
    end). An innermost table is one item, its rows of one width and a spanning cell in every
    place that it covers; the cells of a table around it are texts. Runs
    without text are dropped.
    """
    others = [name for name in pages.columns if name != html]
    return rows_of(pages, others, _items(F.col(html)), "item_pos", "item").select(
        *others, "item_pos", "item.*"
    )
