import random
import statistics

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import layout, profile
from lectern.operators.scans import global_offsets, running_last, running_sum
from lectern.plans.corpus import chunk_items
from lectern.sources.html import html_items

ITEMS = "doc_id string, item_pos int, page_no int, label string, text string"


def test_page_regression_marks_every_change(spark):
    items = spark.createDataFrame(
        [
            ("d", 0, 3, "section_header", "Titre"),
            ("d", 1, 2, "text", "un"),
            ("d", 2, 2, "table", "|a|"),
            ("d", 3, 3, "text", "deux"),
            ("d", 4, None, "text", "sans page"),
            ("d", 5, 3, "text", ""),
        ],
        ITEMS,
    )
    lines = [r.line for r in layout.document_lines(items).orderBy("item_pos", "line_no").collect()]
    assert "\n".join(lines).split("\n\n") == [
        "<!-- page: 2 -->",
        "## [section_header] Titre",
        "<!-- page: 2 -->",
        "un",
        "### [TABLE]",
        "|a|",
        "<!-- page: 3 -->",
        "deux",
    ]
    stats = {r.page_no: r for r in layout.page_stats(items).collect()}
    assert stats[2].n_chars == len("[text] un\n\n### [TABLE]\n\n|a|")
    assert (stats[2].n_items, stats[2].n_headings, stats[2].n_tables) == (2, 0, 1)
    assert (stats[3].n_items, stats[3].n_headings, stats[3].n_tables) == (2, 1, 0)
    lines = {r.page_no: r.line for r in layout.index_lines(layout.page_stats(items)).collect()}
    assert lines[2] == "- **Page 0002** | 27 chars | 2 items | 0 headings | 1 tables -> `page_0002.md`"
    assert layout.corpus_totals(items).first().n_pages == 2


def test_a_long_document_is_lines_of_the_whole(spark):
    """A document of more than two million characters, a line with a third of all rows."""
    body = "mot " * 700 + "\nfin\n"
    items = [("d", i, i // 3, "text", body if i % 2 else f"bloc {i}") for i in range(1500)]
    items += [("e", 0, 1, "text", "seul\n"), (None, 0, 4, "text", "sans nom")]
    blocks = [f"{f'<!-- page: {p} -->' + chr(10) * 2 if k == 0 or items[k - 1][2] != p else ''}{t}"
              for k, (_, _, p, _, t) in enumerate(items[:1500])]
    whole = "\n\n".join(blocks)
    assert len(whole) > 2_000_000
    frame = layout.line_page_numbers(layout.document_lines(spark.createDataFrame(items, ITEMS)))
    rows = frame.filter("doc_id = 'd'").orderBy("item_pos", "line_no").collect()
    assert [r.line for r in rows] == whole.splitlines()
    page, want = None, []
    for line in whole.splitlines():
        page = int(line.split()[2]) if line.startswith("<!-- page") else page
        want.append(page)
    assert [r.page for r in rows] == want
    digest = {r.doc_id: r for r in layout.document_digest(spark.createDataFrame(items, ITEMS)).collect()}
    assert (digest["d"].n_chars, digest["d"].n_blocks) == (len(whole), 1500)
    assert set(digest) == {"d", "e", None}  # a missing name is a value of its own


def test_scans_keep_rows_with_null_keys_and_segments(spark):
    rows = [(None, 1, 5), (None, 2, None), (1, None, 7), (1, 3, None), (2, 1, None)]
    frame = spark.createDataFrame(rows, "k int, i int, v int")
    found = running_last(frame, ["k"], ["i"], F.col("i"), {"last": F.col("v")}).collect()
    assert {(r.k, r.i): r.last for r in found} == {(None, 1): 5, (None, 2): 5, (1, None): 7, (1, 3): 7, (2, 1): None}
    sums = running_sum(frame, ["k"], ["i"], F.col("i"), {"s": F.col("v")}).collect()
    assert len(sums) == 5 and {(r.k, r.i): r.s for r in sums}[None, 2] == 5


def test_chunks_straight_from_items(spark):
    items = spark.createDataFrame(
        [("d", 0, 1, "text", "CHAPITRE 1"), ("d", 1, 2, "heading", "A"), ("d", 2, 2, "text", "mot")], ITEMS
    )
    rows = chunk_items(items).orderBy("chunk_index").collect()
    # The blank line after the page mark of page 2 stands before the heading.
    assert [(r.text, r.page_start, r.page_end) for r in rows] == [
        ("CHAPITRE 1", 1, 2),
        ("[heading] A\n\nmot", 2, 2),
    ]


def test_html_items_with_tables_and_unclosed_blocks(spark):
    html = (
        "<head><title>T &amp; U</title><script>var a='</p><p>no';</script></head><body><!-- <p>no</p> -->"
        "<h2>Deux</h2><p>un <b>gras<br><p>suite</p><ul><li>x<li>y</ul> dehors"
        "<table><tr><th>a</th><th>b</th></tr><tr><td><p>1</p></td><td>2</td></tr></table><p> </p>"
    )
    frame = spark.createDataFrame([(1, html)], "page_id int, html string")
    rows = [(r.item_pos, r.label, r.text) for r in html_items(frame).orderBy("item_pos").collect()]
    assert rows == [
        (0, "title", "T & U"),
        (1, "section_header", "Deux"),
        (2, "text", "un gras"),
        (3, "text", "suite"),
        (4, "list_item", "x"),
        (5, "list_item", "y"),
        (6, "text", "dehors"),
        (7, "table", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
    ]


def test_html_items_keep_all_text(spark):
    html = (
        "avant<div>un<pre>deux</pre>trois</div><ul><li>a<ul><li>b</li></ul>c</li></ul><p>d</div>e"
        "<table><tr><td>f<table><tr><td>g</td></table>h</td><td>i</td></tr></table>j<table><td>k"
    )
    extra = "<p>&#233;&eacute;&#xE9; &amp;lt; &unknown; &#0; &#128512; a&b</p>"
    rows = spark.createDataFrame([(1, html), (2, extra), (3, None), (4, "")], "page_id int, html string")
    found = html_items(rows).orderBy("page_id", "item_pos").collect()
    assert [(r.label, r.text) for r in found if r.page_id == 1] == [
        ("text", "avant"), ("text", "un"), ("text", "deux"), ("text", "trois"), ("list_item", "a"), ("list_item", "b"),
        ("text", "c"), ("text", "d"), ("text", "e"), ("text", "f"), ("table", "| g |\n| --- |"), ("text", "h"),
        ("text", "i"), ("text", "j"), ("text", "k"),
    ]
    assert [r.text for r in found if r.page_id == 2] == ["ééé &lt; &unknown; &#0; \U0001F600 a&b"]
    assert {r.page_id for r in found} == {1, 2}


def plain_grid(rows):
    """Browsers' table model: every cell takes the next free places of its row and those below."""
    places, width = {}, 0
    for y, row in enumerate(rows):
        x = 0
        for text, down, across in row:
            while (y, x) in places:
                x += 1
            for j in range(y, len(rows) if down == 0 else min(len(rows), y + down)):
                places.update({(j, i): text for i in range(x, x + max(across, 1))})
            x += max(across, 1)
    width = max([x + 1 for _, x in places], default=0)
    lines = ["| " + " | ".join(places.get((y, x), "") for x in range(width)) + " |" for y in range(len(rows))]
    lines.insert(1, "|" + " --- |" * width)
    return "\n".join(lines)


def test_html_tables_with_spans_are_full_grids(spark):
    rng = random.Random(7)
    tables = []
    for n in range(60):
        # Wide cells only in the first row and high ones of one column, so that no two cells overlap.
        rows = [
            [(f"t{n}.{y}.{x}", rng.choice([0, 1, 1, 2, 3, 9]), rng.choice([1, 2, 3]) if y == 0 else 1) for x in range(rng.randint(1, 4))]
            for y in range(rng.randint(1, 5))
        ]
        tables.append(rows)
    def markup(rows):
        mark = rng.choice(['"{}"', "'{}'", "{}", ' "{}"'])
        cell = "<{t} class=x {u}rowspan=" + mark + " colspan=" + mark + ">{c}"
        return "<table>" + "".join(
            "<tr>" + "".join(
                cell.replace("{}", "%s").format(t=rng.choice(["td", "TH"]), u=rng.choice(["", "id='a' "]), c=c + rng.choice(["", "</td>"])) % (d, a)
                for c, d, a in row
            ) + rng.choice(["", "</tr>"]) for row in rows
        ) + "</table>"

    frame = spark.createDataFrame([(n, markup(rows)) for n, rows in enumerate(tables)], "page_id int, html string")
    found = {r.page_id: (r.label, r.text) for r in html_items(frame).collect()}
    assert found == {n: ("table", plain_grid(rows)) for n, rows in enumerate(tables)}


def test_html_tables_ragged_nested_and_with_odd_spans(spark):
    cases = {
        1: ("<table><tr><td>a | b<tr><td>c<td>d</table>", ["| a | b |  |\n| --- | --- |\n| c | d |"]),
        2: ("<table><tr><td rowspan=2>a<td>b<tr><td colspan=2>c<tr><td>d</table>",
            ["| a | b |  |\n| --- | --- | --- |\n| a | c | c |\n| d |  |  |"]),
        3: ("<table><tr><td rowspan=x colspan=-1>a<td colspan=0>b</table>", ["| a | b |\n| --- | --- |"]),
        4: ("<table><tr><td rowspan=2>o<table><tr><td colspan=2>i<tr><td>j<td>k</table>p<tr><td>q</table>",
            ["o", "| i | i |\n| --- | --- |\n| j | k |", "p", "q"]),
        5: ("<table><tr></tr></table><p>rowspan = 2</p>", ["|  |\n| --- |", "rowspan = 2"]),
        6: ("<table></table>", []),
    }
    frame = spark.createDataFrame([(n, html) for n, (html, _) in cases.items()], "page_id int, html string")
    found = {n: [] for n in cases}
    for row in html_items(frame).orderBy("page_id", "item_pos").collect():
        found[row.page_id].append(row.text)
    assert found == {n: texts for n, (_, texts) in cases.items()}
    wide = spark.createDataFrame([(1, "<table><tr><td colspan=5000>w</table>")], "page_id int, html string")
    assert html_items(wide).first().text.count(" --- |") == 1000


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_scans_equal_plain_loops(spark, segment):
    rows = [(k, i, (i * 7 + k) % 5 or None) for k in (1, 2) for i in range(20)]
    frame = spark.createDataFrame(rows, "k int, i int, v int")
    cut = F.floor(F.col("i") / segment)
    inclusive = {
        (r.k, r.i): (r.last, r.head, r.low)
        for r in running_last(
            frame, ["k"], ["i"], cut, {"last": F.col("v")}, first={"head": F.col("v")}, lowest={"low": F.col("v")}
        ).collect()
    }
    before = {
        (r.k, r.i): r.last
        for r in running_last(frame, ["k"], ["i"], cut, {"last": F.col("v")}, exclusive=True).collect()
    }
    sums = {(r.k, r.i): r.s for r in running_sum(frame, ["k"], ["i"], cut, {"s": F.col("v")}).collect()}
    for k in (1, 2):
        values = [v for key, _, v in rows if key == k]
        known = [v for v in values if v is not None]
        last, total = None, 0
        for i, v in enumerate(values):
            assert before[k, i] == last
            last = v if v is not None else last
            total += v or 0
            assert inclusive[k, i] == (last, known[0], min(known))
            assert sums[k, i] == total


def test_global_offsets(spark):
    rows = [(f"k{i:04d}", i % 3) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, n int").repartition(7)
    found = global_offsets(frame, ["k"], {"at": F.lit(1), "before": F.col("n")}).orderBy("k").collect()
    total = 0
    for i, row in enumerate(found):
        assert (row["at"], row["before"]) == (i, total)
        total += row["n"]


def test_token_profile(spark):
    counts = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4, 1000)], "id int, tokens int")
    row = profile.token_distribution(counts).first()
    assert (row.minimum, row.median, row.maximum, row["mean"]) == (1.0, 3.0, 1000.0, 202.0)
    assert row.p90 == pytest.approx(601.6)
    assert row.standard_deviation == pytest.approx(statistics.stdev([1, 2, 3, 4, 1000]))
    assert profile.token_distribution(counts.limit(1)).first().standard_deviation is None
    within = {r.threshold: (r.n_texts, r.percentage) for r in profile.token_thresholds(counts).collect()}
    assert within[256] == (4, 80.0) and within[1024] == (5, 100.0)
    advice = profile.token_recommendation(counts).first()
    assert (advice.recommendation, advice.safety_margin) == (1024, 1024)
    assert profile.token_distribution(counts.filter("id < 0")).count() == 0


def test_most_common_breaks_ties_by_first_occurrence(spark):
    frame = spark.createDataFrame([(0, 9.0), (1, 8.04), (2, 8.0), (3, 9.0), (4, 7.0)], "pos int, size double")
    rows = profile.most_common(frame, T.python_round1(F.col("size")), F.col("pos"), 2).collect()
    assert [(r.value, r.n) for r in rows] == [(9.0, 2), (8.0, 2)]
