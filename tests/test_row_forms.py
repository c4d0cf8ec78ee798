"""Row forms against cell forms: the look-ahead scan, the anchor, counters in Python, long sections."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.models import ModelCounter
from lectern.functions.text import split_lines
from lectern.operators import longsections
from lectern.operators.anchor import content_anchor, line_anchors
from lectern.operators.packing import pack_text, pack_texts
from lectern.operators.scans import key_totals, next_within, with_key_values
from lectern.operators.sections import document_chunks, line_chunks
from lectern.session import shared_folder

CHUNK = ["doc_id", "chunk_index", "text", "token_count", "token_sum", "section_path", "chapter_number", "page_start", "page_end"]


def counts(texts):
    """A tokenizer stand-in: three characters a token, never additive over lines."""
    return [(len(text) + 2) // 3 for text in texts]


def model_counter(batch=1024):
    def load():  # travels by value: tasks cannot import this module
        return lambda texts: [(len(text) + 2) // 3 for text in texts]

    return ModelCounter(load, batch)


def naive_next(values, rows):
    out = []
    for i in range(len(values)):
        ahead = [j for j in range(i + 1, len(values)) if values[j] is not None and (rows is None or j - i <= rows)]
        out.append((values[ahead[0]], ahead[0] - i) if ahead else (None, None))
    return out


@pytest.mark.parametrize("rows", [1, 3, 40, None])
def test_next_within_equals_a_loop(spark, rows):
    rng = random.Random(rows or 0)
    keys = {k: [rng.choice([None, None, None, i]) for i in range(rng.randint(0, 60))] for k in (None, 1, 2)}
    cuts = {k: sorted(rng.sample(range(1, 60), 9)) for k in keys}
    table = [(k, i, sum(c <= i for c in cuts[k]), v) for k, values in keys.items() for i, v in enumerate(values)]
    frame = spark.createDataFrame(table, "k int, i int, seg int, v int").repartition(5)
    found = next_within(frame, ["k"], ["i"], F.col("seg"), {"nxt": F.col("v")}, rows)
    got = {(r.k, r.i): (r.nxt, r.nxt_in) for r in found.collect()}
    assert got == {(k, i): pair for k, values in keys.items() for i, pair in enumerate(naive_next(values, rows))}


def test_values_of_a_key_reach_all_its_rows(spark):
    frame = spark.createDataFrame([(k, i) for k in (None, 1, 2) for i in range(9)], "k int, i int")
    per_key = spark.createDataFrame([(None, "n"), (1, "a")], "k int, v string")
    rows = with_key_values(frame, ["k"], F.col("i") % 2, per_key).collect()
    assert {(r.k, r.v) for r in rows} == {(None, "n"), (1, "a"), (2, None)} and len(rows) == 27
    assert {(r.k, r.s) for r in key_totals(frame, ["k"], F.col("i") % 4, {"s": F.col("i")}).collect()} == {(None, 36), (1, 36), (2, 36)}


def as_rows(frame, by):
    rows = frame.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    return rows, ["doc_id"], ["pos"], F.floor(F.col("pos") / by)


@pytest.mark.parametrize("by", [1, 2, 7, 1000])
def test_row_anchor_equals_the_cell_form(spark, by):
    rng = random.Random(by)
    texts = ["\n".join(rng.choice("AAxBxxCxx") for _ in range(rng.randint(1, 50))) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    cell = frame.select("doc_id", content_anchor(split_lines(F.col("text")), "^A", "^B", "^C", 4).alias("a"))
    lines, keys, order, segment = as_rows(frame, by)
    found = line_anchors(lines, keys, order, segment, "line", "^A", "^B", "^C", 4)
    assert {r.doc_id: r.anchor.pos for r in found.collect()} == {r.doc_id: r.a for r in cell.collect() if r.a is not None}


WORDS = ["CHAPITRE 1", "CHAPITRE 1", "CHAPITRE 2", "1.1 INTRODUCTION", "Conformément à l’article 2111-9 du code des transports",
         "## a", "### b", "mot mot", "", "  ", "un deux trois quatre cinq six", "  retrait", "<!-- page: 3 -->", "<!-- page: 4 -->x",
         "CHAPITRE 1<!-- page: 8 -->", "y<!-- page: 5 -->", "z"]


def made(seed, documents=60, lines=40):
    rng = random.Random(seed)
    return [(i, "\n".join(rng.choice(WORDS) for _ in range(rng.randint(0, lines)))) for i in range(documents)]


def same(found, wanted):
    a, b = (sorted(map(str, frame.select(*CHUNK).collect())) for frame in (found, wanted))
    assert a == b and b


@pytest.mark.parametrize("carry_page", [False, True])
@pytest.mark.parametrize("by", [2, 1000])
def test_row_and_cell_chunks_agree_with_the_anchor(spark, carry_page, by):
    frame = spark.createDataFrame(made(by), "doc_id int, text string")
    wanted = document_chunks(frame, limit=9, carry_page=carry_page)
    found = line_chunks(*as_rows(frame, by), limit=9, carry_page=carry_page)
    same(found, wanted)
    assert {r.page_start for r in wanted.collect()} > {3}


def test_long_sections_equal_the_cell_form(spark):
    frame = spark.createDataFrame(made(11, 30, 80) + [(99, "CHAPITRE 1\n" + "a b c d\n" * 900)], "doc_id int, text string")
    wanted = document_chunks(frame, limit=9, use_anchor=False)
    found = line_chunks(*as_rows(frame, 5), limit=9, use_anchor=False, cell_lines=4, cell_chars=60)
    same(found, wanted)


def test_tables_on_the_way_to_chunks_are_given_back(spark):
    frame = spark.createDataFrame(made(11, 30, 80) + [(99, "CHAPITRE 1\n" + "a b c d\n" * 900)], "doc_id int, text string")
    folder, setting = shared_folder(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = set(tables(spark, folder)), spark.conf.get(setting, "false")
    found = line_chunks(*as_rows(frame, 5), limit=9, use_anchor=False, cell_lines=4, cell_chars=60)
    held = [spark.read.parquet(f"{folder}/{name}") for name in tables(spark, folder) if name not in before]
    assert len(held) > 8 and spark.conf.get(setting, "false") == was
    # Lines, counted lines, paragraphs and units are gone; what is left has chunks or no text.
    left = [t for t in held if {"line", "__said", "__text"} & set(t.columns)]
    assert len(left) >= 4 and all(t.isEmpty() for t in left)
    same(found, document_chunks(frame, limit=9, use_anchor=False))


def tables(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [status.getPath().getName() for status in found]
    return [name for name in names if not name.startswith("rdd-")]


def test_python_counter_in_both_forms(spark):
    frame = spark.createDataFrame(made(13, 30, 60), "doc_id int, text string")
    counter = model_counter()
    assert frame.select(counter(F.col("text")).alias("n")).count() == 30
    wanted = document_chunks(frame, counter=counter, limit=9, use_anchor=False)
    same(line_chunks(*as_rows(frame, 5), counter=counter, limit=9, use_anchor=False), wanted)
    same(line_chunks(*as_rows(frame, 5), counter=counter, limit=9, use_anchor=False, cell_lines=3, cell_chars=40), wanted)
    plain = document_chunks(frame, counter=lambda t: F.floor((F.length(t) + 2) / 3).cast("int"), limit=9, use_anchor=False)
    same(plain, wanted)


def naive_chunks(text, limit):
    """A sequential packer with the stand-in's counts."""
    size = lambda t: counts([t])[0]
    text = text.strip()
    if not text:
        return []
    if size(text) <= limit:
        return [(text, size(text), size(text))]
    import re

    out = []
    held, run = [], None

    def flush():
        if held:
            joined = ("\n" if run is not None else "\n\n").join(held)
            out.append((joined, size(joined), sum(map(size, held))))
            held.clear()

    for i, block in enumerate(b.strip() for b in re.split(r"\n\s*\n", text)):
        if not block:
            continue
        if size(block) <= limit:
            units, kind = [block], None
        else:
            units, kind = [x.strip() for x in block.split("\n") if x.strip()], i
        if kind != run:
            flush()
        run = kind
        for unit in units:
            if held and sum(map(size, held)) + size(unit) > limit:
                flush()
            held.append(unit)
    flush()
    return out


def test_python_counter_equals_a_sequential_packer(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["ab", "abcdefgh ijkl", "", "x" * 50, " y ", "z z z"]) for _ in range(rng.randint(0, 25))) for _ in range(120)]
    texts += ["", "  \n ", "x"]
    frame = spark.createDataFrame([(i, [t, None if i % 7 == 0 else t[::-1]]) for i, t in enumerate(texts)], "i int, t array<string>")
    counter = model_counter(5)
    rows = pack_texts(frame, F.transform("t", lambda t: F.coalesce(t, F.lit(""))), "c", counter, 12).collect()
    assert rows[0].asDict().keys() == {"i", "t", "c"}
    for r in rows:
        for source, text in enumerate(r.t):
            assert [(c.text, c.token_count, c.token_sum) for c in r.c if c.source == source] == naive_chunks(text or "", 12)
    with pytest.raises(TypeError):
        pack_text(F.col("t"), counter)


def walk(n, run, limit):
    """Chunk of every unit, one after the other."""
    out, total, chunk = [], None, -1
    for i, size in enumerate(n):
        if total is None or total + size > limit or run[i] != run[i - 1]:
            chunk, total = chunk + 1, 0
        total += size
        out.append(chunk)
    return out


def test_segment_tables_compose_to_the_walk():
    rng = np.random.default_rng(4)
    for _ in range(300):
        size, limit = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        n = rng.integers(0, limit + 4, size)
        run = np.cumsum(rng.random(size) < 0.1)
        cuts = np.unique(np.r_[0, rng.integers(0, size, 4), size])
        state, before, got = 0, 0, []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low and run[low] != run[low - 1]:
                state = 0
            got += longsections.chunk_numbers(n[low:high], run[low:high], limit, state, before).tolist()
            exits, opened = longsections.segment_table(n[low:high], run[low:high], limit)
            before += int(opened[state])
            state = int(exits[state])
        assert got == walk(n.tolist(), run.tolist(), limit)
