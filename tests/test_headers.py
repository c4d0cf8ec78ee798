"""Header-carrying packing against a plain loop over a document's sections."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions.models import ModelCounter
from lectern.operators.headers import header_chunks
from lectern.operators.sections import document_sections

TOKEN = re.compile(r"\w+|[^\w\s]")
WORDS = ["un", "deux", "trois.", "quatre", "cinq,", "l'eau"]


def tokens(text):
    return len(TOKEN.findall(text))


def plain_chunks(sections, soft, hard):
    """``(headers, text, token_sum, n_units, page_start, page_end)`` of sections in order."""
    chunks, held, run = [], None, 0

    def close():
        nonlocal held
        if held:
            headers, text, total, count, first, last = held
            chunks.append((headers, f"{headers}\n\n{text}" if headers else text, total, count, first, last))
        held = None

    for s in sections:
        if s.level == 1:
            close()
        if tokens(s.text) <= hard:
            parts = [("\n\n", s.text)]
        else:
            parts = []
            for block in re.split(r"\n\s*\n", s.text):
                block = block.strip()
                if block and tokens(block) <= hard:
                    parts.append(("\n\n", block))
                elif block:
                    lines = [line.strip() for line in block.split("\n") if line.strip()]
                    parts += [("\n\n" if i == 0 else "\n", line) for i, line in enumerate(lines)]
            parts[:2] = [("\n\n", "\n\n".join(text for _, text in parts[:2]))]
        for i, (glue, text) in enumerate(parts):
            if held and held[2] + tokens(text) > soft:
                close()
            if held:
                headers, before, total, count, first, _ = held
                held = (headers, before + glue + text, total + tokens(text), count + 1, first, s.page_end)
            else:
                headers = "\n".join(s.section_path[:-1] if i == 0 else s.section_path)
                held = (headers, text, tokens(headers) + tokens(text), 1, s.page_start, s.page_end)
    close()
    return chunks


def random_document(rng):
    lines, page = [], 1
    for _ in range(rng.randint(0, 40)):
        kind = rng.random()
        if kind < 0.08:
            lines.append(f"CHAPITRE {rng.randint(1, 3)}")
        elif kind < 0.3:
            lines.append("#" * rng.randint(1, 4) + " " + rng.choice(["A", "B b", "C"]))
        elif kind < 0.36:
            page += 1
            lines.append(f"<!-- page: {page} -->")
        elif kind < 0.6:
            lines.append("")
        else:
            lines.append(" ".join(rng.choices(WORDS, k=rng.randint(1, 9))))
    return "\n".join(["CHAPITRE 1"] * (rng.random() < 0.9) + lines)


@pytest.mark.parametrize(("soft", "hard"), [(12, 20), (8, 8), (1, 5), (1000, 2000)])
def test_chunks_equal_a_plain_loop(spark, soft, hard):
    rng = random.Random(soft)
    texts = [(n, random_document(rng)) for n in range(60)] + [(900, ""), (901, None), (902, "CHAPITRE 1")]
    frame = spark.createDataFrame(texts, "n int, text string")
    sections = {}
    for row in document_sections(frame, use_anchor=False).orderBy("n", "section_pos").collect():
        sections.setdefault(row.n, []).append(row)
    want = {n: plain_chunks(own, soft, hard) for n, own in sections.items()}
    got = {}
    for r in header_chunks(frame, soft=soft, hard=hard, use_anchor=False).orderBy("n", "chunk_index").collect():
        assert r.chunk_index == len(got.setdefault(r.n, []))
        assert r.token_count == tokens(r.text)
        got[r.n].append((r.headers, r.text, r.token_sum, r.n_units, r.page_start, r.page_end))
    assert got == want


def test_a_chunk_repeats_the_headers_that_are_open(spark):
    text = "CHAPITRE 1\n## Un\na b c d\n### Sous\ne f g h\n### Autre\ni j k l\n## Deux\nm\nCHAPITRE 2\nn"
    frame = spark.createDataFrame([(1, text)], "n int, text string")
    chunks = header_chunks(frame, soft=14, hard=20, use_anchor=False).orderBy("chunk_index").collect()
    assert [r.text for r in chunks] == [
        "CHAPITRE 1\n\nUn\n\na b c d\n\nSous\n\ne f g h",
        "CHAPITRE 1\nUn\n\nAutre\n\ni j k l\n\nDeux\n\nm",
        "CHAPITRE 2\n\nn",
    ]
    assert [r.headers for r in chunks] == ["", "CHAPITRE 1\nUn", ""]
    assert [r.chapter_number for r in chunks] == ["1", "1", "2"]


def test_limits_and_plan(spark):
    frame = spark.createDataFrame([(1, "CHAPITRE 1\nx")], "n int, text string")
    with pytest.raises(ValueError, match="soft limit"):
        header_chunks(frame, soft=9, hard=8)
    with pytest.raises(TypeError, match="expression"):
        header_chunks(frame, counter=ModelCounter(lambda: lambda texts: [len(t) for t in texts]))
    plan = header_chunks(frame.filter(F.col("n") > 0))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
