"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts are lower-cased (A-Z) and cut into words of digits, letters and bytes beyond ASCII.
The automaton holds the word sequences of the items. A document's words stream through it,
tracking the longest suffix that occurs in an item. A window is any ``window`` consecutive
words of an item, or a whole item that has fewer. Where the tracked length reaches the
window, the words it covers are hit; the state's suffix links name the items.

The items are the benchmark, a table of test questions. Their automaton is broadcast only in
parts of at most ``max_words`` words; a larger benchmark is cut into several parts at item
borders, the documents pass one part after the other and the results are added, so no single
automaton outgrows a worker and no item is lost. One item is never cut.

Words are compared by 64-bit hashes, and only runs of words that all occur in items are
walked at all; everything else cannot reach a window.

Defined results: a null text has no words; null items and items without words match nothing;
repeated items with different ids are each reported, an item id repeated on several rows
counts once; documents are reported once per row; texts of any length are streamed whole; empty tables give empty results (or
documents without hits); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import bound_batches, lean
from lectern.llm.textkit import WORD_BYTES, find_words, hash_words, slices

WINDOW = 10
MAX_WORDS = 500_000
MAX_COVERAGE = 0.5


@dataclass
class Automaton:
    """States as lists: transitions, suffix link, longest length, items."""

    window: int
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[set[int]] = field(default_factory=lambda: [set()])
    vocabulary: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    # Whole items shorter than the window that end in a state: (words, item).
    short: list[tuple[tuple[int, int], ...]] = field(default_factory=list)

    def _extend(self, last: int, word: int) -> int:
        step, link, length, items = self.step, self.link, self.length, self.items
        if word in step[last]:
            q = step[last][word]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, word, q)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        items.append(set())
        p = last
        while p != -1 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p != -1:
            q = step[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = len(self.step)
        self.step.append(dict(self.step[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.items.append(set())
        self.link[q] = copy
        while p != -1 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _walk(self, words: list[int]) -> Iterator[int]:
        state = 0
        for word in words:
            state = self.step[state][word]
            yield state

    def finish(self, sequences: list[list[int]]) -> None:
        """Name the items of every state, and the short items that end in it."""
        whole: dict[int, list[tuple[int, int]]] = {}
        for item, words in enumerate(sequences):
            state = 0
            for state in self._walk(words):
                # Every suffix of this prefix occurs in the item; stop where it is known.
                up = state
                while up > 0 and item not in self.items[up]:
                    self.items[up].add(item)
                    up = self.link[up]
            if words and len(words) < self.window:
                whole.setdefault(state, []).append((len(words), item))
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.short = [()] * len(self.length)
        for state in order[1:]:
            self.short[state] = self.short[self.link[state]] + tuple(whole.get(state, ()))


def build_automaton(sequences: list[np.ndarray], window: int = WINDOW) -> Automaton:
    automaton = Automaton(window)
    everything = np.concatenate(sequences) if sequences else np.empty(0, np.uint64)
    automaton.vocabulary = np.unique(everything)
    ids = [np.searchsorted(automaton.vocabulary, s).tolist() for s in sequences]
    for words in ids:
        automaton.add(words)
    automaton.finish(ids)
    return automaton


def match_words(automaton: Automaton, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """``(first word, word after the last, longest match, item)`` of every window occurrence."""
    if not len(automaton.vocabulary) or not len(hashes):
        return
    at = np.searchsorted(automaton.vocabulary, hashes)
    at[at == len(automaton.vocabulary)] = 0
    known = automaton.vocabulary[at] == hashes
    edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
    shortest = automaton.window
    for words in {w for found in automaton.short for w, _ in found}:
        shortest = min(shortest, words)
    step, link, length = automaton.step, automaton.link, automaton.length
    items, short, window = automaton.items, automaton.short, automaton.window
    for first, last in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if last - first < shortest:
            continue
        state = size = 0
        for i, word in enumerate(at[first:last].tolist(), first):
            while state and word not in step[state]:
                state = link[state]
                size = length[state]
            if word in step[state]:
                state = step[state][word]
                size += 1
            else:
                size = 0
            for words, item in short[state]:
                if words <= size:
                    yield i + 1 - words, i + 1, size, item
            if size >= window:
                up = state
                while length[link[up]] >= window:
                    up = link[up]
                for item in items[up]:
                    yield i + 1 - window, i + 1, size, item


def _sequences(rows: list[tuple[str, str]]) -> list[np.ndarray]:
    out = []
    for _, _, texts in slices(pa.array([text for _, text in rows], pa.large_string())):
        lowered = texts.lower()
        words = find_words(lowered, WORD_BYTES)
        hashes = hash_words(lowered.data, words)
        out += [hashes[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    return out


def item_parts(
    items: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS
) -> Iterator[tuple[list[str], Automaton]]:
    """Item ids and automaton of one part of the items after the other."""
    rows = (
        items.select(F.col("item_id").cast("string").alias("item_id"), "text")
        .filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
        .orderBy("item_id", "text")
    )
    ids: list[str] = []
    texts: list[np.ndarray] = []
    total = 0
    for row in rows.toLocalIterator():
        (words,) = _sequences([(row.item_id, row.text)])
        if not len(words):
            continue
        if ids and total + len(words) > max_words:
            yield ids, build_automaton(texts, window)
            ids, texts, total = [], [], 0
        ids.append(row.item_id)
        texts.append(words)
        total += len(words)
    if ids:
        yield ids, build_automaton(texts, window)


_FOUND = "n_words bigint, spans array<struct<first:int,last:int,longest:int>>, items array<string>"


def merge_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping or touching spans joined, ascending, each with its longest match."""
    out: list[tuple[int, int, int]] = []
    for first, last, longest in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last), max(out[-1][2], longest))
        else:
            out.append((first, last, longest))
    return out


def _part_of(ids: list[str], automaton: Automaton, column: pa.Array) -> Iterator[tuple[int, list, set]]:
    """Words, spans and item ids of every text of a column."""
    for _, _, texts in slices(column):
        lowered = texts.lower()
        words = find_words(lowered, WORD_BYTES)
        hashes = hash_words(lowered.data, words)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            found = list(match_words(automaton, hashes[a:b]))
            spans = merge_spans([(first, last, longest) for first, last, longest, _ in found])
            yield b - a, spans, {ids[item] for *_, item in found}


_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("longest", pa.int32())])


def _tagged(batch: pa.RecordBatch, ids: list[str], automaton: Automaton, again: bool) -> pa.RecordBatch:
    """A batch with the words, spans and items found by one part, added to those found before."""
    rows = list(_part_of(ids, automaton, batch.column("text")))
    if again:
        before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
        rows = [
            (n, merge_spans(spans + [tuple(s.values()) for s in old]), found | set(known))
            for (n, spans, found), (old, known) in zip(rows, before, strict=True)
        ]
    names = [n for n in batch.schema.names if n not in ("n_words", "spans", "items")]
    columns = [batch.column(n) for n in names]
    columns += [
        pa.array([n for n, _, _ in rows], pa.int64()),
        pa.array(
            [[dict(zip(("first", "last", "longest"), s, strict=True)) for s in spans] for _, spans, _ in rows],
            pa.list_(_SPAN),
        ),
        pa.array([sorted(found) for *_, found in rows], pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, [*names, "n_words", "spans", "items"])


def _fields(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)


def tag_items(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_words: int = MAX_WORDS,
    then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """The rows of ``docs`` and ``n_words``, ``spans`` and ``items`` of each.

    Spans are ranges of word numbers, disjoint and ascending, each with its longest match.
    Columns of ``docs`` with the new names are replaced. ``then`` turns the tagged batches into
    others, of ``schema``, in the task that tagged them.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.drop("n_words", "spans", "items")
    parts = list(item_parts(items, window, max_words)) or [([], Automaton(window))]
    tagged, own = docs, f"{_fields(docs)}, {_FOUND}"
    for number, part in enumerate(parts):
        shared = spark.sparkContext.broadcast(part)
        last = then if number == len(parts) - 1 else None

        def run(batches, shared=shared, again=number > 0, last=last):
            for batch in batches:
                found = _tagged(batch, *shared.value, again)
                yield last(found) if last else found

        tagged = tagged.mapInArrow(lean(run), schema if last else own)
    return tagged


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    tagged = tag_items(docs.select("doc_id", "text"), items, window)
    n_hit = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]).cast("long")
    )
    # Equal ids of repeated items are one id already; array_sort orders strings by code point.
    return tagged.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given ranges of words (and what stands between those words)."""
    (_, _, texts) = next(slices(pa.array([text], pa.large_binary())))
    words = find_words(texts.lower(), WORD_BYTES)
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : int(words.starts[first])])
        at = int(words.ends[last - 1])
    return b"".join([*out, text[at:]])


def remove_items(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
) -> DataFrame:
    """The rows of ``docs`` with every hit span cut out of ``text``.

    A document of which more than ``max_coverage`` of the words are hit goes as a whole.
    """
    # Columns get names of their own meanwhile, so that any name may come in.
    inside = docs.select(
        *[F.col(f"`{c}`").alias("text" if c == "text" else f"__{i}") for i, c in enumerate(docs.columns)]
    )
    names = inside.columns

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column("spans").to_pylist()
        covered = np.array([sum(s["last"] - s["first"] for s in spans) for spans in found], dtype=np.int64)
        keep = covered <= max_coverage * batch.column("n_words").to_numpy()
        texts = batch.column("text")
        if covered.any():
            values = texts.to_pylist()
            for i in np.flatnonzero(keep & (covered > 0)).tolist():
                ranges = [(s["first"], s["last"]) for s in found[i]]
                values[i] = cut_spans(values[i].encode(), ranges).decode()
            texts = pa.array(values, texts.type)
        columns = [texts if n == "text" else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return tag_items(inside, items, window, then=cut, schema=_fields(inside)).toDF(*docs.columns)


# The same rule for DuckDB: every window of every text against the windows of the items.
_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLE = f"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS row_no, {_SQL_WORDS} AS words FROM documents),
item AS (SELECT item_id::VARCHAR AS item_id, {_SQL_WORDS} AS words, least(len(words), {WINDOW}) AS size FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, size, array_to_string(words[pos : pos + size - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS pos FROM item WHERE size > 0 AND item_id IS NOT NULL)),
doc_window AS (
  SELECT row_no, pos, size, array_to_string(words[pos : pos + size - 1], ' ') AS words
  FROM (SELECT d.row_no, d.words, s.size, unnest(range(1, len(d.words) - s.size + 2)) AS pos
        FROM doc d, (SELECT DISTINCT size FROM item_window) s)),
hit AS (SELECT row_no, pos, size, item_id FROM doc_window JOIN item_window USING (size, words)),
covered AS (SELECT row_no, count(DISTINCT place) AS n_hit FROM (SELECT row_no, unnest(range(pos, pos + size)) AS place FROM hit) GROUP BY 1),
named AS (SELECT row_no, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (row_no) LEFT JOIN named USING (row_no)"""
