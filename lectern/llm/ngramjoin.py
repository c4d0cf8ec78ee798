"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct word shingles (64-bit hashes). Two documents link when
``100 * intersection >= percent * union``; the result is each document's component.

1. Equal sets are one class; only classes are joined.
2. An index has the prefix of every class: the shingles that come first in one global order,
   as many as a linking partner must share one of. The order puts shingles of many documents
   last: pieces of passages that many documents share are rarely in a prefix. How often a
   shingle occurs is counted over all prefixes in hash order and kept in a table of fixed
   size, from which every task derives the same order; the order only affects speed.
3. An index list is worked through in blocks, sorted by set size. A block is skipped whole
   when sizes or positions rule out every partner in it; inside, pairs are kept if the
   positions of the shared shingle leave room for the overlap that their sizes need, and
   their parity maps (512 bits, one flipped by each shingle) do not differ in too many
   places. All shared prefix shingles of a pair, counted, must leave that room too.
4. Answers are derived, not looked up again, where sets are highly similar: a first round
   pairs every entry of a list only with one centre and its neighbour, verifies these pairs
   on the whole sets, and joins linked classes into components. The second round takes only
   pairs of different components: members of a group of similar sets have their answers from
   the group.
5. Candidates are verified exactly on whole sets, which are made from the texts again for the
   classes that need it. A fixed-size Bloom filter tells the scan which ones those are.

Every linking pair shares a prefix shingle and passes the filters, so it is verified in one of
the rounds or already connected: components are exact (up to hash collisions). Without a
rare order (a list of sets that consist of common shingles alone, of similar size and not
similar to each other) a list's work grows with the square of its length.

``similarity_links`` lists every link: its second round takes all pairs of classes.

Defined results: a text with fewer words than a shingle has is one shingle; null, empty and
blank texts have no shingles and are components of their own; rows with one id are one node;
rows without id have no component; a text of any length is one set, held by one task; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import bound_batches
from lectern.llm.components import components
from lectern.llm.textkit import find_words, hash_words, mix, shingle_hashes, slices
from lectern.session import lean, release_memory, reliable_checkpoint, scratch_path

WIDTH = 4
PERCENT = 85
LEVEL_CELLS = 1 << 22
HOT_SHINGLES = 1 << 17
HOT_COUNT = 8
GROUP_BYTES = 1 << 25  # of text, whose shingles are counted together
BLOOM_WORDS = 1 << 17
BLOCK = 64
MAP_WORDS = 8
EMIT_PAIRS = 200_000


def needed(a, b, percent: int):
    """Overlap that sets of sizes ``a`` and ``b`` need to link."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def text_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    for _, _, texts in slices(column):
        lowered = texts.lower()
        words = find_words(lowered)
        hashes, bounds = shingle_hashes(hash_words(lowered.data, words), words.bounds, width)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(hashes[a:b])


def class_of(s: np.ndarray) -> int:
    """64-bit fingerprint of a set."""
    total = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(s))]))[0].view(np.int64))


def parity_map(s: np.ndarray) -> list[int]:
    """512 bits: every shingle flips one. Two sets differ at least where their maps do."""
    bits = np.uint64(1) << ((s >> np.uint64(3)) & np.uint64(63))
    word = s & np.uint64(MAP_WORDS - 1)
    return [int(np.bitwise_xor.reduce(bits[word == w]).view(np.int64)) for w in range(MAP_WORDS)]


_MAP = tuple(f"p{w}" for w in range(MAP_WORDS))
_SCAN = (
    "doc_id bigint, n bigint, cls bigint, "
    + "".join(f"{name} bigint, " for name in _MAP)
    + "range int, hashes binary"
)


def _value_bits(docs: DataFrame, ranges: int) -> int:
    """By how many bits of its values a range is divided, so that its parts stay near ``GROUP_BYTES``."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = -(-size // (ranges * GROUP_BYTES))
    return min(32, max(0, parts - 1).bit_length())


def _scan(docs: DataFrame, width: int, ranges: int, value_bits: int = 0) -> DataFrame:
    """Two kinds of rows: ``doc_id, n, cls`` and parity map of every text, ``range, hashes``.

    The latter are the shingles of the task's texts (each class once), dealt into ranges by
    their lowest bits, with 32 other bits kept of each, sorted, as differences. The first
    ``value_bits`` of those divide a range into parts with numbers of their own.
    """
    starts = np.arange(ranges << value_bits, dtype=np.uint64) << np.uint64(32 - value_bits)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            sizes, classes, maps, new = [], [], [], []
            for s in text_sets(batch.column("text"), width):
                key = class_of(s)
                sizes.append(len(s))
                classes.append(key)
                maps.append(parity_map(s))
                if len(s) and key not in seen:
                    seen.add(key)
                    new.append(s)
            yield _scan_batch(
                len(sizes), doc_id=batch.column("doc_id"), n=pa.array(sizes, pa.int64()),
                cls=pa.array(classes, pa.int64()),
                **{c: pa.array([m[k] for m in maps], pa.int64()) for k, c in enumerate(_MAP)},
            )
            if new:
                hashes = np.concatenate(new)
                of_range = (hashes & np.uint64(0xFFFFFF)).astype(np.int64) % ranges
                both = np.sort((of_range.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
                bounds = np.append(np.searchsorted(both, starts), len(both))
                full = np.flatnonzero(np.diff(bounds))
                kept = both.astype(np.uint32)
                yield _scan_batch(
                    len(full), range=pa.array(full.astype(np.int32)),
                    hashes=pa.array([packed(kept[a:b]) for a, b in zip(bounds[full], bounds[full + 1], strict=True)], pa.binary()),
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(lean(run), _SCAN)


def packed(values: np.ndarray) -> bytes:
    """Ascending 32-bit values as 16-bit differences; a larger one is 0xFFFF and its value."""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    large = gaps >= 0xFFFF
    short = np.where(large, 0xFFFF, gaps).astype("<u2")
    head = np.array([len(values)], dtype="<u4")
    return head.tobytes() + short.tobytes() + gaps[large].astype("<u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    gaps = np.frombuffer(raw, "<u2", n, 4).astype(np.int64)
    large = gaps == 0xFFFF
    gaps[large] = np.frombuffer(raw, "<u4", int(large.sum()), 4 + 2 * n)
    return np.cumsum(gaps).astype(np.uint32)


def _scan_batch(rows: int, **columns) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "cls": pa.int64(),
             **dict.fromkeys(_MAP, pa.int64()), "range": pa.int32(), "hashes": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [columns.get(name, pa.nulls(rows, kind)) for name, kind in kinds.items()], list(kinds)
    )


def _levels(pieces: DataFrame) -> np.ndarray:
    """Table of frequency levels by shingle, of fixed size, from all documents' shingles."""

    def count(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([unpacked(v.as_py()) for v in table.column("hashes")])
        del table
        tokens.sort()
        # Equal ones stand together; those that are as frequent have one HOT_COUNT places on.
        first = np.flatnonzero(tokens[HOT_COUNT - 1 :] == tokens[: max(0, len(tokens) - HOT_COUNT + 1)])
        hot = np.unique(tokens[first])
        counts = np.searchsorted(tokens, hot, "right") - np.searchsorted(tokens, hot, "left")
        del tokens
        levels = np.log2(counts).astype(np.int32)
        cells = (hot & np.uint32(LEVEL_CELLS - 1)).astype(np.int32)
        release_memory()
        return pa.table({"cell": pa.array(cells), "level": pa.array(levels)})

    found = pieces.groupBy("range").applyInArrow(count, "cell int, level int")
    found = reliable_checkpoint(found.groupBy("cell").agg(F.max("level").alias("level")))
    sizes = {r["level"]: r["count"] for r in found.groupBy("level").count().collect()}
    least, total = 64, 0
    for level in sorted(sizes, reverse=True):  # the most frequent that fit the bound
        total += sizes[level]
        if total > HOT_SHINGLES:
            break
        least = level
    table = np.zeros(LEVEL_CELLS, dtype=np.uint8)
    for row in found.filter(F.col("level") >= least).toLocalIterator():
        table[row["cell"]] = row["level"]
    return table


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set in the global order: by level, then by hash."""
    level = levels[((s >> np.uint64(32)) & np.uint64(LEVEL_CELLS - 1)).astype(np.int64)]
    return s[np.argsort(level, kind="stable")] if level.any() else s


def _postings(docs: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """``token, n, pos, cls``: the prefixes, each class once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            tokens, sizes, keys = [], [], []
            for s in text_sets(batch.column("text"), width):
                if not len(s) or (key := class_of(s)) in seen:
                    continue
                seen.add(key)
                tokens.append(ordered(s, shared.value)[: prefix_length(len(s), percent)])
                sizes.append(len(s))
                keys.append(key)
            if not tokens:
                continue
            lengths = np.array([len(t) for t in tokens])
            pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)),
                 pa.array(np.repeat(np.array(sizes, dtype=np.int32), lengths)),
                 pa.array(pos.astype(np.int32)),
                 pa.array(np.repeat(np.array(keys, dtype=np.int64), lengths))],
                list(_LIST),
            )

    return docs.select("text").mapInArrow(lean(run), _LIST_TYPE)


_LIST = ("token", "n", "pos", "cls")
_LIST_TYPE = "token bigint, n int, pos int, cls bigint"


def _lists(batches, columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Batches of sorted rows, cut between tokens so that no list is split."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if held is not None:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
        token = rows[0]
        if not len(token):
            continue
        cut = int(np.searchsorted(token, token[-1], "left"))
        held = [r[cut:] for r in rows]
        if cut:
            yield [r[:cut] for r in rows]
    if held is not None and len(held[0]):
        yield held


def _shared_lists(postings: DataFrame) -> DataFrame:
    """Postings of shingles that two classes or more have, each class once."""

    def run(batches):
        for token, n, pos, cls in _lists(batches, _LIST):
            keep = np.ones(len(token), dtype=bool)  # a class that several tasks saw
            keep[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
            token, n, pos, cls = (x[keep] for x in (token, n, pos, cls))
            same = token[1:] == token[:-1]
            keep = np.zeros(len(token), dtype=bool)
            keep[1:] |= same
            keep[:-1] |= same
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep]) for x in (token, n, pos, cls)], list(_LIST)
            )

    return _by_token(postings).mapInArrow(lean(run), _LIST_TYPE)


def _room(n, pos, i, j, percent: int) -> np.ndarray:
    """Pairs of entries whose sizes and positions leave room for the needed overlap."""
    before = np.minimum(pos[i], pos[j])
    after = np.minimum(n[i] - pos[i], n[j] - pos[j])
    return before + after >= needed(n[i].astype(np.int64), n[j].astype(np.int64), percent)


def centre_pairs(token, n, pos, cls, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Every entry with its list's centre and with the entry before it."""
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    lengths = np.diff(np.append(first, len(token)))
    # The centre is the entry with the fewest rarer shingles before this one, so the one with
    # the fewest changes of its own in a group of changed copies.
    order = np.lexsort((cls, pos, token))
    centre = np.repeat(order[first], lengths)
    entry = np.arange(len(token))
    follows = np.ones(len(token), dtype=bool)
    follows[first] = False
    i = np.concatenate([centre, entry[follows] - 1])
    j = np.concatenate([entry, entry[follows]])
    ok = (i != j) & _room(n, pos, i, j, percent)
    return i[ok], j[ok]


def list_pairs(
    n, pos, group, maps, percent: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one list, sorted by size, of different groups, block by block.

    ``maps`` has the words of the parity maps in its rows.
    """
    size = len(n)
    blocks = range(0, size, BLOCK)
    room = n - pos
    for a in blocks:
        i = np.arange(a, min(a + BLOCK, size))
        most_room = room[i].max()
        most_before = pos[i].max()
        for b in range(a, size, BLOCK):
            j = np.arange(b, min(b + BLOCK, size))
            if 100 * int(n[i[-1]]) < percent * int(n[b]):
                break  # sizes only grow from here
            bound = min(int(most_room), int(room[j].max())) + min(int(most_before), int(pos[j].max()))
            if bound < needed(int(n[a]), int(n[b]), percent):
                continue  # no position in these blocks leaves room
            x, y = np.repeat(i, len(j)), np.tile(j, len(i))
            ok = (x < y) & (group[x] != group[y])
            x, y = x[ok], y[ok]
            ok = _room(n, pos, x, y, percent)
            x, y = x[ok], y[ok]
            differ = np.bitwise_count(maps[:, x] ^ maps[:, y]).sum(axis=0, dtype=np.int64)
            both = n[x].astype(np.int64) + n[y]
            ok = both - differ >= 2 * needed(both, 0, percent)
            if ok.any():
                yield x[ok], y[ok]


_PAIR = "a bigint, b bigint, na int, nb int, ia int, ib int, m int"


def _emit(n, pos, cls, i, j) -> pa.RecordBatch:
    """Ordered pairs of classes: sizes, last shared positions, number of shared shingles."""
    swap = cls[i] > cls[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    order = np.lexsort((cls[j], cls[i]))
    i, j = i[order], j[order]
    a, b = cls[i], cls[j]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
    count = np.diff(np.append(first, len(a)))
    last = [np.maximum.reduceat(pos[x], first) if len(a) else pos[:0] for x in (i, j)]
    columns = [a[first], b[first], n[i][first], n[j][first], *last, count.astype(np.int32)]
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in columns], ["a", "b", "na", "nb", "ia", "ib", "m"]
    )


def _candidates(found: DataFrame, percent: int) -> DataFrame:
    """Pairs whose shared prefix shingles leave room for the overlap they need.

    ``m`` shared shingles are counted up to the last shared position of both. Of the rest,
    what one prefix still covers is not shared, so all others lie behind that prefix.
    """
    pairs = found.groupBy("a", "b").agg(
        F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("ia").alias("ia"),
        F.max("ib").alias("ib"), F.sum("m").alias("m"),
    )
    behind = {x: F.expr(f"({percent}L * {x} + 99) div 100 - 1") for x in ("na", "nb")}
    rest = F.greatest(
        F.least(behind["na"], F.col("nb") - 1 - F.col("ib")),
        F.least(behind["nb"], F.col("na") - 1 - F.col("ia")),
    )
    need = F.expr(f"({percent}L * (na + nb) + {99 + percent}) div {100 + percent}")
    return pairs.filter(F.col("m") + rest >= need).select("a", "b")


def _first_round(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs with the centre of a list; one that is missed here is left to the second round."""

    def run(batches):
        for token, n, pos, cls in _lists(batches, _LIST):
            yield _emit(n, pos, cls, *centre_pairs(token, n, pos, cls, percent))

    return _candidates(lists.mapInArrow(lean(run), _PAIR), percent)


def _by_token(lists: DataFrame) -> DataFrame:
    return lists.repartition("token").sortWithinPartitions("token", "n", "cls")


def _mixed_lists(lists: DataFrame) -> DataFrame:
    """The lists that hold more than one component; in the others all answers are known."""

    def run(batches):
        names = [*_LIST, "group"]
        for token, n, pos, cls, group in _lists(batches, names):
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            several = np.minimum.reduceat(group, first) != np.maximum.reduceat(group, first)
            keep = np.repeat(several, np.diff(np.append(first, len(token))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep]) for x in (token, n, pos, cls, group)], names
            )

    return lists.mapInArrow(lean(run), f"{_LIST_TYPE}, group bigint")


def _second_round(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components; ``lists`` has each class's component and parity map."""

    def run(batches):
        for token, n, pos, cls, group, *words in _lists(batches, (*_LIST, "group", *_MAP)):
            maps = np.stack(words).view(np.uint64)
            edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2 or (group[a:b] == group[a]).all():
                    continue
                for i, j in list_pairs(
                    n[a:b], pos[a:b], group[a:b], maps[:, a:b], percent
                ):
                    found.append((i + a, j + a))
                    held += len(i)
                    if held > EMIT_PAIRS:
                        yield _emit(n, pos, cls, *(np.concatenate(x) for x in zip(*found, strict=True)))
                        found, held = [], 0
            if found:
                yield _emit(n, pos, cls, *(np.concatenate(x) for x in zip(*found, strict=True)))

    return _candidates(lists.mapInArrow(lean(run), _PAIR), percent)


def _sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``cls, items`` of the given classes: their sets, made from the texts again.

    The scan knows each row's class by making its set; the Bloom filter keeps all but a few of
    the other classes back, and a join removes those.
    """
    # A class's own bits serve as its hash, so the scan asks the filter without Spark.
    wanted = classes.select("cls").distinct()
    slots = (
        wanted.select(
            F.pmod("cls", F.lit(BLOOM_WORDS)).alias("word"),
            F.expr("shiftleft(1L, cast(pmod(shiftright(cls, 40), 64) as int))").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    table = np.zeros(BLOOM_WORDS, dtype=np.int64)
    for row in slots.collect():  # at most BLOOM_WORDS rows
        table[row["word"]] = row["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            classes, items = [], []
            for s in text_sets(batch.column("text"), width):
                if not len(s):
                    continue
                key = class_of(s)
                word = int(shared.value[key % BLOOM_WORDS])
                if not word >> ((key >> 40) % 64) & 1 or key in seen:
                    continue
                seen.add(key)
                classes.append(key)
                items.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.int64()), pa.array(items, pa.binary())], ["cls", "items"]
            )

    made = docs.select("text").mapInArrow(lean(run), "cls bigint, items binary")
    return made.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by exact intersection."""
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                t = np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(s) + len(t) - len(np.union1d(s, t))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", "x", "y").mapInArrow(lean(run), "a bigint, b bigint")


def _round(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int
) -> DataFrame:
    """Links among candidate pairs, as edges between class representatives."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    links = _verified(pairs, _sets(docs, ends, width), percent)
    one = classes.select(F.col("cls").alias("a"), F.col("rep").alias("u"))
    two = classes.select(F.col("cls").alias("b"), F.col("rep").alias("v"))
    return reliable_checkpoint(links.join(one, "a").join(two, "b").select("u", "v"))


def _prepared(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, ...]:
    """Signatures of all rows; classes, shared lists and first candidates of rows with id."""
    spark = docs.sparkSession
    bound_batches(spark)
    path = scratch_path(spark, "shingles")
    ranges = max(16, docs.rdd.getNumPartitions() // 4)
    _scan(docs, width, ranges, _value_bits(docs, ranges)).write.parquet(path)
    scanned = reliable_checkpoint(
        spark.read.parquet(path).filter(F.col("range").isNull()).drop("range", "hashes")
    )
    signatures = scanned.select("doc_id", "n", "cls")
    pieces = spark.read.parquet(path).filter(F.col("range").isNotNull())
    levels = _levels(pieces.select("range", "hashes"))
    # The shingles are not needed again: an empty table takes their place.
    spark.createDataFrame([], pieces.schema).write.mode("overwrite").parquet(path)
    usable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = reliable_checkpoint(
        scanned.filter(usable)
        .groupBy("cls")
        .agg(F.min("doc_id").alias("rep"), *[F.max(c).alias(c) for c in _MAP])
    )
    lists = reliable_checkpoint(
        _shared_lists(
            _postings(docs.filter(F.col("doc_id").isNotNull()), levels, width, percent)
        )
    )
    first = reliable_checkpoint(_first_round(lists, percent))
    return signatures, classes, lists, first


def similarity_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    signatures, classes, lists, first = _prepared(docs, width, percent)
    named = signatures.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    edges = _round(first, docs, classes, width, percent)
    # Rows of one id with different sets are one node.
    repeated = named.select("doc_id", "cls").join(classes, "cls").select(
        F.col("doc_id").alias("u"), F.col("rep").alias("v")
    )
    repeats = repeated.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).filter("a < b")
    same_id = repeated.join(repeats.select("u"), "u", "left_semi")
    edges = reliable_checkpoint(edges.unionByName(same_id))
    groups = components(edges)

    known = reliable_checkpoint(
        classes.join(groups, F.col("rep") == F.col("node"), "left").select(
            "cls", F.coalesce("component", "rep").alias("group"), *_MAP
        )
    )
    mixed = _mixed_lists(_by_token(lists.join(known.select("cls", "group"), "cls")))
    grouped = _by_token(mixed.join(known.select("cls", *_MAP), "cls"))
    second = _second_round(grouped, percent).join(first, ["a", "b"], "left_anti")
    by_group = known.select("cls", F.col("group").alias("rep"))
    more = components(_round(reliable_checkpoint(second), docs, by_group, width, percent))

    final = known.join(more, F.col("group") == F.col("node"), "left").select(
        "cls", F.coalesce("component", "group").alias("__component")
    )
    linked = signatures.join(final, "cls", "left")
    return linked.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
        .when(F.col("n") == 0, F.col("doc_id"))
        .otherwise(F.col("__component"))
        .alias("component_id"),
    )


# Links ----------------------------------------------------------------------------------


def _described(links: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Every class by a base and what it lacks of that (``gone``) and has besides (``new``).

    The base is the class itself or the one of its ``links`` with the most links, so members
    of a group of similar sets mostly have one base.
    """
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = reliable_checkpoint(ends.groupBy("a").agg(F.count("*").alias("k")))
    own = degree.select("a", F.col("a").alias("b"), "k")
    near = ends.join(degree.withColumnRenamed("a", "b"), "b").select("a", "b", "k").unionByName(own)
    bases = near.groupBy("a").agg(F.max(F.struct("k", "b"))["b"].alias("base"))
    own = classes.select("cls").distinct().join(bases, F.col("cls") == F.col("a"), "left").select(
        "cls", F.coalesce("base", "cls").alias("base")
    )
    base_sets = sets.select(F.col("cls").alias("base"), F.col("items").alias("whole"))

    def run(batches):
        for batch in batches:
            sizes, base_sizes, gone, new = [], [], [], []
            for x, y in zip(batch.column("items"), batch.column("whole"), strict=True):
                s = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                t = np.frombuffer(y.as_buffer(), dtype=np.uint64)
                sizes.append(len(s))
                base_sizes.append(len(t))
                gone.append(np.setdiff1d(t, s, assume_unique=True).tobytes())
                new.append(np.setdiff1d(s, t, assume_unique=True).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), batch.column("base"), pa.array(sizes, pa.int64()),
                 pa.array(base_sizes, pa.int64()), pa.array(gone, pa.binary()),
                 pa.array(new, pa.binary())],
                ["cls", "base", "size", "base_size", "gone", "new"],
            )

    joined = own.join(sets, "cls").join(base_sets, "base").select("cls", "base", "items", "whole")
    return joined.mapInArrow(
        lean(run), "cls bigint, base bigint, size bigint, base_size bigint, gone binary, new binary"
    )


def _derived(pairs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """The pairs of one base that link, by exact intersection from their differences to it.

    What neither lacks of the base is shared, and so is what both have besides.
    """

    def run(batches):
        for batch in batches:
            keep = []
            columns = (batch.column(c) for c in ("size_a", "size_b", "base_size", "gone_a", "gone_b", "new_a", "new_b"))
            for m, n, whole, *parts in zip(*columns, strict=True):
                gone_a, gone_b, new_a, new_b = (np.frombuffer(x.as_buffer(), np.uint64) for x in parts)
                both = whole.as_py() - len(np.union1d(gone_a, gone_b))
                both += len(np.intersect1d(new_a, new_b, assume_unique=True))
                keep.append(100 * both >= percent * (m.as_py() + n.as_py() - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(x: str) -> DataFrame:
        return described.select(
            F.col("cls").alias(x), "base", "base_size",
            *[F.col(c).alias(f"{c}_{x}") for c in ("size", "gone", "new")],
        )

    right = side("b").drop("base_size").withColumnRenamed("base", "__base")
    joined = pairs.join(side("a"), "a").join(right, "b").filter(F.col("base") == F.col("__base"))
    return joined.drop("base", "__base").mapInArrow(lean(run), "a bigint, b bigint")


def similarity_links(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame]:
    """All links: ``doc_id, n_shingles, class_id`` of every row, and ``a, b`` of class ids.

    Rows with equal sets have one class; every pair of different classes that links is listed
    once, ``a < b``. Rows without id or without shingles have no class. A class id is a
    fingerprint of the set. There are as many rows as links, so a group of similar sets gives
    up to the square of its classes; the pairs are verified from the sets' differences to a
    common base where they have one, and on whole sets elsewhere.
    """
    docs = docs.select("doc_id", "text")
    signatures, classes, lists, first = _prepared(docs, width, percent)
    named_docs = docs.filter(F.col("doc_id").isNotNull())
    # Every class is a group of its own here, so no pair of a list is passed over.
    grouped = _by_token(
        lists.withColumn("group", F.col("cls")).join(classes.select("cls", *_MAP), "cls")
    )
    pairs = reliable_checkpoint(_second_round(grouped, percent))
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    sets = reliable_checkpoint(_sets(named_docs, ends, width))
    known = reliable_checkpoint(
        _verified(first.join(pairs, ["a", "b"], "left_semi"), sets, percent)
    )
    described = reliable_checkpoint(_described(known, ends, sets))
    base_of = described.select("cls", "base")
    rest = pairs.join(known, ["a", "b"], "left_anti")
    one = base_of.select(F.col("cls").alias("a"), F.col("base").alias("x"))
    two = base_of.select(F.col("cls").alias("b"), F.col("base").alias("y"))
    based = reliable_checkpoint(rest.join(one, "a").join(two, "b"))
    alike = based.filter("x = y").select("a", "b")
    others = based.filter("x != y").select("a", "b")
    links = reliable_checkpoint(
        known.unionByName(_derived(alike, described, percent)).unionByName(_verified(others, sets, percent))
    )
    has_class = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    members = signatures.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(has_class, F.col("cls")).alias("class_id")
    )
    return members, links


def link_counts(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, class_id, n_links, component_id`` of every row.

    Links to other classes count. The component is the smallest id that links reach, as in
    ``similarity_components``: the row's own id without shingles, NULL without id.
    """
    members, links = similarity_links(docs, width, percent)
    members = reliable_checkpoint(members)
    ends = links.select("a").unionByName(links.select(F.col("b").alias("a")))
    counts = ends.groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("n_links"))

    named = members.filter(F.col("class_id").isNotNull())
    # Classes of one id are one node of the graph.
    several = named.groupBy("doc_id").agg(F.min("class_id").alias("u"), F.max("class_id").alias("v"))
    same_id = named.join(several.filter("u < v").drop("v"), "doc_id").select("u", F.col("class_id").alias("v"))
    groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same_id))
    least = named.groupBy("class_id").agg(F.min("doc_id").alias("least"))
    placed = reliable_checkpoint(
        least.join(groups, F.col("class_id") == F.col("node"), "left").select(
            "class_id", "least", F.coalesce("component", "class_id").alias("group")
        )
    )
    first = placed.groupBy("group").agg(F.min("least").alias("first"))
    by_class = placed.join(first, "group").select("class_id", "first")
    return members.join(counts, "class_id", "left").join(by_class, "class_id", "left").select(
        "doc_id",
        "n_shingles",
        "class_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("first", "doc_id").alias("component_id"),
    )


# The same rule for DuckDB: all pairs that share a shingle, then everything reachable by links.
ORACLE = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ 	-
]+') AS words FROM documents),
shingle AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[pos : pos + size - 1], chr(10)) AS s
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS pos
        FROM (SELECT *, least(len(words), {WIDTH}) AS size FROM doc WHERE len(words) > 0))),
sized AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
  WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least_id, d.doc_id)) AS component_id
FROM doc d LEFT JOIN sized USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY 1) USING (doc_id)"""
