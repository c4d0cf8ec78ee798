"""Repair of damaged conversations by a cheapest sequence of edits.

A conversation should read, by the initials of its roles, ``(s?(ua)+)?``. Rows may be kept,
given another role or deleted, and empty turns may be inserted, at fixed costs. States of the
pattern at the places between rows are nodes, edits are arcs. The least costs to the end come
from a backward pass; arcs that lie on a cheapest path are kept; nodes are then ranked by their
least audits of 1, 2, 4, 8, ... letters, each rank from the two ranks of half the length, with a
pointer that many edits ahead. Ranks choose the arc, doubled pointers read the path off. No two
arcs of one node have the same letter, so a pointer has one target, and the choice at a node
never depends on what follows its segment.

How it is spread: equal rows are counted first, narrow rows (a hash in place of the text) are
sorted over all tasks and cut into segments of at most ``SEGMENT_ROWS`` rows of one
conversation. A segment is reduced to a 4 x 4 matrix of least costs; the matrices of a
conversation are multiplied from its end, which gives every segment the costs at its right
border; segments are then solved apart, for each state they may be entered in, and joined by
state. One conversation may thus hold any share of all rows. Only its audit (one letter a row)
and the hash of its repaired text, which are single values of one conversation and are made in
order by definition, go through one task; texts stream through it and are not held.

Results in special cases:

* Null roles and texts are one space. A row with another initial than s, u or a, an empty role
  included, cannot be kept, and no pair with it is legal.
* Null conv_ids form one conversation. Null turns come first.
* Rows of one turn are ordered by role and then by the SHA-256 of the text, so the order does
  not depend on how rows are stored; equal rows stand together and all but the first of a
  conversation are duplicates.
* Empty texts are blank; very long texts are hashed and streamed, never gathered.
* A conversation of which no row is left has zeros, an empty audit and the empty string's hash.
  An empty table gives no rows.
* Columns other than the four are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import bound_batches
from lectern.llm.manifest import crc32_sql
from lectern.session import reliable_checkpoint

SEGMENT_ROWS = 1024
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
_FAR = 1 << 40
# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
_AFTER = np.array([2, 2, 3, 2])  # where an inserted or re-roled turn leads from each state
_MAY_KEEP = {1: {0: 1}, 2: {0: 2, 1: 2, 3: 2}, 3: {2: 3}}  # initial s, u, a: state to state
_END = (0, 2 * INSERT, INSERT, 0)
_ROLES = {2: "user", 3: "assistant"}
_LETTERS = np.frombuffer(b"DIKR", np.uint8)  # in ASCII order
_LIVE, _CUT = 4, 8  # flags beside a row's initial (0 to 3): it may stay, it is truncated

_HAS_WORD = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows dropped, emptied, cut, doubled or given role user."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("__kind"))
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", ""))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("__kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.when(F.col("__kind") == 0, 0).when(F.col("__kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _step_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By kind of row: costs of K and R from each state, where K leads, the 4 x 4 step costs."""
    keep = np.full((16, 4), _FAR)
    rerole = np.full((16, 4), _FAR)
    target = np.zeros((16, 4), np.int64)
    steps = np.full((16, 4, 4), _FAR)
    states = np.arange(4)
    for kind in range(16):
        if not kind & _LIVE:  # deleted; its copies' cost is added apart
            steps[kind, states, states] = 0
            continue
        late = UNFINISHED if kind & _CUT else 0
        steps[kind, states, states] = DELETE
        for state, to in _MAY_KEEP.get(kind & 3, {}).items():
            keep[kind, state], target[kind, state] = KEEP + late, to
            steps[kind, state, to] = min(steps[kind, state, to], KEEP + late)
        rerole[kind] = REROLE + late
        steps[kind, states, _AFTER] = np.minimum(steps[kind, states, _AFTER], REROLE + late)
    insert = np.full((4, 4), _FAR)
    insert[states, states] = 0
    insert[states, _AFTER] = INSERT
    insert = np.minimum(insert, (insert[:, :, None] + insert[None]).min(axis=1))
    return keep, rerole, target, (insert[None, :, :, None] + steps[:, None]).min(axis=2), insert


_KEEP_COST, _REROLE_COST, _KEEP_TO, _STEP, _INSERTED = _step_tables()


def _backwards(kinds: np.ndarray, extra: np.ndarray, offsets: np.ndarray, start: np.ndarray):
    """From each segment's end to its begin: yields ``(segments, rows, values)`` place by place.

    ``start`` holds a column or a matrix of costs by segment; values are those before the row.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    values = start.copy()
    for back in range(int(falling[0]) if len(falling) else 0):
        segments = order[: np.searchsorted(-falling, -back, "left")]
        rows = offsets[segments + 1] - 1 - back
        now = values[segments]
        wide = now if now.ndim == 3 else now[:, :, None]
        new = (_STEP[kinds[rows]][:, :, :, None] + wide[:, None]).min(axis=2) + (DELETE * extra[rows])[:, None, None]
        new = np.minimum(new, _FAR)
        values[segments] = new if now.ndim == 3 else new[:, :, 0]
        yield segments, rows, values[segments]


def _transfer(kinds, extra, offsets) -> np.ndarray:
    """Least cost from each state before a segment to each state after it."""
    n = len(offsets) - 1
    out = np.repeat(np.where(np.eye(4, dtype=bool), 0, _FAR)[None], n, axis=0)
    for segments, _, values in _backwards(kinds, extra, offsets, out):
        out[segments] = values
    return out


_SEGMENT = (
    "seq long, kinds array<tinyint>, extra array<bigint>, costs array<bigint>, blank long, duplicate long, truncated long, "
    "illegal long, first_code int, last_code int, least_turn long, last_turn long, turns long"
)


def _list(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _pack(batches: Iterator[pa.RecordBatch], segment_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted narrow rows to segments of one conversation, with their sums and matrix."""
    seq = TaskContext.get().partitionId() << 40
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = np.asarray(batch.column("conv_id").dictionary_encode(null_encoding="encode").indices)
        changes = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        inside = np.arange(n) - np.repeat(changes, np.diff(np.r_[changes, n]))
        begins = np.flatnonzero(inside % segment_rows == 0)
        offsets = np.r_[begins, n]
        column = lambda name: np.asarray(batch.column(name))  # noqa: E731, B023
        code, copies = column("code").astype(np.int64), column("copies")
        blank, cut, fresh = column("blank"), column("cut"), column("fresh")
        live = fresh & ~blank & (copies > 0)
        extra = copies - live
        kinds = code + _LIVE * live + _CUT * (live & cut)
        there = copies > 0
        # Codes of the row before, inside the segment; rows without copies stand first and alone.
        owner = np.repeat(np.arange(len(begins)), np.diff(offsets))
        before = np.r_[-1, code[:-1]]
        linked = np.r_[False, there[:-1] & (owner[1:] == owner[:-1])]
        legal = (code == 2) & ((before == 1) | (before == 3)) | (code == 3) & (before == 2)
        illegal = np.maximum(copies - 1, 0) + (linked & there & ~legal)
        turns = batch.column("turn")
        known = np.asarray(turns.is_valid()) & there
        turn = np.asarray(turns.fill_null(0))
        fresh_turn = known & np.r_[True, ~known[:-1] | (turn[1:] != turn[:-1]) | (owner[1:] != owner[:-1])]
        total = lambda values: np.add.reduceat(values.astype(np.int64), begins)  # noqa: E731, B023
        any_turn = total(known) > 0
        low = np.minimum.reduceat(np.where(known, turn, np.iinfo(np.int64).max), begins)
        high = np.maximum.reduceat(np.where(known, turn, np.iinfo(np.int64).min), begins)
        firsts = np.where(there[begins] | (np.diff(offsets) == 1), begins, begins + 1)
        some = total(there) > 0
        transfer = _transfer(kinds, extra, offsets)
        numbers = seq + np.arange(len(begins))
        seq += len(begins)
        yield pa.RecordBatch.from_pydict(
            {
                "conv_id": batch.column("conv_id").take(pa.array(begins)),
                "seq": pa.array(numbers),
                "kinds": _list(kinds, offsets, pa.int8()),
                "extra": _list(extra, offsets, pa.int64()),
                "costs": _list(transfer.ravel(), np.arange(len(begins) + 1) * 16, pa.int64()),
                "blank": pa.array(total(np.where(blank, copies, 0))),
                "duplicate": pa.array(total(np.where(blank, 0, extra))),
                "truncated": pa.array(total(live & cut)),
                "illegal": pa.array(total(illegal)),
                "first_code": pa.array(np.where(some, code[firsts], -1), pa.int32()),
                "last_code": pa.array(np.where(some, code[offsets[1:] - 1], -1), pa.int32()),
                "least_turn": pa.array(low, pa.int64(), mask=~any_turn),
                "last_turn": pa.array(high, pa.int64(), mask=~any_turn),
                "turns": pa.array(total(fresh_turn)),
            }
        )


def _right_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from the last of a conversation to the first: costs at their right borders."""
    names = ("seq", "right", "is_first", "is_last")
    held = None  # the segment before in this order, told apart when the next one is known
    conv, after = None, None

    def batch_of(rows):
        return pa.RecordBatch.from_pydict(
            dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)),
            schema=pa.schema([("seq", pa.int64()), ("right", pa.list_(pa.int64())), ("is_first", pa.bool_()), ("is_last", pa.bool_())]),
        )

    for batch in batches:
        rows = []
        for own, seq, costs in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "costs")), strict=True):
            starts = held is None or own != conv
            if held is not None:
                rows.append((*held[:2], starts, held[2]))
            if starts:
                after = list(_END)
            held = (seq, after, starts)
            conv = own
            after = [min(costs[4 * q + p] + after[p] for p in range(4)) for q in range(4)]
        if rows:
            yield batch_of(rows)
    if held is not None:
        yield batch_of([(*held[:2], True, held[2])])


class Paths:
    """Least audits from every node of some segments: ranks and pointers, doubled in length.

    Nodes are ``4 * place + state``; a segment of n rows has n + 1 places. ``letter`` is the
    least edit on a cheapest path (4 at the end), ``jumps[k]`` the node 2 ** k edits ahead.
    """

    def __init__(self, kinds, extra, offsets, right, is_last):
        n, count = len(kinds), len(offsets) - 1
        self.offsets = offsets
        owner = np.repeat(np.arange(count), np.diff(offsets))
        self.place_of_row = np.arange(n) + owner
        self.row_of_place = np.full(n + count, -1)
        self.row_of_place[self.place_of_row] = np.arange(n)
        ends = offsets[1:] + np.arange(count)
        value = np.empty((n + count, 4), np.int64)
        value[ends] = right
        for _, rows, values in _backwards(kinds, extra, offsets, right):
            value[self.place_of_row[rows]] = values
        self.value = value
        places = np.arange(n + count)
        row = np.maximum(self.row_of_place, 0)
        on_row = (self.row_of_place >= 0)[:, None] if n else np.zeros((count, 1), bool)
        kind = kinds[row] if n else np.zeros(count, np.int64)
        more = (DELETE * extra[row] if n else np.zeros(count, np.int64))[:, None]
        later = np.minimum(places + 1, n + count - 1)
        ahead = value[later]
        states = np.arange(4)
        inserts = on_row.copy()
        inserts[ends] = is_last[:, None]
        remove = np.where(kind & _LIVE, DELETE, 0)[:, None]
        # Arcs of the letters D, I, K, R: whether they lie on a cheapest path, and where they lead.
        arcs = np.stack(
            [
                on_row & (value == remove + more + ahead),
                inserts & (value == INSERT + value[:, _AFTER]),
                on_row & (value == _KEEP_COST[kind] + more + np.take_along_axis(ahead, _KEEP_TO[kind], 1)),
                on_row & (value == _REROLE_COST[kind] + more + ahead[:, _AFTER]),
            ]
        )
        nexts = np.stack(
            [
                4 * later[:, None] + states,
                4 * places[:, None] + _AFTER,
                4 * later[:, None] + _KEEP_TO[kind],
                np.broadcast_to(4 * later[:, None] + _AFTER, value.shape),
            ]
        )
        # Costs beyond reach lead nowhere.
        arcs &= value < _FAR
        arcs, nexts = arcs.reshape(4, -1), nexts.reshape(4, -1)
        ended = ~arcs.any(axis=0)
        self.letter = np.where(ended, 4, arcs.argmax(axis=0))
        itself = np.arange(arcs.shape[1])
        nexts[:, ended] = itself[ended]
        arcs[0, ended] = True
        ranks = np.where(ended, 0, self.letter + 1)
        jump = nexts[np.minimum(self.letter, 3), itself]
        steps = (~ended).astype(np.int64)
        self.jumps, self.ranks = [], [ranks]
        while True:
            # A node's first 2 ** k letters rank it; the least arc is that of the least rank ahead.
            self.jumps.append(jump)
            further = steps[jump]
            if not further.any():
                break
            pairs = ranks * (ranks.max() + 1) + ranks[jump]
            ranks = np.unique(pairs, return_inverse=True)[1].ravel()
            self.ranks.append(ranks)
            steps = steps + further
            jump = jump[jump]
        # The arc whose letter and whose target's rank are least.
        ahead_rank = np.where(arcs, (np.arange(4)[:, None] << 40) + ranks[nexts], np.iinfo(np.int64).max)
        chosen = ahead_rank.argmin(axis=0)
        self.jumps[0] = nexts[chosen, itself]
        self.steps = steps

    def read(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All nodes on the paths from ``nodes``, ends left out, and each path's bounds."""
        counts = self.steps[nodes]
        bounds = np.r_[0, np.cumsum(counts)]
        at = np.repeat(nodes, counts)
        step = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)
        for k, jump in enumerate(self.jumps):
            hit = (step >> k) & 1 == 1
            at[hit] = jump[at[hit]]
        return at, bounds

    def ends(self, nodes: np.ndarray) -> np.ndarray:
        """The last node of the paths from ``nodes``."""
        step, at = self.steps[nodes], nodes.copy()
        for k, jump in enumerate(self.jumps):
            hit = (step >> k) & 1 == 1
            at[hit] = jump[at[hit]]
        return at


_SOLVED = "seq long, exits array<int>, audits array<string>, cost long"


def _flat(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64)


def _cut_by_rows(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` rows in all their segments."""
    for batch in batches:
        ends = np.cumsum(np.asarray(batch.column("kinds").value_lengths()).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
            yield batch.slice(low, high - low)
            low = high


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their right costs to the audit and exit state of each state of entry.

    The first segment of a conversation is only entered in state 0.
    """
    for batch in _cut_by_rows(batches):
        count = batch.num_rows
        kinds, extra = _flat(batch.column("kinds")), _flat(batch.column("extra"))
        offsets = np.r_[0, np.cumsum(np.asarray(batch.column("kinds").value_lengths()))].astype(np.int64)
        right = _flat(batch.column("right")).reshape(count, 4)
        paths = Paths(kinds, extra, offsets, right, np.asarray(batch.column("is_last")))
        entries = np.where(np.asarray(batch.column("is_first")), 1, 4)
        segment = np.repeat(np.arange(count), entries)
        first = np.r_[0, np.cumsum(entries)]
        state = np.arange(len(segment)) - first[segment]
        begin = 4 * (offsets[:-1] + np.arange(count))
        nodes = begin[segment] + state
        visited, bounds = paths.read(nodes)
        letter = paths.letter[visited]
        row = paths.row_of_place[visited // 4]
        moves = letter != 1
        live = np.zeros(len(visited), bool)
        live[moves] = kinds[row[moves]] & _LIVE > 0
        repeats = np.where(moves, live + np.where(moves, extra[row] if len(extra) else 0, 0), 1)
        starts = np.r_[0, np.cumsum(repeats)]
        signs = np.full(starts[-1], _LETTERS[0], np.uint8)
        shown = repeats > 0
        signs[starts[:-1][shown]] = _LETTERS[letter[shown]]
        cuts = pa.array(starts[bounds], pa.int32())
        audits = pa.Array.from_buffers(pa.string(), len(nodes), [None, cuts.buffers()[1], pa.py_buffer(signs.tobytes())])
        firsts = pa.array(first, pa.int32())
        yield pa.RecordBatch.from_pydict(
            {
                "seq": batch.column("seq"),
                "exits": pa.ListArray.from_arrays(firsts, pa.array(paths.ends(nodes) % 4, pa.int32())),
                "audits": pa.ListArray.from_arrays(firsts, audits),
                "cost": pa.array(paths.value[begin // 4, 0]),
            }
        )


_SUMS = ("blank", "duplicate", "truncated", "illegal")


class _Conversation:
    """One conversation as its segments and then its texts come by."""

    def __init__(self, conv):
        self.conv, self.state, self.pieces, self.cost = conv, 0, [], None
        self.sums, self.turns = [0] * 4, 0
        self.code, self.low, self.high = -1, None, None
        self.audit, self.at, self.place = None, 0, 0

    def add_segment(self, row: dict) -> None:
        if self.cost is None:
            self.cost = row["cost"]
        self.pieces.append(row["audits"][self.state])
        self.state = row["exits"][self.state]
        for i, name in enumerate(_SUMS):
            self.sums[i] += row[name]
        if row["first_code"] >= 0:
            if self.code >= 0:
                self.sums[3] += (self.code, row["first_code"]) not in ((1, 2), (2, 3), (3, 2))
            self.code = row["last_code"]
        if row["least_turn"] is not None:
            self.turns += row["turns"] - (self.high == row["least_turn"])
            self.low = row["least_turn"] if self.low is None else self.low
            self.high = row["last_turn"]

    def begin(self) -> None:
        if self.audit is None:
            self.audit, self.state, self.pieces = "".join(self.pieces), 0, []

    def inserted(self):
        """Turns that the audit inserts at this place."""
        self.begin()
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = int(_AFTER[self.state])
            yield _ROLES[self.state], "", "I"

    def play(self, role: str, text: str):
        """Turns that come of the next row, inserted ones first."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield role, text, "K"
        elif letter == "R":
            self.state = int(_AFTER[self.state])
            yield _ROLES[self.state], text, "R"

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _conversations(batches: Iterator[pa.RecordBatch], on_turn):
    """Conversations, each when its last row has been played; None after each batch."""
    own = None
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(c).to_pylist() for c in names]
        for values in zip(*columns, strict=True):
            row = dict(zip(names, values, strict=True))
            if own is None or row["conv_id"] != own.conv:
                if own is not None:
                    for turn in own.inserted():
                        on_turn(own, *turn)
                    yield own
                own = _Conversation(row["conv_id"])
            if row["seq"] is not None:
                own.add_segment(row)
            else:
                for _ in range(row["copies"]):
                    for turn in own.play(row["role"], row["text"]):
                        on_turn(own, *turn)
        yield None
    if own is not None:
        for turn in own.inserted():
            on_turn(own, *turn)
        yield own


_OUT_ROWS, _OUT_CHARS = 1024, 1 << 20


class _Rows:
    """Rows that wait to become a batch of given columns."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, row: tuple, chars: int) -> None:
        self.rows.append(row)
        self.chars += chars

    def full(self) -> bool:
        return len(self.rows) >= _OUT_ROWS or self.chars >= _OUT_CHARS

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True)
        arrays = [pa.array(c, kind) for c, kind in zip(columns, self.schema.types, strict=True)]
        self.rows, self.chars = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _with_conv(batches, fields: list[tuple[str, pa.DataType]]):
    """The batches, and rows whose ``conv_id`` has the type that it has there."""
    first = next(batches, None)
    if first is None:
        return iter(()), _Rows(pa.schema(fields))
    kind = first.schema.field("conv_id").type
    return chain([first], batches), _Rows(pa.schema([("conv_id", kind), *fields]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = [(name, pa.int64()) for name in ("gaps", *_SUMS, "cost")]
    batches, rows = _with_conv(batches, [*numbers, ("audit", pa.string()), ("repaired_sha256", pa.string())])
    whole = hashlib.sha256()

    def on_turn(own, role, text, edit):
        whole.update(f"{chr(10) if own.place else ''}{role}:{text}".encode())
        own.place += 1

    for own in _conversations(batches, on_turn):
        if own is not None:
            own.begin()
            row = (own.conv, own.gaps(), *own.sums, own.cost, own.audit, whole.hexdigest())
            rows.add(row, len(own.audit))
            whole = hashlib.sha256()
            if rows.full():
                yield rows.take()
    if rows.rows:
        yield rows.take()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
    batches, rows = _with_conv(batches, fields)

    def on_turn(own, role, text, edit):
        rows.add((own.conv, own.place, role, text, edit), len(text))
        own.place += 1

    for _ in _conversations(batches, on_turn):  # also between batches, so that none is held whole
        if rows.full():
            yield rows.take()
    if rows.rows:
        yield rows.take()


def _prepared(rows: DataFrame) -> DataFrame:
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role"), shown("text"), copies.cast("long").alias("copies"))


_ORDER = ["conv_id", "turn", "role", "mark"]


def _marked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mark", F.unhex(F.sha2("text", 256)))


def _segments(rows: DataFrame, conv: str) -> DataFrame:
    there = F.col("copies") > 0
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    narrow = _marked(rows).select(
        "conv_id", *[F.when(there, F.col(c)).alias(c) for c in _ORDER[1:]],
        F.when(there, code).otherwise(0).alias("code"),
        (there & ~F.col("text").rlike(_HAS_WORD)).alias("blank"),
        (there & ~F.col("text").rlike(_ENDED)).alias("cut"), "copies",
    )
    counted = narrow.groupBy(*_ORDER, "code", "blank", "cut").agg(F.sum("copies").alias("copies"))
    # Where a role and text stand at several turns, the first of them is no duplicate.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    several = (
        counted.filter((F.col("copies") > 0) & ~F.col("blank"))
        .groupBy(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("mark").alias("__m"))
        .agg(F.min(turn).alias("__first"), F.count("*").alias("__n"))
        .filter(F.col("__n") > 1)
    )
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("mark") == F.col("__m"))
    fresh = F.col("__first").isNull() | F.col("turn").isNull() | (F.col("turn") == F.col("__first.turn"))
    judged = counted.join(several, same, "left").select(*_ORDER, "code", "blank", "cut", "copies", F.coalesce(fresh, F.lit(False)).alias("fresh"))
    placed = judged.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    longest = SEGMENT_ROWS
    packed = placed.mapInArrow(lambda batches: _pack(batches, longest), f"conv_id {conv}, {_SEGMENT}")
    return reliable_checkpoint(packed)


def _played(rows: DataFrame) -> DataFrame:
    """Solved segments and then the texts of every conversation, each in order in one task."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    segments = _segments(rows, conv)
    right = (
        segments.select("conv_id", "seq", "costs").repartition("conv_id")
        .sortWithinPartitions("conv_id", F.desc("seq"))
        .mapInArrow(_right_costs, "seq long, right array<bigint>, is_first boolean, is_last boolean")
    )
    joined = segments.select("seq", "kinds", "extra").join(right, "seq")
    solved = joined.mapInArrow(_solve, _SOLVED).withColumnRenamed("seq", "__seq")
    about = ["first_code", "last_code", "least_turn", "last_turn", "turns"]
    pieces = segments.join(solved, F.col("seq") == F.col("__seq")).select(
        "conv_id", "seq", "exits", "audits", "cost", *_SUMS, *about
    )
    texts = _marked(rows).filter("copies > 0").select("conv_id", "turn", "role", "mark", "text", "copies")
    both = pieces.unionByName(texts, allowMissingColumns=True).repartition("conv_id")
    order = [F.asc_nulls_last("seq") if c == "seq" else c for c in ["conv_id", "seq", *_ORDER[1:]]]
    return both.sortWithinPartitions(*order).drop("turn", "mark")


_TABLE = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def repair_table(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``rows`` has ``conv_id, turn, role, text`` and may have ``copies``: so often the row is
    there, 0 for a conversation of which it is no longer a row.
    """
    bound_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _played(_prepared(rows)).mapInArrow(_digests, f"conv_id {kind}, {_TABLE}")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, role, text, edit`` (K, R or I)."""
    bound_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, place long, role string, text string, edit string"
    return _played(_prepared(rows)).mapInArrow(_turns, shape)


def _sql_option(letter: str, cost: str, state: int, turn: str | None) -> str:
    said = f"list_prepend({turn}, v{state}.r)" if turn else f"v{state}.r"
    return f"{{'c': v{state}.c + {cost}, 'a': '{letter}' || v{state}.a, 'r': {said}}}"


def _sql_steps() -> str:
    """Least ``(cost, audit, turns)`` before a row of each state, from those behind it."""
    base, late = [], "(CASE WHEN r.cut THEN 5 ELSE 0 END)"
    for state in range(4):
        to = int(_AFTER[state])
        own = f"r.code = {to}" + (" OR r.code = 1" if state == 0 else "")
        kept = f"CASE WHEN r.code = 1 THEN {_sql_option('K', late, 1, 'r.said')} ELSE {_sql_option('K', late, to, 'r.said')} END"
        live = [
            _sql_option("D", "2", state, None),
            f"CASE WHEN {own} THEN {kept} END",
            _sql_option("R", f"1 + {late}", to, f"'{_ROLES[to]}:' || r.text"),
        ]
        base.append(f"CASE WHEN r.live THEN list_min([{', '.join(live)}]) ELSE {live[0]} END AS b{state}")
    insert = lambda state, names: (
        f"{{'c': {names}{_AFTER[state]}.c + 5, 'a': 'I' || {names}{_AFTER[state]}.a, "
        f"'r': list_prepend('{_ROLES[int(_AFTER[state])]}:', {names}{_AFTER[state]}.r)}}"
    )
    once = ", ".join(f"list_min([b{q}, {insert(q, 'b')}]) AS w{q}" for q in range(4))
    twice = ", ".join(f"list_min([b{q}, {insert(q, 'w')}]) AS v{q}" for q in range(4))
    return f"""
  SELECT conv_id, pos, {twice} FROM (SELECT *, {once} FROM (
    SELECT p.conv_id, p.pos - 1 AS pos, {', '.join(base)}
    FROM least_cost p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos - 1))"""


_KIND = crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')") + " % 20"

ORACLE = rf"""
WITH RECURSIVE hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_KIND} AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
    coalesce(nullif(strpos('sua', left(role, 1)), 0) * (role <> '')::INT, 0) AS code FROM damaged),
judged AS (
  SELECT *, NOT blank AND NOT dup AS live, NOT blank AND NOT dup AND open AS cut, role || ':' || text AS said FROM (
    SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS open,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS dup,
      lag(code) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM ordered)),
least_cost AS (
  SELECT * FROM (SELECT conv_id, max(pos) + 1 AS pos, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS v0, {{'c': 10, 'a': 'II', 'r': ['user:', 'assistant:']}} AS v1,
    {{'c': 5, 'a': 'I', 'r': ['assistant:']}} AS v2, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS v3 FROM judged GROUP BY conv_id)
  UNION ALL {_sql_steps()}),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (before IS NOT NULL AND NOT (code = 2 AND before IN (1, 3) OR code = 3 AND before = 2)) AS illegal FROM judged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit,
  sha256(coalesce(array_to_string(v0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN least_cost l ON l.conv_id IS NOT DISTINCT FROM o.conv_id AND l.pos = 1"""
