import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import turnrepair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, audit) over all edits, by a search of paths in order of cost and audit."""
    n, seen = len(rows), set()
    heap = [(0, "", 0, "", ())]  # cost, audit, row, state, turns
    while heap:
        cost, audit, i, state, said = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == n and state in ("", "a"):
            return cost, audit, said
        goes = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for role in ("user", "assistant"):
            if role[0] in goes:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*said, f"{role}:")))
        if i < n:
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, said))
            if fault in ("blank", "duplicate"):
                continue
            late = 5 if fault else 0
            if role and role[0] in goes:
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[0], (*said, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if new[0] in goes:
                    heapq.heappush(heap, (cost + late + 1, audit + "R", i + 1, new[0], (*said, f"{new}:{text}")))
    raise AssertionError


def brute(rows, damaged):
    out = []
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, judged, faults = set(), [], Counter()
        for _, _, role, text in own:
            visible = VISIBLE.findall(text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            judged.append((role, text, fault))
        pairs = [(a[0][:1] + b[0][:1]) for a, b in zip(judged, judged[1:], strict=False)]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        cost, audit, said = cheapest(judged)
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return Counter(out)


def table(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("seq", "kinds", "mark", "code", "blank", "cost"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.repartition(5)


def made(seed, conversations, turns):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, turns)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "umpire"])
            text = rng.choice(["yes.", "no", "so?", "", " \n", "well!", f"t{rng.randint(0, 9)}."])
            rows.append((conv, turn, role, text))
    return rows


ODD = [
    (None, None, None, None), (None, None, "user", "a."), (None, 3, "user", "b."), (7, None, "user", "x."), (7, None, "user", "x."),
    (7, 1, "assistant", None), (7, 1, "assistant", "y. "), (7, 9, "system", "z" * 300_000), (8, 2, "", "q."), (8, 2, "", "q."), (9, None, None, ""),
] + [(100 + i, 0, "user", "only.") for i in range(60)]


def check(spark, rows):
    found = turnrepair.repair_table(turnrepair.damage(table(spark, rows)))
    assert found.columns == COLUMNS
    assert Counter(map(tuple, found.collect())) == brute(rows, brute_damage(rows))


def test_odd_rows_equal_brute_force(spark):
    check(spark, ODD)


def test_random_conversations_equal_brute_force(spark):
    check(spark, made(1, 400, 7) + made(2, 40, 25))


@pytest.mark.parametrize("rows", [1, 2, 7])
def test_conversations_over_many_segments(spark, monkeypatch, rows):
    monkeypatch.setattr(turnrepair, "SEGMENT_ROWS", rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        check(spark, made(3, 30, 60))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_conversation_with_equal_rows(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["a.", f"{t}.", f"{t}"])) for t in range(3000)]
    rows += [(1, 5, "user", "same.")] * 500 + [(2, t, "user", "again.") for t in range(400)]
    check(spark, rows)


def test_repaired_turns_read_as_they_should(spark):
    rows = made(4, 60, 9)
    turns = turnrepair.repaired_turns(table(spark, rows)).orderBy("conv_id", "place").collect()
    said, shapes = {}, {}
    for t in turns:
        said.setdefault(t.conv_id, []).append(f"{t.role}:{t.text}")
        shapes[t.conv_id] = shapes.get(t.conv_id, "") + t.role[0]
    assert all(re.fullmatch("s?(ua)+", shape) for shape in shapes.values())
    digests = {r.conv_id: r.repaired_sha256 for r in turnrepair.repair_table(table(spark, rows)).collect()}
    for conv, digest in digests.items():
        assert digest == hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest()


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turnrepair.repair_table(turnrepair.damage(empty)).collect() == []
    assert turnrepair.repaired_turns(empty).collect() == []
