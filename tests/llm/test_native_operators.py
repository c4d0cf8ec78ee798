import collections
import re

import pytest

from lectern.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside),
            n < 50 or 100 * len(inside) > 50 * n)


ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a b c a b c a b c"), (5, "a a a a a"), (6, "x\ny\nx\n\n\nx "), (7, "one\x0btwo\x0cthree\x1cfour"),
    (8, "w " * 20_000), (9, " ".join(f"w{i}" for i in range(20_000))), (10, "#*$%&|<> é è \U0001F600"), (11, "a b c d a b c d a b c e"),
    (11, "a b c d a b c d a b c e"), (None, "a b c\na b c"),
]


def test_counts_equal_brute_force(documents, sample):
    rows = ROWS + [(100 + i, t, lang, source) for i, t, lang, source in sample]
    got = quality.quality_rules(documents(rows)).collect()
    shown = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got)
    assert shown == sorted(str((r[0], *brute_quality(r[1]))) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality_rules(documents([])).collect() == []


def test_outliers_of_a_group_go_and_ordinary_documents_stay(documents):
    ordinary = [(i, " ".join(f"word{(i * 7 + k) % 500}" for k in range(60 + i % 9)), "en", "s") for i in range(200)]
    symbols = [(500, " ".join(f"w{k}###" for k in range(80)), "en", "s")]
    long_words = [(501, " ".join("x" * 40 + str(k) for k in range(80)), "en", "s")]
    got = {r.doc_id: r.kept for r in quality.quality_rules(documents(ordinary + symbols + long_words)).collect()}
    assert all(got[i] for i in range(200)) and not got[500] and not got[501]


def test_quality_plan_has_no_python(documents):
    plan = quality.quality_rules(documents(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def water_fill(sizes, weights, most=3):
    """Targets by sharing again until no source is above its limit."""
    targets, open_ = {}, dict(weights)
    left = float(sum(sizes.values()))
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > most * sizes[s] * (1 + 1e-12)]
        if not full:
            return targets | {s: level * w for s, w in open_.items()}
        for s in full:
            targets[s] = most * sizes[s]
            left -= targets[s]
            del open_[s]
    return targets


def check_mix(documents, rows):
    got = mixing.mix_sources(documents(rows), keep=("source",)).collect()
    assert len(got) == len(rows)
    sizes: dict = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    targets = water_fill(sizes, weights)
    largest, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.copies <= 3
        largest[r.source] = max(largest[r.source], r.size)
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] + 1e-6, s
    again = mixing.mix_sources(documents(rows[::-1]), keep=("source",)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    return got


def test_mix_meets_its_targets(documents, sample):
    check_mix(documents, sample)
    rows = [(i, "w " * (1 + i % 17), "en", "abcdefg"[min(i % 13, 6)] if i % 11 else None) for i in range(900)]
    check_mix(documents, rows)
    check_mix(documents, [(1, "tiny", "en", "a"), (2, "x " * 5000, "en", "b"), (3, None, "en", "c"), (4, "", "en", "é"), (5, "y z", "en", "Z")])


def test_mix_edges(documents):
    assert mixing.mix_sources(documents([])).collect() == []
    got = mixing.mix_sources(documents([(1, None, None, None), (2, "", None, "a")])).collect()
    assert [r.copies * r.size for r in got] == [0, 0]
    twice = mixing.mix_sources(documents([(7, "a b c", "en", "s")] * 6 + [(8, "d " * 30, "en", "t")])).collect()
    # Equal rows are drawn one by one, so that the words taken come near the target of 16.
    assert abs(sum(r.copies * r.size for r in twice if r.doc_id == 7) - 16) <= 3


def test_slices_do_not_change_the_sample(documents, sample):
    one = mixing.mix_sources(documents(sample), slice_rows=3).collect()
    two = mixing.mix_sources(documents(sample), slice_rows=10**6).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_mixing_plan_has_no_python(documents):
    plan = mixing.mix_sources(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pareto_sample_is_fair(documents):
    """Every document of an even source is taken about as often as its inclusion probability."""
    rows = [(i, "w", "en", "b" if i % 2 else "a") for i in range(3000)]
    got = mixing.mix_sources(documents(rows), keep=("source",)).collect()
    taken = collections.Counter((r.source, r.doc_id < 1500) for r in got if r.copies >= 1)
    # Source a has a third of all words and half of the documents: two thirds of it are taken.
    assert abs(taken["a", True] - taken["a", False]) < 120
    assert taken["a", True] + taken["a", False] == 1000


def test_longer_documents_are_likelier_in_the_sample(documents):
    """Each size class is taken as often as its inclusion probability, which grows with the length."""
    rows = [(i, "w " * (4, 16, 64)[i % 3], "en", "b" if i % 2 else "a") for i in range(6000)]
    got = mixing.mix_sources(documents(rows), keep=("source",)).collect()
    a = [r for r in got if r.source == "a"]
    room = a[0].target
    assert sum(r.inclusion * r.size for r in a) == pytest.approx(room, rel=1e-9)
    chance = {size: {r.inclusion for r in a if r.size == size} for size in (4, 16, 64)}
    assert all(len(c) == 1 for c in chance.values())
    odds = [p / (1 - p) for p in (chance[4].pop(), chance[16].pop(), chance[64].pop())]
    assert odds[1] / odds[0] == pytest.approx(2) and odds[2] / odds[1] == pytest.approx(2)
    for size, o in zip((4, 16, 64), odds, strict=True):
        p, own = o / (1 + o), [r.copies for r in a if r.size == size]
        assert abs(sum(own) - p * len(own)) < 4 * (p * (1 - p) * len(own)) ** 0.5


def test_a_document_larger_than_the_room_is_not_in_the_way(documents):
    rows = [(1, "w " * 100_000, None, "a"), *[(i, "w " * 10, None, "a") for i in range(2, 1002)]]
    rows += [(5000 + i, "w " * 10, None, "b") for i in range(320)]
    got = [r for r in mixing.mix_sources(documents(rows), keep=("source",)).collect() if r.source == "b"]
    assert abs(sum(r.copies * r.size for r in got) - got[0].target) <= 10
    small = [(1, "w " * 100_000, None, "a"), *[(i, "w " * 10, None, "a") for i in range(2, 1002)], (2000, "w " * 20_000, None, "b")]
    got = [r for r in mixing.mix_sources(documents(small), keep=("source",)).collect() if r.source == "a"]
    assert got[0].target < 110_000 and all(r.copies == 0 or r.size <= 2 * got[0].target for r in got)


def test_equal_rows_are_drawn_one_by_one(documents):
    rows = [(1, "ten words " * 5, None, "a")] * 400 + [(i, "ten words " * 5, None, "b") for i in range(1000, 1500)]
    docs = documents(rows)
    runs = []
    for parts in (3, 7):
        mixed = mixing.mix_sources(docs.repartition(parts)).collect()
        assert len(mixed) == 900
        sources = {r.source_size: (r.target, 0) for r in mixed}
        for r in mixed:
            target, taken = sources[r.source_size]
            sources[r.source_size] = (target, taken + r.copies * r.size)
        assert all(abs(taken - target) <= 20 for target, taken in sources.values())
        runs.append(sorted((r.doc_id, r.copies) for r in mixed))
    assert runs[0] == runs[1]
