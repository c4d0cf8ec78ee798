import itertools
import random

import numpy as np
import pyarrow as pa

from lectern.llm import ngramjoin as N
from lectern.llm.components import components

FILLER = " ".join(f"w{i}" for i in range(400))


def brute(rows, width=4, percent=85):
    """Component and set size of every id, by comparing all pairs."""
    sets: dict = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        grams = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
        if words and not grams:
            grams = {tuple(words)}
        sets.setdefault(i, []).append(grams)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, xs), (j, ys) in itertools.combinations(sets.items(), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in xs for y in ys):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: root(i) for i in sets}, {i: sorted(map(len, s)) for i, s in sets.items()}


def compare(documents, rows, **kw):
    got = N.similarity_components(documents(rows), **kw).collect()
    want, sizes = brute([r for r in rows if r[0] is not None], **kw)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    for i, n in sizes.items():
        assert sorted(r.n_shingles for r in got if r.doc_id == i) == n
    return got


def test_edges_and_ties(documents):
    text = FILLER[:300]
    got = compare(
        documents,
        [(5, text), (3, text.upper()), (9, text + " more"), (1, None), (2, ""), (4, " \n\t "),
         (6, "one two"), (7, "One  TWO"), (8, "two one"), (8, "two one"), (None, text),
         (10, "x " * 30_000), (11, "x " * 30_001), (12, "Été été a b"), (13, "été été a b")],
    )
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_rows_of_one_id_are_one_node(documents):
    a, b = "a b c d e f g h", "p q r s t u v w"
    compare(documents, [(1, a), (2, a), (2, b), (3, b)])


def test_chains_near_the_threshold(documents):
    rng = random.Random(3)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    compare(documents, rows)
    compare(documents, rows, width=5, percent=80)


def test_shared_passages_and_hot_copies(documents):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"u{rng.randrange(3000)}" for _ in range(rng.randint(3, 40))))
            for i in range(150)]
    rows += [(1000 + i, FILLER[:500]) for i in range(120)]
    compare(documents, rows)


def test_sample_equals_brute_force(documents, sample):
    compare(documents, [(i, t) for i, t, *_ in sample])


def test_empty_table(documents):
    assert N.similarity_components(documents([])).collect() == []


def test_blocks_only_skip_what_cannot_link():
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(5, 60, 300)).astype(np.int32)
    pos = (rng.random(300) * n * 0.2).astype(np.int32)
    group = rng.integers(0, 250, 300)
    found = set()
    maps = np.zeros((N.MAP_WORDS, 300), dtype=np.uint64)
    for i, j in N.list_pairs(n, pos, group, maps, 85):
        found |= set(zip(i.tolist(), j.tolist()))
    for i, j in itertools.combinations(range(300), 2):
        room = min(pos[i], pos[j]) + min(n[i] - pos[i], n[j] - pos[j])
        ok = group[i] != group[j] and 185 * room >= 85 * (int(n[i]) + int(n[j]))
        assert ((i, j) in found) == ok


def test_parity_maps_never_differ_more_than_sets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 1 << 62, 120).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: rng.integers(120)], b[: rng.integers(1, 60)]]))
        x, y = (np.array(N.parity_map(s)).view(np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(100, 160)] + [(7, 7), (3, 1)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 3: 1}


def test_links_equal_brute_force(documents, sample):
    rng = random.Random(11)
    base = [f"v{i}" for i in range(120)]
    rows = [(i, t) for i, t, *_ in sample]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, FILLER[:300]), (20_001, FILLER[:300].upper()), (20_001, FILLER[:300] + " more"), (20_002, None), (None, " ".join(base))]
    members, links = N.similarity_links(documents(rows))
    got, pairs = members.collect(), links.collect()
    shingles = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        grams = frozenset(tuple(words[k : k + 4]) for k in range(len(words) - 3)) or frozenset([tuple(words)] if words else [])
        if i is not None and grams:
            key = next(iter(N.text_sets(pa.array([text]), 4)))
            shingles[grams] = N.class_of(key)
    want = sorted(
        tuple(sorted((shingles[x], shingles[y])))
        for x, y in itertools.combinations(shingles, 2)
        if 100 * len(x & y) >= 85 * len(x | y)
    )
    assert sorted((r.a, r.b) for r in pairs) == want
    hubs = [p for p in want if all(any(r.class_id == c and (r.doc_id or 0) >= 10_000 for r in got) for c in p)]
    assert len(hubs) > 150
    assert len(got) == len(rows)
    assert all((r.class_id is None) == (r.doc_id is None or r.n_shingles == 0) for r in got)
    counted = N.link_counts(documents(rows)).collect()
    both = [c for p in want for c in p]
    assert len(counted) == len(rows)
    assert all(r.n_links == both.count(r.class_id) for r in counted)
    named = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in counted), key=str)
    plain = N.similarity_components(documents(rows)).collect()
    assert named == sorted(((r.doc_id, r.n_shingles, r.component_id) for r in plain), key=str)


def test_shingles_are_counted_in_groups_of_bounded_text(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    shared = " ".join(rng.choices(words, k=40))
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 300))) + " " + shared * (i % 2)) for i in range(60)]
    docs = spark.createDataFrame(rows + [(60, None), (61, "")], "doc_id long, text string")
    seen = []
    levels = N._levels

    def counted(pieces):
        sizes = {}
        for r in pieces.collect():
            sizes[r.range] = sizes.get(r.range, 0) + len(N.unpacked(bytes(r.hashes)))
        seen.append((sizes, levels(pieces)))
        return seen[-1][1]

    monkeypatch.setattr(N, "_levels", counted)
    whole = sorted(N.similarity_components(docs).collect())
    monkeypatch.setattr(N, "GROUP_BYTES", 100)
    assert sorted(N.similarity_components(docs).collect()) == whole
    (few, one), (many, two) = seen
    assert sum(few.values()) == sum(many.values()) and len(few) <= 16
    assert max(many.values()) < max(few.values()) / 8  # a common shingle stays together
    assert one.any() and (one == two).all()


def test_levels_of_few_shingles(spark):
    for n in (0, 1, 6, 7, 8, 9):
        rows = [(0, N.packed(np.full(n, 5, np.uint32))), (1, N.packed(np.arange(3, dtype=np.uint32)))]
        table = N._levels(spark.createDataFrame(rows, "range int, hashes binary"))
        assert table.sum() == table[5] == (3 if n >= 8 else 0)
