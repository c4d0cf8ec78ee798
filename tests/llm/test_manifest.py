import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import manifest

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    counted = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(*map(counted, (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    """The root, and for every leaf its siblings to the left and right, level by level."""
    paths, level, groups = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, joined = [], []
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for k in range(len(run)):
                for i in groups[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(digest(*run))
            joined.append(sum(groups[at : at + 3], []))
        level, groups = above, joined
    return level[0], paths


def brute(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
    lower = {s: tree([leaf_of(*r) for r in sources[s]]) for s in order}
    root, upper = tree([lower[s][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for row, path in zip(sources[s], lower[s][1], strict=True):
            whole = path + upper[at]
            doc_id, text, *rest = row
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf_of(doc_id, text, *rest)
            for left, right in whole:
                node = digest(left, node, right)
            proof = digest(*[left + right for left, right in whole])
            out.append((doc_id, leaf_of(*row), lower[s][0], root, proof, node, node == root))
    return Counter(out)


def table(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("tree", "n", "number", "node", "path", "about", "block", "members", "levels", "root"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.repartition(4)


ODD = [
    (None, None, None, None, None), (None, "a\nb", "en", None, 3), (1, "", "en", "é", 0), (2, "x\ny", "en", "é", 3), (2, "x\ny", "en", "é", 3),
    (2, "x\nz", "en", "é", None), (3, "\n", None, "", 1), (4, "tail\n" * 50_000, "de", "z", 250_000), (-5, "minus\n", "de", "z", 6),
    (6, "\U0001F600\n é", "fr", "Z", 4),
]


@pytest.mark.parametrize("band", [6, 1, 2])
def test_equal_to_a_plain_tree(spark, monkeypatch, band):
    monkeypatch.setattr(manifest, "BAND", band)
    monkeypatch.setattr(manifest, "BLOCK", 3**band)
    rows = ODD + [(i * 7 % 1000, f"line {i}\nmore", "en", f"s{(i % 11) // 4}", i) for i in range(100)]
    rows += [(i, "hot", "en", "hot", 3) for i in range(244)]
    found = manifest.manifest_table(table(spark, rows))
    assert found.columns == COLUMNS
    assert Counter(map(tuple, found.collect())) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10])
def test_sizes_around_whole_runs(spark, n):
    rows = [(i, f"t{i}\n", "en", "one", 3) for i in range(n)]
    assert Counter(map(tuple, manifest.manifest_table(table(spark, rows)).collect())) == (brute(rows) if n else Counter())


def test_every_change_of_a_field_is_seen(spark):
    rows = [(i, f"t{i}", "en", "s", 3) for i in range(5)]
    proofs = manifest.dataset_proofs(table(spark, rows), F.concat("text", F.lit("!")))
    checked = proofs.select((manifest.fold(F.col("seen_leaf"), F.col("path")) == F.col("root")).alias("ok"))
    assert [r.ok for r in checked.collect()] == [False] * 5


def test_plan_has_no_python_and_no_cross_join(spark):
    plan = manifest.manifest_table(table(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Cartesian", "NestedLoop"))
