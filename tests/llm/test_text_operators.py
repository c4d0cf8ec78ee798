import hashlib
import re

import pyarrow as pa
import pytest

from lectern.llm import decontaminate as D
from lectern.llm import linededup as L
from lectern.llm import pii as P

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, window=10):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    hit, found = set(), set()
    for name, item in items:
        own = WORD.findall((item or "").translate(ASCII_LOWER))
        k = min(window, len(own))
        grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1 if own else 0):
            if tuple(words[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(str(name))
    return len(words), len(hit), found


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "kappa lambda"), (3, ""), (4, None), (5, "café-au-lait"), (10, "beta gamma delta"),
    (10, "rho sigma"), (6, "a " * 14), (7, "Kappa, Lambda!"), (None, "no name here"),
]
DOCS = [
    (1, "x alpha beta gamma delta epsilon zeta eta theta iota kappa y"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (3, None), (4, ""), (5, "... — ..."), (6, "CAFÉ café au lait kappa\tlambda"),
    (7, "a " * 30_000), (8, "rho sigma beta gamma delta"), (8, "rho sigma beta gamma delta"),
    (9, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu alpha beta"), (None, "kappa lambda"),
]


def check_contamination(spark, documents, rows, items):
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(documents(rows), frame).collect()
    want = []
    for i, text in rows:
        n, hit, found = brute_hits(text, [x for x in items if x[0] is not None])
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((i, n, hit, len(found), digest, hit > 0))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_contamination_equals_brute_force(spark, documents, sample):
    check_contamination(spark, documents, DOCS, ITEMS)
    check_contamination(spark, documents, DOCS, [])
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    check_contamination(spark, documents, [(i, t) for i, t, *_ in sample], [tuple(r) for r in items])
    assert D.contamination(documents([]), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_parts_of_a_benchmark_add_up(spark, documents):
    items = spark.createDataFrame([x for x in ITEMS if x[0]], "item_id long, text string")
    docs = documents(DOCS).select("doc_id", "text")
    whole = D.tag_items(docs, items).collect()
    parts = D.tag_items(docs, items, max_words=3).collect()
    strip = lambda rows: sorted(str((r.doc_id, r.n_words, [(s.first, s.last) for s in r.spans], r["items"])) for r in rows)
    assert strip(whole) == strip(parts)


def test_spans_are_cut_and_mostly_hit_documents_go(spark, documents):
    item = " ".join(f"q{i}" for i in range(12))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = " ".join(f"c{i}" for i in range(40))
    rows = [(1, f"{clean}, {item.upper()}! endé"), (2, item), (3, clean), (4, None), (5, "")]
    got = {r.doc_id: r.text for r in D.remove_items(documents(rows), items).collect()}
    assert got == {1: f"{clean}, ! endé", 3: clean, 4: None, 5: ""}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def brute_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return [(s, e, P.BASE_KINDS[k]) for s, k, e in sorted(found)]


PII = [
    "a@b.c@d.e x@y a.b@c-d.e.f..g@h.i %@x.y @ a@ @b.c", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 1", "+1 (650) 253-0000 +44 20 7946 0958. +12 ++123456789012",
    "éé mail \U0001F600 me@x.org", "", "9" * 5000, "a" * 5000 + "@" + "b" * 5000, "1 " * 3000, "١٢٣ 1",
]


@pytest.mark.parametrize("text", PII)
def test_base_spans_equal_the_plain_patterns(text):
    assert P.base_spans(text) == brute_pii(text)


def test_pii_table(spark, documents, sample):
    rows = [(i, t) for i, t in enumerate([*PII, None, *[t for _, t, *_ in sample]])] + [(0, PII[0])]
    got = P.pii_digest(documents(rows)).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        base = brute_pii(by_id[r.doc_id] or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in base) for x in P.BASE_KINDS]
        assert set(filter(None, joined.split(","))) <= set(filter(None, r.spans.split(",")))
    assert P.pii_digest(documents([])).collect() == []


def test_checksums_and_context_add_spans():
    kinds = lambda text: [k for *_, k, _ in P.all_spans(text)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 here") == ["iban"]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 33 here") == []
    assert kinds("call me: phone (555) 123-4567") == ["phone_national"]
    assert kinds("lot (555) 123-4567") == []
    assert kinds("SSN 123-45-6789") == ["ssn"]
    score = {k: s for *_, k, s in P.all_spans("card 4111 1111 1111 1111")}
    assert score["card"] > P.all_spans("build 4111 1111 1111 1111")[0][3]


def test_accounts_before_upper_case_words():
    account = "GB82 WEST 1234 5698 7654 32"
    for text in (f"IBAN {account} BIC NWBKGB2L", f"IBAN {account} PLEASE PAY", f"PAY AB12 IBAN {account}",
                 f"IBAN AB12 CODES FOR {account} BIC", f"IBAN {account} {account} BIC", f"IBAN {account}"):
        found = [text[s:e] for s, e, kind, _ in P.all_spans(text) if kind == "iban"]
        assert found == [account] * text.count(account)
    assert list(P._ibans("IBAN GB82 WEST 1234 5698 7654 33 BIC NWBKGB2L")) == []


def test_long_texts_stay_linear():
    assert P.all_spans("1." * 200_000 + "x") is not None
    assert P.base_spans("a." * 200_000) == []


def brute_lines(rows, min_sites=L.MIN_SITES, min_chars=L.MIN_CHARS):
    places: dict = {}
    blank = " \t\n\v\f\r"
    for i, text, _, source in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if len(line.strip(blank)) >= min_chars:
                places.setdefault(line.strip(blank), []).append((i, pos, source))
    drop = {(i, pos) for p in places.values() if len({s for *_, s in p}) >= min_sites
            for i, pos, _ in sorted(p, key=lambda x: x[:2])[1:]}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in drop)
            for i, t, *_ in rows}


def test_lines_equal_brute_force(documents, sample):
    line, other = "All rights are reserved here.", "Another line of some length."
    rows = [(i, f"own text number {i}\n {line}\t\nshort\n{line}", "en", f"s{i % 7}") for i in range(20)]
    rows += [(30 + i, f"{other}\ntail {i}", "en", f"s{i % 4}") for i in range(20)]
    rows += [(60, None, "en", "s1"), (61, "", "en", None), (62, line, None, None), (63, "\n" * 5000, "en", "s2")]
    got = {r.doc_id: r.text for r in L.remove_boilerplate(documents(rows)).collect()}
    assert got == brute_lines(rows)
    got = {r.doc_id: r.text for r in L.remove_boilerplate(documents(sample)).collect()}
    assert got == brute_lines(sample)
    assert L.line_table(documents([])).collect() == []


def test_equal_rows_lose_the_same_lines(documents):
    line = "This line stands everywhere."
    rows = [(i // 2, line + f"\nown {i // 2}", "en", f"s{i // 2}") for i in range(16)]
    got = L.remove_boilerplate(documents(rows)).collect()
    assert len(got) == 16
    assert sum(line in r.text for r in got) == 2  # both rows of the first document


def test_near_threshold_lines_are_counted_exactly(documents):
    rows = [(i, f"exactly four sites have this\n{i}", "en", f"s{i % 4}") for i in range(12)]
    rows += [(50 + i, f"exactly five sites have this\n{i}", "en", f"s{i % 5}") for i in range(12)]
    got = {r.doc_id: r.n_removed for r in L.remove_boilerplate(documents(rows)).collect()}
    assert sum(got[i] for i in range(12)) == 0 and sum(got[50 + i] for i in range(12)) == 11


def test_slices_cover_long_and_null_texts():
    from lectern.llm.textkit import slices

    column = pa.array(["a" * 3_000_000, None, "", "b"])
    got = [(low, high) for low, high, _ in slices(column)]
    assert got[0] == (0, 1) and got[-1][1] == 4 and [a for a, _ in got[1:]] == [b for _, b in got[:-1]]
