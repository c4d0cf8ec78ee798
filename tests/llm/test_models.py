import collections
import math
import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import langid, lm, tokencount, toxicity


def crc(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


# Language -------------------------------------------------------------------------------


def brute_phrases(sample, text):
    """Greedy parse into the longest phrases that occur in the sample."""
    phrases, i = 0, 0
    while i < len(text):
        size = 1
        while i + size <= len(text) and text[i : i + size] in sample:
            size += 1
        i += max(size - 1, 1)
        phrases += 1
    return phrases


@pytest.mark.parametrize("seed", range(4))
def test_parse_equals_brute_force(seed):
    rng = random.Random(seed)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    samples = {x: [" ".join(word(a) for _ in range(60))] for x, a in (("aa", "abcd"), ("bb", "bcde"))}
    model = langid.train(samples)
    texts = [" ".join(word("abcdef") for _ in range(rng.randint(1, 30)))[: langid.PIECE] for _ in range(40)]
    (_, _, sliced) = next(langid.slices(pa.array(texts)))
    counts, lengths = langid.phrase_counts(model, sliced)
    for k, name in enumerate(model.langs):
        for i, text in enumerate(texts):
            # The automaton's parse starts with a phrase open, hence the count of one at least.
            assert counts[k][i] == brute_phrases(samples[name][0], text)
    assert lengths.tolist() == [len(t) for t in texts]


def test_language_table(documents, sample):
    rows = list(sample) + [(9001, None), (9002, ""), (9003, "12 !!"), (9004, "— …"), (9005, "日本"), (9006, sample[0][1] * 300, None, None)]
    rows += [rows[3]]
    got = langid.language_table(documents(rows)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang, *_ in sample}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95
    for r in got:
        assert r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (9001, 9002, 9003, 9004))
    assert by_id[9005].lang_pred != "und" and by_id[9006].lang_pred == truth[sample[0][0]]
    assert langid.language_table(documents([])).collect() == []
    unlabelled = langid.language_table(documents([(1, "some words")])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


# Toxicity -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(1)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randint(5, 200))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["worthless", "idiotic", "disgusting"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark, documents, toxic_rows):
    rows, labels = toxic_rows
    extra = [(900, None), (901, ""), (902, "clean " * 40_000)]
    frame = spark.createDataFrame([*labels, (5, None), (6, 7)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_table(documents(rows + extra), frame).collect()}
    held = [i for i, _ in rows if crc(i, 3) == 1]
    assert all(got[i].held_out == (i in held or crc(i, 3) == 1) for i in got)
    right = sum((got[i].predicted == 1) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.95
    assert got[900].score == got[901].score and got[900].predicted == 0 and got[902].predicted == 0
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())


def test_toxicity_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity_table(documents([(1, "text")]), labels).collect()
    assert len(got) == 1 and got[0].score < 0.01
    assert toxicity.toxicity_table(documents([]), labels).collect() == []


def test_windows_hold_all_words():
    texts = ["One two\tthree\n" * 30, "", "x" * 500, " a "]
    (_, _, sliced) = next(toxicity.slices(pa.array(texts)))
    for text, windows in zip(texts, toxicity._windows(sliced), strict=True):
        assert b" ".join(windows).split() == text.lower().encode().split()


# Language model -------------------------------------------------------------------------


def brute_base(rows):
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    counts = collections.Counter(w for i, ws in tokens if crc(i, 10) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    below = math.log10(total + 0.1 * (distinct + 1))
    return total, [
        (i, len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10(counts[w] + 0.1) - below for w in ws))
        for i, ws in tokens
    ]


def check_scores(documents, rows):
    got = lm.score_documents(documents(rows)).collect()
    total, want = brute_base(rows)
    key = lambda r: tuple((x is None, x or 0) for x in r[:3])
    got = sorted(got, key=lambda r: key((r.doc_id, r.n_tokens, r.n_known)))
    assert len(got) == len(want)
    for r, w in zip(got, sorted(want, key=key), strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (*w[:3], total)
        assert r.base_score == pytest.approx(w[3], rel=1e-9, abs=1e-9)
        assert r.held_out == (crc(r.doc_id, 10) == 0) and r.score < 0 and math.isfinite(r.score)
    return got


def test_base_scores_equal_brute_force(documents, sample):
    rows = [(i, t) for i, t, *_ in sample] + [(5000, None), (5001, ""), (5002, "x" * 40_000), (None, "The the"), (1, "again\nagain")]
    got = check_scores(documents, rows)
    # Held-out text costs fewer bits a byte than its letters' frequencies would.
    size = {i: len((t or "").encode()) for i, t in rows}
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    bits = -math.log2(10) * sum(r.score for r in held) / sum(size[r.doc_id] for r in held)
    assert bits < 3.5


def test_scores_without_training_and_of_nothing(documents):
    held = next(i for i in range(1000) if crc(i, 10) == 0)
    check_scores(documents, [(held, "only a held out text")])
    assert lm.score_documents(documents([])).collect() == []


def test_weights_and_code_come_from_all_training_texts(documents, sample, monkeypatch):
    rows = [(i, t) for i, t, *_ in sample] + [(None, "no id"), (7001, None), (7001, "x")]
    monkeypatch.setattr(lm, "LEARN_BYTES", 1000, raising=False)  # a sample of that size, before
    learned, seen, train_mixer, shortest_code = [], [], lm._train_mixer, lm.shortest_code
    monkeypatch.setattr(lm, "_train_mixer", lambda texts, t: learned.append(texts.select("text").collect()) or train_mixer(texts, t))
    monkeypatch.setattr(lm, "shortest_code", lambda n: seen.append(n) or shortest_code(n))
    lm.score_documents(documents(rows)).collect()
    texts = [t or "" for i, t in rows if crc(i, 10)]
    assert sorted(r.text or "" for r in learned[0]) == sorted(texts)
    counts = collections.Counter(b for t in texts for b in t.encode().lower())
    counts[lm.END] = len(texts)
    assert {b: n for b, n in enumerate(seen[0].tolist()) if n} == dict(counts)


def test_steps_go_the_way_of_the_gradient():
    rng = np.random.default_rng(3)
    odds = rng.normal(size=(lm.ORDERS, 500)).astype(np.float32)
    odds[rng.random(odds.shape) < 0.4] = 0
    value = rng.integers(0, 2, 500)
    for bit in (2, lm.PLACES + 1):
        mixer, first = lm.Mixer(), lm.Mixer()
        mixer.learn(odds, bit, value, True)
        place = min(bit, lm.PLACES - 1)
        for known in range(lm.ORDERS + 1):
            gate = known * lm.PLACES + place
            own = (odds != 0).sum(axis=0) == known
            sums = first.weights[gate] @ odds[:, own]
            step = (odds[:, own] * (value[own] - 1 / (1 + np.exp(-sums)))).sum(axis=1) / max(1, own.sum())
            assert np.allclose(mixer.weights[gate], first.weights[gate] + (lm.RATE + 0.5) * step, atol=1e-5)
            cell = first.bucket(sums)
            assert (mixer.map_all[gate] - first.map_all[gate] == np.bincount(cell, minlength=lm.BUCKETS)).all()
            assert np.allclose(mixer.map_ones[gate] - first.map_ones[gate], np.bincount(cell, value[own], lm.BUCKETS))
            assert mixer.steps[gate] == own.any()
        assert mixer.steps.sum() == (mixer.map_all.sum(axis=1) > lm.BUCKETS).sum()


def test_small_blocks_give_the_same_counts(documents, sample, monkeypatch):
    rows = [(i, t) for i, t, *_ in sample][:40]
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 1)
    check_scores(documents, rows)


def test_spelling_is_a_distribution():
    words = pa.array([b"aba", b"abba", b"b", b"baab"], pa.binary())
    ones, zeros = np.zeros(lm.SLOTS, np.float32), np.zeros(lm.SLOTS, np.float32)
    lm.count_bits(words, ones, zeros)
    mixer = lm.Mixer()
    lm.learn_weights(words, ones, zeros, mixer)
    single = pa.array([bytes([b]) for b in range(256)], pa.binary())
    first = np.zeros(256)
    for symbols, starts, contexts in lm._chunks(single):
        for bit, value, slots in lm._bits(symbols, contexts):
            logs = mixer.log_probability(lm._log_odds(ones, zeros)[slots], bit, value)
            first += logs[starts[:-1]]
    assert (10**first).sum() == pytest.approx(1, rel=1e-4)
    seen, unseen = lm.spell(pa.array([b"abba", b"zqxj"], pa.binary()), lm._log_odds(ones, zeros), mixer)
    assert seen > unseen


def test_gate_follows_the_text():
    words, repeated = [-30.0] * 10, 0.2
    known, new = [-4.0] * 10, [-301.0] * 10
    assert lm.mixed_lines(words, known, repeated) > -60
    assert lm.mixed_lines(words, new, repeated) == pytest.approx(-300, abs=2)
    assert lm.mixed_lines(words, known, 0.0) == -300


def test_words_are_predicted_from_the_words_before(documents):
    pairs = [("apple", "river"), ("stone", "candle"), ("window", "garden"), ("copper", "violin")]
    picks = np.random.default_rng(5).integers(0, 4, (300, 12))
    train = [i for i in range(1000) if crc(i, 10)][:300]
    held = [i for i in range(1000) if not crc(i, 10)][:2]
    rows = [(i, " ".join(w for p in pick for w in pairs[p])) for i, pick in zip(train, picks, strict=True)]
    order = [0, 2, 1, 3, 3, 0]
    rows.append((held[0], " ".join(w for p in order for w in pairs[p])))
    rows.append((held[1], " ".join(w for p in order for w in pairs[p][::-1])))
    got = {r.doc_id: r for r in check_scores(documents, rows)}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 6


def test_pieces_of_a_text_score_as_the_whole(sample, monkeypatch):
    texts = pa.array([(t or "").lower() for _, t, *_ in sample[:30]] + ["", "a \n b" * 100])
    (_, _, sliced) = next(lm.slices(texts))
    counts = np.zeros(2 * lm.SLOTS, np.uint32)
    lm.count_texts(sliced, counts)
    zeros, ones = np.split(counts, 2)
    tables, train = lm.Tables(lm.rounded_odds(ones, zeros), lm.TABLE_BITS), np.arange(len(texts)) % 2
    whole = lm.score_texts(sliced, train, tables, lm.Mixer())
    in_parts = np.zeros_like(counts)
    monkeypatch.setattr(lm, "PIECE", 257)
    assert lm.score_texts(sliced, train, tables, lm.Mixer()) == pytest.approx(whole, rel=1e-9)
    lm.count_texts(sliced, in_parts)
    assert (in_parts == counts).all()


def coded_tables(rows):
    """Texts of rows, and tables of them by the bytes' own code."""
    (_, _, texts) = next(lm.slices(pa.array([(t or "").lower() for _, t, *_ in rows]), 1 << 40))
    code = lm.shortest_code(np.bincount(texts.data, minlength=256))
    counts = np.zeros(2 * lm.SLOTS, np.uint32)
    lm.count_texts(texts, counts, lm.TABLE_BITS, code)
    zeros, ones = np.split(counts, 2)
    return texts, lm.Tables(lm.rounded_odds(ones, zeros), lm.TABLE_BITS, code)


def test_bits_of_a_short_code_are_predicted(sample, monkeypatch):
    texts, tables = coded_tables(sample[:60])
    assert sum(2.0 ** -int(n) for n in tables.code.lengths) == 1
    predicted, probability = [], lm.Mixer.probability

    def counted(self, odds, bit, value):
        predicted.append(len(value))
        return probability(self, odds, bit, value)

    monkeypatch.setattr(lm.Mixer, "probability", counted)
    scores = lm.score_texts(texts, np.ones(len(texts), np.int64), tables, lm.Mixer())
    assert np.isfinite(scores).all() and (scores < 0).all()
    assert sum(predicted) < 6 * len(texts.data)


def test_coded_bytes_are_a_distribution(sample):
    _, tables = coded_tables(sample[:20])
    mixer, every = lm.Mixer(), np.arange(256, dtype=np.uint8)
    for text in (b"a", b"the ", b"zq"):
        (_, symbols, _, contexts), = lm._runs(lm._whole(pa.array([text], pa.binary())))
        near = np.repeat(contexts[:, -1:], 256, axis=1)
        total = 0.0
        for _, part, own in lm._steps(every, near, 256, tables.code):
            product = np.ones(256)
            for bit, value, odds in lm._odds(part, own, tables):
                product[: len(value)] *= mixer.probability(odds, bit, value)
            total += product.sum()
        assert symbols[-1] == lm.END and total == pytest.approx(1, rel=1e-4)


def test_tables_of_little_text_take_little_room(sample):
    _, tables = coded_tables(sample[:20])
    packed = pickle.dumps(tables)
    assert len(packed) < len(tables.odds) / 10
    again = pickle.loads(packed)
    assert (again.odds == tables.odds).all() and again.bits == tables.bits


def test_small_counts_are_kept_whole():
    ones, zeros = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(3)))
    odds = lambda a, b: np.log((np.maximum(a, 0) + lm.PRIOR) / (np.maximum(b, 0) + lm.PRIOR))
    for a, b, sign in ((ones, zeros, 1), (zeros, ones, -1)):
        whole, no_zero, no_one = lm._STATE_ODDS.reshape(3, 256)[:, lm.rounded_odds(a, b)]
        assert whole == pytest.approx(sign * odds(ones, zeros), abs=1e-5)
        seen, not_seen = (no_one, no_zero) if sign == 1 else (no_zero, no_one)
        assert seen[ones > 0] == pytest.approx(sign * odds(ones - 1, zeros)[ones > 0], abs=1e-5)
        assert not_seen[zeros > 0] == pytest.approx(sign * odds(ones, zeros - 1)[zeros > 0], abs=1e-5)


def test_many_symbols_are_counted_in_parts(sample, monkeypatch):
    (_, _, texts) = next(lm.slices(pa.array([t for _, t, *_ in sample[:30]]), 1 << 40))
    whole, in_parts = np.zeros(2 * lm.SLOTS, np.uint32), np.zeros(2 * lm.SLOTS, np.uint32)
    lm.count_texts(texts.lower(), whole)
    monkeypatch.setattr(lm, "PIECE", 5000)
    monkeypatch.setattr(lm, "COUNT_SYMBOLS", 9000)
    lm.count_texts(texts.lower(), in_parts)
    assert (whole == in_parts).all()


# Token counts ---------------------------------------------------------------------------

STRANGE = [
    "", "  ", "Hello <|endoftext|> world<|startoftext|>", "ΟΔΥΣΣΕΥΣ ΣΑΣ ς", "I'll don't we've İ ½ ² Ⅷ 123 ４５",
    "áé café", "日本語テキスト です。", "x" * 5000, "ab" * 3000, "\U0001F642\U0001F642", "\x1c a\x85b c​d",
    "it's 'S 'T ''s '''re", "aaaa" * 7 + " bananabanana", "<|endoftext|", "﻿abc ퟿",
]


def test_counts_equal_the_library(documents, sample):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = list(enumerate([*STRANGE, *[t for _, t, *_ in sample], None, "word " * 3000])) + [(0, "twice")]
    want = library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    got = tokencount.count_tokens(documents(rows), path).collect()
    expected = sorted((i, len((t or "").encode()), len(e.ids), len(e.ids) > 2048) for (i, t), e in zip(rows, want, strict=True))
    assert sorted(map(tuple, got)) == expected
    assert tokencount.count_tokens(documents([]), path).collect() == []


def test_a_small_memory_gives_the_same_counts():
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    texts = [f"first{i} second{i} common" for i in range(50)]
    small, large = tokencount.Counter(path, cache_words=7), tokencount.Counter(path)
    assert [small.count([t])[0] for t in texts] == large.count(texts)
