"""Suffix-array dedup against all windows in a dictionary."""

import random

import pytest

from tests.llm import plain
from vantry.llm import suffix_dedup as S


def fixture():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(n) for n in (8, 12, 20, 40, 9)]
    docs = []
    for k in range(120):
        t = text(rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            t += " " + rng.choice(passages) + " " + text(rng.randint(0, 15))
        docs.append((k, t))
    docs += [(200, docs[3][1]), (201, docs[3][1]), (202, "a" * 500), (203, ""), (204, "ab" * 100), (205, docs[5][1][:-3]), (206, None)]
    run = "Is onhe. " * 40
    docs += [(300 + k, text(9) + run + text(7) + run[: 50 + k]) for k in range(4)]
    return docs


@pytest.mark.parametrize("hot", [S.HOT, 4])
def test_against_all_windows(spark, hot):
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup(df, span=40, hot=hot).collect()}
    want = plain.repeats(docs, 40)
    assert got == {d: w[:4] for d, w in want.items()}
    assert sum(w[1] > 0 for w in want.values()) > 50


@pytest.mark.parametrize("hot", [S.HOT, 4])
def test_two_spans_in_one_search(spark, hot):
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in S.dedup(df, span=70, hot=hot, passage=40, passage_words=11).collect()}
    want, short = plain.repeats(docs, 70), plain.repeats(docs, 40)
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == {d: w[:4] for d, w in want.items()}
    texts = dict(docs)
    for d, r in got.items():
        runs = [x for x in plain.runs(short[d][4]) if len((texts[d] or "").encode()[x[0] : x[1]].split()) > 11]
        assert (r.n_passages, r.passage_bytes) == (len(runs), sum(e - s for s, e in runs))
    assert 10 < sum(r.n_passages > 0 for r in got.values()) < sum(w[1] > 0 for w in short.values())


def test_only_runs_of_many_words_go(spark):
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    covered = plain.repeats(docs, 40)
    for r in S.dedup(df, span=40, more_words_than=11).collect():
        raw = (dict(docs)[r.doc_id] or "").encode()
        runs = [x for x in plain.runs(covered[r.doc_id][4]) if len(raw[x[0] : x[1]].split()) > 11]
        assert (r.n_spans, r.n_removed) == (len(runs), sum(e - s for s, e in runs))


def test_long_grams_are_chosen_by_content():
    import numpy as np

    rng = random.Random(2)
    raw = np.frombuffer(bytes(rng.choice(b"abcd") for _ in range(2000)), np.uint8)
    assert (S.gram_size(40), S.gram_size(240), S.gram_size(400)) == (16, 48, 80)
    inner = S.anchors(raw[300:900], 240)
    outer = dict(zip(*[x.tolist() for x in S.anchors(raw, 240)]))
    assert len(inner[0]) > 1 and all(outer[p + 300] == g for p, g in zip(*[x.tolist() for x in inner]))


def test_deep_shallow_sorts():
    rng = random.Random(3)
    for _ in range(200):
        base = bytes(rng.choice(b"ab") for _ in range(90))
        strings = [base[: rng.randint(0, 90)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 40))]
        order, lcps = S.deep_shallow(strings, list(range(len(strings))))
        assert [strings[i] for i in order] == sorted(strings)
        assert lcps == [0] + [S.common(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def test_reaches_against_pairs():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(2, 30)
        left = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(n)]
        right = [b"g" + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(n)]
        before, after = S.reaches(left, right, 9)
        for i in range(n):
            pairs = [(S.common(left[i], left[j]), S.common(right[i], right[j])) for j in range(n) if j != i]
            valid = [p for p in pairs if sum(p) >= 9]
            assert (before[i], after[i]) == (max((p[0] for p in valid), default=0), max((p[1] for p in valid), default=0))


def test_anchor_of_every_window():
    import numpy as np

    rng = random.Random(1)
    raw = np.frombuffer(bytes(rng.choice(b"abcd") for _ in range(3000)), np.uint8)
    hashes = S.gram_hashes(raw)
    low = np.uint64((1 << 21) - 1)
    for base, at, _ in S.window_anchors(raw, 50):
        for k, a in enumerate(at.tolist()):
            part = (hashes[base + k : base + k + 50 - S.GRAM + 1] & ~low).tolist()
            assert a == base + k + part.index(min(part))


def test_odd_rows_and_whole_characters(spark):
    passage = "é" * 300  # 600 bytes, and every other byte string starts within a character
    rows = [(1, "x" + passage + "1", 7), (2, "yy" + passage + "2", 8), (3, None, 9), (3, "k" * 30, 9), (None, "q" * 30, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = {(r.doc_id, r.n_bytes): r for r in S.dedup(df).collect()}
    assert len(got) == 5 and got[(1, 602)].kept_text == "x1" and got[(2, 603)].kept_text == "yy2"
    assert got[(3, 0)].kept_text == "" and got[(None, 30)].n_removed == 0
    assert S.dedup(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(4, "z y " * 200), (4, "z y " * 200)], "doc_id long, text string")
    assert [r.n_removed for r in S.dedup(twice).collect()] == [800, 800]
