"""Toxicity: the models against plain Kneser-Ney, and accuracy on held-out documents."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from vantry.llm import toxicity as X


def fold(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 4


def corpus(n, rate=0.3, seed=1):
    rng = random.Random(seed)
    parts = ["an", "on", "re", "ti", "er", "st", "ou", "la", "de", "mi", "ga", "ló"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    bad = ["zugrok", "zugrel", "zugrin", "blavort"]
    docs, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < rate
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", word()])
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def scored(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return X.toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()


def test_held_out_documents(spark):
    docs, labels = corpus(700)
    truth = {k: t for k, _, t in labels}
    got = scored(spark, docs, labels)
    assert all(r.held_out == (fold(r.doc_id) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    assert np.mean([p == t for p, t in held]) > 0.95
    # labels of the held-out fold teach nothing
    turned = [(k, q, 1 - t if fold(k) == 2 else t) for k, q, t in labels]
    assert {r.doc_id: r.score for r in scored(spark, docs, turned)} == {r.doc_id: r.score for r in got}


def plain_backoff(counts):
    """Interpolated Kneser-Ney over continuation counts of a dictionary of n-grams."""
    if not counts or not any(counts):
        return lambda g: 1 / 256
    lower = collections.Counter(g[1:] for g in counts)
    if not any(lower):
        return lambda g: 1 / 256
    total, kinds = collections.Counter(), collections.Counter()
    for g, n in lower.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1
    below = plain_backoff(lower)
    return lambda g: (max(lower[g[1:]] - X.DISCOUNT, 0) + X.DISCOUNT * kinds[g[1:-1]] * below(g[1:])) / total[g[1:-1]]


def test_ratios_against_plain():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))).encode() for _ in range(60)]
    keys, _ = X.ngrams(words)
    unpack = lambda k: bytes(b for b in int(k).to_bytes(8, "big") if b)
    grams = [bytes([X.START]) + w + bytes([X.END]) for w in words]
    want = [g[max(0, i - X.ORDER + 1) : i + 1] for g in grams for i in range(1, len(g))]
    assert [unpack(k) for k in keys] == want
    unique = np.unique(keys)
    toxic = np.array([rng.randint(0, 3) for _ in unique], float)
    plain = np.array([rng.randint(0, 3) for _ in unique], float) + (toxic == 0)
    seen, unseen = X.likelihood_ratios(unique, toxic, plain)
    named = {unpack(k): (t, p) for k, t, p in zip(unique, toxic, plain)}
    below = plain_backoff({g: 1 for g in named})
    by_context = collections.defaultdict(list)
    for g in named:
        by_context[g[:-1]].append(g)
    for k in unique:
        g = unpack(k)
        fellows = by_context[g[:-1]]
        pooled = sum(sum(named[f]) for f in fellows)
        shared = (max(sum(named[g]) - X.DISCOUNT, 0) + X.DISCOUNT * len(fellows) * below(g)) / pooled
        logs = []
        for c in (0, 1):
            total = sum(named[f][c] for f in fellows)
            left = (X.DISCOUNT * sum(named[f][c] > 0 for f in fellows) + X.STRENGTH) / (total + X.STRENGTH)
            logs.append(math.log(max(named[g][c] - X.DISCOUNT, 0) / (total + X.STRENGTH) + left * shared))
        assert seen[X.cell(np.array([k]))[0]] == pytest.approx(logs[0] - logs[1], abs=1e-5)


def test_odd_inputs(spark):
    docs, labels = corpus(80)
    odd = [(900, None), (901, ""), (902, "!! 12"), (None, "la la"), (903, "an " * 40_000), (5, docs[5][1])]
    got = scored(spark, docs + odd, labels + [(901, None, None), (None, 1, 1), (7, 0, 1)])
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (900, 901, 902)}) == 1
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert [r.predicted for r in scored(spark, docs[:9], [])] == [0] * 9
    assert {r.predicted for r in scored(spark, docs, [(k, 1, 1) for k, _ in docs])} == {1}
    assert scored(spark, [], labels) == []
    wide = spark.createDataFrame([(1, "la", "x", 7)], "doc_id long, text string, score string, toxic int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert X.without_toxic(wide, known).columns == wide.columns
    assert X.toxicity(wide, known).first().toxic == 7


def test_no_two_ngrams_share_an_entry(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(300_000)]
    docs = [(" ".join(words[k : k + 1_000]), 0, k % 3_000 == 0) for k in range(0, len(words), 1_000)]
    df = spark.createDataFrame(docs, "text string, toxic int, fits boolean")
    counted = X._ngram_counts(df).toPandas()
    want = np.unique(X.ngrams([w.encode() for w in set(words)])[0])
    assert len(want) > 1 << 20 and np.array_equal(np.sort(counted["key"].to_numpy()), want)
    # n-grams and contexts never learnt back off
    seen, unseen = X.likelihood_ratios(*(counted[c].to_numpy() for c in ("key", "toxic", "plain")))
    strange, _ = X.ngrams(["".join(rng.choice("éöàñ") for _ in range(9)).encode() for _ in range(2_000)])
    strange = strange[strange >> 32 > 0]
    assert np.isnan(seen[X.cell(strange)]).all() and not unseen[X.cell(strange >> 8)].any()


def test_joined_model_is_the_broadcast_one(spark):
    docs, labels = corpus(200)
    docs += [(900, None), (901, ""), (902, "!! 12"), (None, "la la"), (903, "an " * 5_000), (5, docs[5][1]), (5, "zugrok")]
    d, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = lambda df: sorted(((r.doc_id or -1, r.text or "", r.held_out, r.predicted), r.score) for r in df.collect())
    sent, joined = rows(X.toxicity(d, known)), rows(X.toxicity(d, known, broadcast_most=0))
    assert [k for k, _ in sent] == [k for k, _ in joined]
    assert [s for _, s in joined] == pytest.approx([s for _, s in sent], abs=1e-4)
    wide = spark.createDataFrame([(1, "la", "x", 7)], "doc_id long, text string, score string, toxic int")
    got = X.toxicity(wide, known, broadcast_most=0)
    assert got.columns == X.toxicity(wide, known).columns and got.first().toxic == 7


def test_every_fold_but_the_held_out_one_teaches(spark, monkeypatch):
    docs = [(k, "la de" + (" qwyx" if fold(k) == 3 else " zorb" if fold(k) == 2 else "")) for k in range(60)]
    learnt = []
    ratios = X.likelihood_ratios
    monkeypatch.setattr(X, "likelihood_ratios", lambda keys, *counts: learnt.append(set(keys.tolist())) or ratios(keys, *counts))
    scored(spark, docs, [(k, 1, k % 2) for k, _ in docs])
    of = lambda word: set(X.ngrams([word])[0].tolist())
    assert of(b"qwyx") <= learnt[-1] and not (of(b"zorb") & learnt[-1])


def test_fit_sample_is_bounded(spark, monkeypatch):
    docs, labels = corpus(400)
    third = sum(fold(k) == 3 for k, _ in docs)
    bound = third // 2 + 1  # so that the count is under twice the bound
    monkeypatch.setattr(X, "FIT_BOUND", bound)
    seen = []
    plain = X._calibrate
    monkeypatch.setattr(X, "_calibrate", lambda x, y: seen.append(len(x)) or plain(x, y))
    scored(spark, docs, labels)
    assert seen and seen[0] <= 1.3 * bound < third
