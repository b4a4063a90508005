"""Resampling against whole-number sums in plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np

from vantry.llm import bit_sliced as B

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain(docs, target):
    """Rows as (doc_id, n_features, weight, score, rank)."""
    s, t = [0] * 10_000, [0] * 10_000
    for _, text in docs:
        for b in features(text)[1]:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows, pool = [], []
    for k, (d, text) in enumerate(docs):
        n, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(found), weight, score, None])
        if n >= 20:
            pool.append(k)
    pool.sort(key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    for place, k in enumerate(pool[: 25 * len(pool) // 100], 1):
        rows[k][4] = place
    return sorted(map(tuple, rows), key=str)


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    target = spark.read.parquet(f"{folder}/benchmark.parquet")
    got = B.resample(docs, target).collect()
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert sorted(map(tuple, got), key=str) == want and sum(r[4] is not None for r in want) > 20


def test_odd_rows(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["a", "É", "bb", "c3", "D"]) for _ in range(n))
    same = text(30)
    rows = [(1, None), (2, ""), (None, text(25)), (4, text(20)), (5, text(19)), (6, "x " * 60_000)] + [(7, same)] * 5 + [(k, text(40)) for k in range(8, 60)]
    df = spark.createDataFrame([(*r, "z", 3) for r in rows], "doc_id long, text string, rank string, score int")
    for target in (["a bb a bb"], [None, ""], []):
        wanted = spark.createDataFrame([(t,) for t in target], "text string")
        assert sorted(map(tuple, B.resample(df, wanted).collect()), key=str) == plain(rows, target)
    assert B.resample(df.limit(0), df.select("text")).count() == 0


def test_planes_sum_exactly():
    rng = np.random.default_rng(2)
    for _ in range(30):
        gains = rng.integers(-20_000, 20_000, 1_000) * (rng.random(1_000) < 0.7)
        counts = np.where(rng.random(1_000) < 0.2, rng.integers(0, 10 ** int(rng.integers(1, 9)), 1_000), 0)
        assert B.Gains(gains).total(counts) == sum(int(c) * int(g) for c, g in zip(counts, gains))
