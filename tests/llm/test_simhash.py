"""Fingerprints and links against plain loops; the trees against all pairs."""

import random

import numpy as np
import pytest

from tests.llm import plain
from vantry.llm import simhash


def result(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()}


def test_against_plain(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    docs = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 60, 400]))]
        docs.append((len(docs), " ".join(base)))
        for _ in range(rng.randint(0, 4)):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            docs.append((len(docs), "\t".join(near)))
    docs += [(900, None), (901, ""), (902, " \n"), (903, docs[0][1]), (904, docs[0][1].upper()), (905, "one"), (906, "a b c d"), (907, "w " * 70_000)]
    prints, names = plain.near_copies(docs)
    assert result(spark, docs) == {d: (prints[d], names[d]) for d, _ in docs}


@pytest.mark.parametrize("depth", [0, 3])
def test_trees_lose_no_pair(depth):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 700, dtype=np.uint64)
    ball = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    near = base[:300].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    values = np.unique(np.concatenate([base, ball, near]))
    want, got = simhash.Links(len(values)), simhash.Links(len(values))
    want.add(*np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4))
    for part in simhash.SLICES:
        homes = np.zeros(len(values), int)
        for _, rows, home in simhash.Tree(*part, depth, values[::3]).route(values):
            homes[rows[home]] += 1
            simhash.near_pairs(values, rows[home], rows, part, got)
        assert (homes == 1).all()
    every = np.arange(len(values))
    assert (want.root(every) == got.root(every)).all()


def test_slices_cover_the_radius():
    assert sum(bits for _, bits, _ in simhash.SLICES) == 64
    assert sum(radius + 1 for _, _, radius in simhash.SLICES) == simhash.RADIUS + 1


def test_dedup_and_odd_rows(spark):
    rows = [(5, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 3), (8, None, 4), (9, "", 5), (None, "zz y x w v", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id, r.fp) for r in simhash.dedup(df).collect())
    assert got == [(3, 2), (3, 3), (8, 4)]  # rows of one key stay together; all columns are kept
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.near_duplicates(df).count() == 6
