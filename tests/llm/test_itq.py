"""Embedding links against all cosines in double precision."""

import numpy as np
import pytest

from tests.llm import plain
from vantry.llm import itq


def brute(rows):
    good = {k: (label, np.array(v, float)) for k, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}

    def linked(a, b):
        (la, x), (lb, y) = good[a], good[b]
        return la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= itq.COSINE

    count = {k: sum(linked(k, o) for o in good if o != k) if k in good else 0 for k, _, _ in rows}
    names = plain.groups(sorted(good), linked)
    return {k: (count[k], names.get(k, k), names.get(k, k) == k) for k, _, _ in rows}


def fixture():
    rng = np.random.default_rng(3)
    rows, centres = [], rng.standard_normal((12, 16))
    for c in centres:
        for _ in range(rng.integers(1, 14)):
            rows.append((len(rows), (c + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist(), int(rng.integers(0, 2))))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(5)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    return rows + [(500 + k, v, 1) for k, v in enumerate(odd)] + [(600, rows[0][1], None)]


@pytest.mark.parametrize("block", [itq.BLOCK, 3])
def test_against_all_pairs(spark, block):
    rows = fixture()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in itq.near_duplicates(df, block=block).collect()}
    assert got == brute(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1500, 64))
    y = x + 0.38 * rng.standard_normal(x.shape)  # cosines around 0.93
    both = [(k, v.tolist(), 1) for k, v in enumerate(np.concatenate([x, y]).astype(np.float32))]
    got = {r.vec_id: r.n_links for r in itq.near_duplicates(spark.createDataFrame(both, "vec_id long, embedding array<float>, label int")).collect()}
    z = np.array([v for _, v, _ in both])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    want = (z @ z.T >= itq.COSINE).sum(axis=1) - 1
    found = np.array([got[k] for k in range(len(both))])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum() and want.sum() > 500


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, True), (1, [1.0, 0.0], 1, False)], "vec_id long, embedding array<float>, label int, kept boolean")
    assert [tuple(r) for r in itq.near_duplicates(df).collect()] == [(1, 1, 1, True)] * 2
    assert itq.near_duplicates(df.limit(0)).count() == 0


def test_rotation_balances_codes():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 16)) @ np.diag(np.linspace(3, 0.2, 16))
    turn = itq.Rotation(x, 16)
    assert np.allclose(turn.matrix.T @ turn.matrix, np.eye(16), atol=1e-8)
    y = (x - turn.centre) @ turn.directions
    loss = lambda m: ((np.where(y @ m >= 0, 1, -1) - y @ m) ** 2).sum()
    assert loss(turn.directions.T @ turn.matrix) < loss(np.eye(16))


@pytest.mark.parametrize("mean", [0.0, 0.5, 0.7])
def test_tables_find_pairs_at_the_threshold_of_large_labels(mean):
    rng = np.random.default_rng(11)
    centre = np.zeros(64)
    centre[0] = np.sqrt(mean)

    def draw(n):
        x = rng.standard_normal((n, 64)) / 8 * np.sqrt(1 - mean) + centre
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    width, count, turns = itq.fit(draw(3_000), 1_000_000)
    each = 64 // width if width else 1
    x = draw(5_000)
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    y = itq.COSINE * x + np.sqrt(1 - itq.COSINE**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    a, b = (np.column_stack([itq.cut_codes(t.codes(v), width, each) for t in turns])[:, :count] for v in (x, y))
    assert (a == b).any(axis=1).mean() >= 0.98


def test_one_bit_codes_lose_no_pair():
    x = np.random.default_rng(2).standard_normal((500, 8))
    assert itq.fit(x / np.linalg.norm(x, axis=1, keepdims=True), 100_000, bits=1)[0] == 0
