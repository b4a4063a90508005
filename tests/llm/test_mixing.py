"""Mixing: targets against the rounds as worded, copies against a plain walk over hashes."""

import hashlib

import pytest

from vantry.llm import mixing


def rounds(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """Targets by sharing the excess again and again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    capped = set()
    while True:
        left = share * sum(sizes.values()) - sum(cap[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > cap[s]}
        if not over:
            return {s: cap[s] if s in capped else target[s] for s in names}
        capped |= over


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return [r.asDict() for r in mixing.mix(df).collect()]


@pytest.mark.parametrize("shape", [[40, 30, 30], [1000, 1, 1, 1], [5, 5, 5, 5, 5, 5, 5], [1, 200, 1, 90, 2, 60], [300]])
def test_targets_and_sums(spark, shape):
    rows = []
    for s, n in enumerate(shape):
        for k in range(n):
            rows.append((len(rows), "w " * (1 + (7 * k + s) % 13), None if s == 1 else f"s{s}"))
    got = mixed(spark, rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = rounds(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 7  # half of the largest document
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert sorted(map(str, mixed(spark, rows))) == sorted(map(str, got))  # reruns agree


def test_documents_follow_their_hash(spark):
    rows = [(k, "a b c", "x" if k % 3 else "y") for k in range(400)]
    place = lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16)
    for source in "xy":
        mine = sorted((place(r["doc_id"]), r["copies"]) for r in mixed(spark, rows) if r["source"] == source)
        copies = [c for _, c in mine]
        assert copies == sorted(copies, reverse=True)  # one threshold: those under it get one more


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "x", "b"), (4, " \t\n", "c"), (5, "w " * 50_000, "b")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    same = [r for r in got if r["doc_id"] == 3]
    assert same[0] == same[1] and same[0]["size"] == 2
    assert {r["source"]: r["target"] for r in got if r["source"] == "c"} == {"c": 0.0}
    assert mixed(spark, []) == []
    wide = spark.createDataFrame([(1, "x y", "a", 7, 9)], "doc_id long, text string, source string, size int, taken int")
    assert mixing.mix(wide).first().size == 2


@pytest.mark.parametrize("ids", ["null", "one", "few"])
def test_rows_without_own_ids_meet_the_targets(spark, ids):
    """A key that many rows share, and equal rows, are parted by text and number."""
    key = {"null": lambda k: None, "one": lambda k: 7 if k % 3 else k + 100, "few": lambda k: k % 5}[ids]
    rows = [(key(k), "same words here" if k % 4 == 0 else "w " * (1 + k % 17), f"s{k % 3}") for k in range(900)]
    got = mixed(spark, rows)
    assert len(got) == 900
    taken, target = {}, {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 9 for s in target), (taken, target)
    assert sorted(map(str, mixed(spark, rows))) == sorted(map(str, got))
