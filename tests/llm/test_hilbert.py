"""Sharding: the curve, and the law of equal row counts."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from vantry.llm import hilbert


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_is_one_walk(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.hilbert(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("n", [1, 7, 500])
def test_law(spark, n):
    rows = [(k, None if k == 3 else "t" * (k % 9), "hot" if k % 3 else None, "en", 0) for k in range(n)] + [(0, "x", "a", None, 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard int")
    got = hilbert.shard(df).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(counts) <= set(range(16))
    sizes = [counts[s] for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    for r in got:
        if r.doc_id and r.doc_id != 3:
            text = "t" * (r.doc_id % 9)
            assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text.encode()))
    again = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in hilbert.shard(df.repartition(3)).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in got}


def test_empty(spark):
    assert hilbert.shard(spark.createDataFrame([], "doc_id long, text string, source string, lang string")).count() == 0


def test_equal_texts_lie_side_by_side(spark):
    rows = [(k, f"text {k % 7}" if k % 3 else "hot text", "s", "en") for k in range(600)] + [(None, "hot text", "s", "en")] * 300
    got = hilbert.shard(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    order = [(r.curve, r.text_crc32) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert len(order) == 900 and order == sorted(order)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_written_shards_prune_and_lose_nothing(spark, tmp_path):
    rows = [(k, "word " * (1 + k % 60), f"s{k % 9}" if k % 10 else None, ("en", "de", None)[k % 3], 5) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, slot int")
    folder = f"{tmp_path}/out"
    bounds = hilbert.write(df, folder).collect()
    assert sorted(b.shard for b in bounds) == list(range(16)) and sum(b["rows"] for b in bounds) == 900
    assert sum(b.bytes for b in bounds) == sum(len(r[1]) for r in rows)
    assert sum(b.nulls_source for b in bounds) == sum(r[2] is None for r in rows)
    assert Counter(r.doc_id for r in spark.read.parquet(f"{folder}/rows").collect()) == Counter(r[0] for r in rows)
    whole = len(spark.read.parquet(f"{folder}/rows").inputFiles())
    for ranges, holds in [
        ({"source": ("s2", "s3")}, lambda r: r[2] in ("s2", "s3")),
        ({"source": ("s0", "s1"), "size": (1, 40)}, lambda r: r[2] in ("s0", "s1") and len(r[1]) + 1 <= 40),
        ({"lang": ("de", "de"), "source": ("s8", "s8")}, lambda r: r[3] == "de" and r[2] == "s8"),
    ]:
        found = hilbert.read_range(spark, folder, **ranges)
        assert sorted(r.doc_id for r in found.collect()) == [r[0] for r in rows if holds(r)]
        assert len(found.inputFiles()) < 0.8 * whole
    assert hilbert.read_range(spark, folder, size=(10**6, 10**7)).count() == 0
