"""Row numbers across range partitions, also where one group or one value holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from vantry.operators.ranks import numbered


@pytest.mark.parametrize("groups", [1, 3, 40])
def test_numbers_within_groups(spark, groups):
    rng = random.Random(groups)
    rows = [(None if g == 2 else f"g{g}", rng.choice([5, 5, 5, 6]), k) for k, g in enumerate(min(int(rng.expovariate(1.5)), groups - 1) for _ in range(3_000))]
    df = spark.createDataFrame(rows, "g string, t long, id long").repartition(7)
    got = {r.id: r.n for r in numbered(df, ["t", F.col("id").desc()], "n", group=["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], -r[2])), 1):
            want[r[2]] = n
    assert got == want


def test_whole_table_and_none(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("v"), "id")
    got = numbered(df, [F.col("v").desc(), "id"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 10_001))
    assert [(r.v, r.id) for r in got] == sorted(((r.v, r.id) for r in got), key=lambda x: (-x[0], x[1]))
    assert numbered(df.limit(0), ["id"], "n").count() == 0
    assert numbered(df.limit(0), ["id"], "n", group=["v"]).count() == 0


def test_one_instant_of_one_entity_is_spread(spark):
    df = spark.range(200_000).select(F.lit("host").alias("e"), F.lit(7).alias("t"), F.col("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        got = numbered(df, ["t", "id"], "n", group=["e"])
        assert got.where(F.col("n") != F.col("id") + 1).count() == 0 and got.count() == 200_000
        ranged = df.repartitionByRange("e", "t", "id").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(ranged) == 4 and max(r["count"] for r in ranged) < 200_000 * 0.4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbered_rows_are_stored_as_columns(spark):
    """A checkpoint would hold whole rows, not compressed, and every reader would read all of them."""
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("g"))
    out = numbered(df, ["id"], "n", ["g"])
    assert "parquet" in out._jdf.queryExecution().executedPlan().toString().lower()
    assert {(r.g, r.n) for r in out.collect()} == {(i % 3, i // 3 + 1) for i in range(100)}
