import statistics

import pytest
from pyspark.sql import functions as F

from vantry.functions import numbers
from vantry.operators import joins, robust


def test_mad_of_one_to_nine(spark):
    df = spark.range(1, 10).select(F.col("id").cast("double").alias("v"))
    assert robust.global_stats(df, ["v"])["v"] == (5.0, 2.0)


@pytest.mark.parametrize("value, median, mad, expected", [
    (0.0, 0.0, 0.0, 0.0), (5.0, 0.0, 0.0, 5.0), (50.0, 0.0, 0.0, 10.0), (15.0, 5.0, 2.0, 10 / (1.4826 * 2)),
    (1000.0, 0.0, 1.0, 20.0), (None, 1.0, 1.0, 0.0),
])
def test_robust_z(spark, value, median, mad, expected):
    df = spark.createDataFrame([(value, median, mad)], "v double, m double, d double")
    z = df.select(numbers.robust_z(F.col("v"), F.col("m"), F.col("d")).alias("z")).first().z
    assert z == pytest.approx(expected)


@pytest.fixture
def skewed(spark):
    """One group with most rows, heavy ties and a long tail."""
    return spark.range(20_000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("g"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.pow(F.col("id") % 977, F.lit(3.0))).alias("v"),
        (F.col("id") * 7919 % 20_011).cast("double").alias("w"),
    )


def test_medians_equal_built_in_ones(spark, skewed):
    got = {r.g: r.asDict() for r in robust.robust_stats(skewed, ["v", "w"], ["g"]).collect()}
    rows = skewed.collect()
    for g in {r.g for r in rows}:
        for m in ("v", "w"):
            values = [r[m] for r in rows if r.g == g]
            middle = statistics.median(values)
            assert got[g][f"{m}_median"] == pytest.approx(middle)
            assert got[g][f"{m}_mad"] == pytest.approx(statistics.median(abs(x - middle) for x in values))
    every = [r.w for r in rows]
    assert robust.global_stats(skewed, ["v", "w"])["w"][0] == pytest.approx(statistics.median(every))


@pytest.mark.parametrize("accuracy", [4, 50, 10_000])
def test_medians_by_any_bracket(spark, skewed, accuracy):
    """Wide brackets keep many values, heavy values become ends; all are exact."""
    metrics = ["v", "w", "u"]
    df = skewed.withColumn("u", F.when(F.col("w") < 15_000, 1.0).otherwise(F.col("w"))).withColumn("g", F.when(F.col("g") != "g3", F.col("g")))
    rows = df.collect()
    got = {r.g: r for r in robust.wide_medians(df, metrics, ["g"], accuracy=accuracy).collect()}
    assert None in got and len(got) == len({r.g for r in rows})
    for g, r in got.items():
        for m in metrics:
            assert r[f"{m}_median"] == pytest.approx(statistics.median(x[m] for x in rows if x.g == g))


def test_bracket_that_misses_is_widened(spark, skewed, monkeypatch):
    whole = robust._brackets

    def wrong(data, metrics, groups, accuracy, reach):
        found = whole(data, metrics, groups, accuracy, reach)
        return found if reach > 1_000 else found.withColumns({f"_b_{m}": F.array(F.lit(-5.0), F.lit(-4.0)) for m in metrics})

    monkeypatch.setattr(robust, "_brackets", wrong)
    want = statistics.median(r.w for r in skewed.collect())
    assert robust.global_medians(skewed, ["w"])["w"] == pytest.approx(want)


def test_groups_without_values_keep_their_row(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", 4.0), (None, 7.0)], "g string, v double")
    assert {r.g: r.v_median for r in robust.wide_medians(df, ["v"], ["g"]).collect()} == {"a": None, "b": 3.0, None: 7.0}
    assert robust.global_medians(df.where("g = 'a'"), ["v"]) == {"v": None}


def test_missing_median_fails(spark):
    df = spark.createDataFrame([(None,)], "v double")
    with pytest.raises(ValueError, match="v"):
        robust.require(robust.global_medians(df, ["v"]))


def test_percentile_rank_averages_ties(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 2, 4)], "g string, v int")
    got = sorted(r.p for r in robust.percentile_rank(df, "g", "v", "p").collect())
    assert got == [25.0, 62.5, 62.5, 100.0]


def test_broadcast_only_below_the_limit(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    small, large = spark.range(5), spark.range(5000)
    assert "broadcast" in plan(joins.broadcast_if_small(small, 10))
    assert "broadcast" not in plan(joins.broadcast_if_small(large, 10))
    assert joins.broadcast_if_small(large, 10).count() == 5000


def test_mark_join_with_missing_and_repeated_keys(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "k") for i in range(100)], "id int, k string")
    members = spark.createDataFrame([("k",), ("k",), (None,)], "m string")
    rows = joins.mark_join(df, "k", members, "m", "hit", "id").collect()
    assert len(rows) == 100 and all(r.hit == (r.k == "k") for r in rows)
