"""Checks of ids and keys in few aggregations count as the plain ones do."""

from pyspark.sql import functions as F

from vantry.operators import quality


def test_member_checks_count_as_the_plain_checks(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("B",), ("C",), (None,), (None,)], "node_id string")
    edges = spark.createDataFrame([("A", "B"), ("X", "A"), ("X", "Y"), ("Z", "Y"), (None, "C"), ("A", None)], "s string, t string")
    got = quality.member_checks(nodes, "node_id", "unique node", "nodes", edges, {"source exists": "s", "target exists": "t"}, "edges")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    plain = [quality.counted("unique node", "nodes", quality.repeated_keys(nodes, "node_id"))] + [
        quality.counted(f"{n} exists", "edges", quality.missing_members(edges, n[0], nodes, "node_id")) for n in ("source", "target")]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(df.first()) for df in plain) == [
        ("edges", "source exists", 2), ("edges", "target exists", 1), ("nodes", "unique node", 2)]


def test_repeated_keys_by_hash(spark):
    df = spark.createDataFrame([("A", "B"), ("A", "B"), ("A", "C"), (None, "C"), (None, "C")], "a string, b string").withColumn("x", F.lit(1))
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(quality.repeated_hashed_keys(df, "a", "b")) == rows(quality.repeated_keys(df, "a", "b"))
