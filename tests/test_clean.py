"""Whole-row duplicates without dealing all rows; plain times by a cast."""

from pyspark.sql import functions as F

from vantry.functions import numbers, text, times
from vantry.operators import canonical, clean
from vantry.plans.pipeline import open_pipeline


def test_only_rows_of_repeated_hashes_are_dealt(spark):
    rows = [("a", None), (None, "a"), ("b", "c"), ("b", "c"), ("b", "c"), ("b", "d"), (None, None), (None, None)] + [(str(i), str(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "x string, y string").repartition(8)
    # nulls leave a hash as it is, so the first two rows share one
    assert df.where("coalesce(x, y) = 'a' and (x is null or y is null)").select(F.xxhash64("x", "y")).distinct().count() == 1
    got = clean.distinct_rows(df)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.distinct().collect()))
    assert sorted(map(str, clean.distinct_rows(df, most=0).collect())) == sorted(map(str, df.distinct().collect()))
    one = clean.distinct_rows(df.coalesce(1))
    assert sorted(map(str, one.collect())) == sorted(map(str, df.distinct().collect()))
    assert "RepartitionByExpression" in one._jdf.queryExecution().optimizedPlan().toString()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Aggregate [x") == 1 and "LeftSemi" in plan[plan.index("Aggregate [x"):]


def test_no_rows(spark):
    assert clean.distinct_rows(spark.createDataFrame([], "x string, y string")).count() == 0


def test_plain_times_equal_those_by_pattern(spark, monkeypatch):
    texts = [f"{d}{t}{h}{z}" for d in ("2024-01-31", "2024-02-30", "2023-02-29", "2024-13-01", "2024-00-10", "0000-01-01", "0001-01-01", "9999-12-31", "1582-10-10", "2024-1-05")
             for t in (" ", "T") for h in ("00:00:00", "23:59:59", "24:00:00", "10:60:00", "10:00:60", "10:00:61") for z in ("", "Z", "\n", "+01:00")]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for options in ({}, {"day_first": False, "epoch": False, "to_utc": True}):
        value = lambda: df.select("t", times.parse_timestamp(F.col("t"), **options).cast("string").alias("v"))
        with monkeypatch.context() as m:
            fast = value().collect()
            assert "cast(t" in value()._jdf.queryExecution().optimizedPlan().toString().lower()
            m.setattr(times, "PLAIN", "^never$")
            assert value().collect() == fast
        assert {r.v is None for r in fast} == {True, False}


def test_failing_casts_and_patterns_are_guarded(spark):
    """Text that is no number is not cast (an exception a row); names without the suffix meet no pattern."""
    df = spark.createDataFrame([(x,) for x in ("443", "443.0", "80.5", "http", "0", "70000", "", "-1", "1e3", None)], "v string")
    ports = df.select("v", numbers.port(F.col("v")).alias("p"))
    assert {r.v: r.p for r in ports.collect() if r.p is not None} == {"443": 443, "443.0": 443, "1e3": 1000}
    plan = ports._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("cast(v") <= plan.count("rlike")
    names = spark.createDataFrame([(x,) for x in (" ws_1.corp.local ", "WS-1", "a.corp.local.corp.local", "corp.local", "x.corp.localy", "a.corp.local\u2028")], "v string")
    hosts = names.select(text.hostname(F.col("v")).alias("h"))
    assert [r.h for r in hosts.collect()] == ["WS-1", "WS-1", "A.CORP.LOCAL", "CORP.LOCAL", "X.CORP.LOCALY", "A\u2028"]
    assert "contains(" in hosts._jdf.queryExecution().optimizedPlan().toString().lower()


def test_events_are_written_without_a_sort(spark, folder, monkeypatch):
    p = open_pipeline(spark, folder, fresh=True)
    puts, put = {}, p.store.put

    def kept(name, df, partition_by=None):
        puts[name] = partition_by
        return put(name, df, partition_by)

    monkeypatch.setattr(p.store, "put", kept)
    got = p.events
    assert {n for n in puts if n.startswith("events")} == {f"events/source_dataset={s}" for s in ("IAM", "Endpoint", "Firewall")}
    assert not any(v for n, v in puts.items() if n.startswith("events"))
    want = canonical.canonical_events(p.identity, p.iam, p.endpoint, p.firewall)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
