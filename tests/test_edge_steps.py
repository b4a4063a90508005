"""Steps before the edges that deal less give what the plain steps give."""

from pyspark.sql import functions as F

from vantry.functions import times
from vantry.operators import canonical, graph, temporal


def rows(df):
    return sorted(map(str, df.collect()))


def test_keys_that_repeat_are_compared_and_others_stay(spark):
    df = spark.createDataFrame([("A", "1", "x"), ("A", "1", "b"), ("A", "2", None), (None, "1", "z"), (None, "1", "y")], "s string, t string, r string")
    want = rows(graph._first_of_key(df, ["s", "t"], ["r"]))
    assert rows(graph._first_where_repeated(df, ["s", "t"], ["r"])) == rows(graph._first_where_repeated(df, ["s", "t"], ["r"], 0)) == want
    assert len(want) == 3


def test_many_open_ends_meet_only_ids_in_their_range(spark, store):
    n = graph.BROADCAST_ROWS + 5
    edges = spark.range(n).select(F.lit("U").alias("source_id"), F.format_string("ALT-%06d", "id").alias("target_id"))
    cited = spark.range(10, 20).select(F.format_string("ALT-%06d", "id").alias("event_id")).union(spark.range(9).selectExpr("concat('LOG-', id)"))
    entities = spark.createDataFrame([("U",), ("ALT-000001",)], "node_id string")
    got = graph.with_open_ends(edges, ("target_id",), entities, cited, lambda: cited, store)
    assert sorted(r.target_id for r in got.collect()) == ["ALT-000001"] + [f"ALT-{i:06d}" for i in range(10, 20)]


def test_known_sources_sum_as_sets_do(spark):
    names = "entity_id string, anchor long, us long, source_dataset string, event_category string, action string"
    df = spark.createDataFrame([
        ("A", 0, 5, "IAM", "AUTHENTICATION", "LOGIN_FAILED"), ("A", 0, 6, "Firewall", "NETWORK_FLOW", "DENY"), ("A", 9, 9, "Firewall", "NETWORK_FLOW", None),
        ("B", 1, 1, "Endpoint", "ENDPOINT_ALERT", "X"), ("B", 1, 2, None, None, None)], names)
    plain = temporal.sequence_rows(df, "HOST")
    quick = temporal.sequence_rows(df, "HOST", known_sources=canonical.SOURCES, known_categories=canonical.CATEGORIES)
    assert quick.dtypes == plain.dtypes and rows(quick) == rows(plain)


def test_only_entities_of_several_partitions_need_functions(spark, store):
    events = spark.range(3000).selectExpr("IF(id < 2500, 'A', concat('B', id)) AS user_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id) AS event_timestamp")
    r = temporal.segments(temporal.ticks(events, "user_id"), limit=500, store=store)
    assert {x[0] for x in temporal._going_on(r).select("entity_id").distinct().collect()} == {"A"}


def test_common_time_shapes_need_no_formats(spark, monkeypatch):
    texts = ["2024/02/29 23:59:59", "2023/02/29 10:00:00", "13/02/2024 01:02:03", "02/13/2024 01:02:03", "02/03/2024 01:02:03", "02-03-2024 01:02:03",
             "02/03-2024 01:02:03", "31/31/2024 01:02:03", "1706000000", "2024/01/01 24:00:00", "01/01/0000 00:00:00", "2024/01/01 10:00:60"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parse = lambda: [df.select(times.parse_timestamp(F.col("t"), day_first=d, epoch=e).cast("string").alias("v")).collect() for d in (True, False) for e in (True, False)]
    quick = parse()
    for name in ("PLAIN", "SLASHED", "YEAR_LAST"):
        monkeypatch.setattr(times, name, "^never$")
    assert quick == parse()
    assert [quick[i][j].v[:10] for i, j in ((0, 2), (0, 3), (0, 4), (2, 4))] == ["2024-02-13", "2024-02-13", "2024-03-02", "2024-02-03"]
