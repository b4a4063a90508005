"""Edges by type: what a type reads, which ends it checks, and what is stored."""

import os

from pyspark.sql import functions as F

from vantry.operators import graph, temporal
from vantry.plans.pipeline import open_pipeline


def test_a_type_of_edges_reads_only_its_tables(spark, folder):
    p = open_pipeline(spark, folder, fresh=True)
    df = p.edges_of("CONNECTED_FROM_IP", "COMMUNICATED_WITH_IP")
    assert df.columns == graph.EDGE_COLUMNS and df.count() > 0
    assert not {"nodes", "sequences", "user_sequence_evidence", "user_risk"} & set(p.__dict__)
    assert set(p.spark.read.parquet(f"{p.store.root}/edges/CONNECTED_FROM_IP").columns) == {"source_id", "target_id", "source_record_id"}


def test_every_end_is_a_node(spark, folder):
    """Ends that are not looked up are nodes all the same."""
    p = open_pipeline(spark, folder)
    assert set(graph.EDGE_TYPES) == set(p._edge_types)
    assert graph.with_both_ends(p.edges, p.nodes).count() == p.edges.count() == p.edges.select(*graph.KEY).distinct().count()
    assert {r[0] for r in p.edges.select("relationship_type").distinct().collect()} == set(graph.EDGE_TYPES)


def test_open_ends_are_looked_up(spark):
    rows = spark.createDataFrame([("A", "X", "EXACT", "p"), ("A", "X", "EXACT", "o"), ("B", "X", "EXACT", "p"), ("A", "Y", "EXACT", "p"), (None, "X", "EXACT", "p")],
                                 "source_node string, target_node string, confidence string, provenance string")
    tables = [lambda: rows.withColumn("target_type", F.lit("ALERT"))] * 7
    nodes = spark.createDataFrame([("A",), ("X",)], "node_id string")
    kind = graph.edge_types(*tables)["TRIGGERED_EVENT"]
    got = graph.typed_edges(graph.typed_rows(kind, lambda: nodes), "TRIGGERED_EVENT", kind).collect()
    assert [(r.source_id, r.target_id, r.source_dataset, r.source_record_id) for r in got] == [("A", "X", "o", "X")]


def test_adjacency_makes_hashed_ids_again(spark, store):
    kind = {"relationship_type": F.lit("R")}
    df = spark.createDataFrame([("A", "B"), ("B", "B")], "source_id string, target_id string").withColumns(kind)
    df = df.withColumn("edge_id", graph.hash_id("EDG-", *graph.KEY))
    name = store.fresh("adjacency")
    links = graph.adjacency(df, store, name, hashed_ids=True)
    assert {(r.node, r.neighbor, r.edge_id) for r in links.collect()} == {
        (n, m, r.edge_id) for r in df.collect() for n, m in ((r.source_id, r.target_id), (r.target_id, r.source_id))}
    assert links.count() == 4
    assert "edge_id" not in spark.read.parquet(os.path.join(store.root, name)).columns


def test_sequences_need_no_numbered_evidence(spark, folder):
    p = open_pipeline(spark, folder, fresh=True)
    alone = p.sequences
    assert alone.count() > 0 and not {"user_sequence_evidence", "host_sequence_evidence"} & set(p.__dict__)
    q = open_pipeline(spark, folder)
    q.sequence_evidence
    summed = [temporal.sequence_rows(q.user_sequence_evidence, "USER"), temporal.sequence_rows(q.host_sequence_evidence, "HOST")]
    assert sorted(map(str, alone.collect())) == sorted(map(str, summed[0].unionByName(summed[1]).collect()))


def test_nodes_and_edges_need_no_numbered_evidence(spark, folder):
    p = open_pipeline(spark, folder, fresh=True)
    assert p.edges.count() > 0 and p.nodes.count() == p.node_ids.distinct().count()
    assert not {"user_sequence_evidence", "host_sequence_evidence"} & set(p.__dict__)
    some = p.store.put("some", p.risk_scores.orderBy("entity_id").limit(3).select("entity_id"))
    ids = some.select("entity_id").toPandas()["entity_id"].tolist()
    touched = p.edges.where(F.col("source_id").isin(ids) | F.col("target_id").isin(ids))
    rows = lambda df: sorted(map(str, df.select(graph.EDGE_COLUMNS).collect()))
    assert rows(p.edges_at(some)) == rows(touched) == rows(p.entity_edges.where(F.col("source_id").isin(ids) | F.col("target_id").isin(ids)))
    assert rows(p.address_edges.where(F.col("target_id").startswith("IP-"))) == rows(p.edges.where(F.col("target_id").startswith("IP-")))


def test_entities_named_like_events_keep_the_edges_of_evidence(spark, folder):
    """An entity that bears an event's id is an end of edges from evidence; none may be left out."""
    p = open_pipeline(spark, folder, fresh=True)
    event = p.edges.where("relationship_type = 'SEQUENCE_INCLUDES_EVENT'").orderBy("target_id").first().target_id
    p.__dict__["risk_scores"] = p.risk_scores.withColumn("entity_id", F.lit(event)).limit(1)
    assert set(graph.OF_EVIDENCE) <= {r[0] for r in p.entity_edges.select("relationship_type").distinct().collect()}


def test_an_open_end_may_be_a_cited_event(spark, store):
    ids = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    edges = spark.createDataFrame([("U", "1"), ("E1", "2"), ("E2", "3"), ("X", "4")], "source_id string, target_id string")
    got = graph.with_open_ends(edges, ("source_id",), ids("node_id", "U"), ids("event_id", "E1", "E2"), lambda: ids("event_id", "E1", "E1"), store)
    assert sorted(r.target_id for r in got.collect()) == ["1", "2"]
    asked = []
    graph.with_open_ends(edges, ("source_id",), ids("node_id", "U"), ids("event_id", "E3"), lambda: asked.append(1), store)
    assert not asked
