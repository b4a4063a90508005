"""Lookups of some ids build only the tables that can hold them."""

from pyspark.sql import functions as F

from tests.compare import differences
from oracle.answers import all_sql
from vantry.plans.pipeline import open_pipeline
from vantry.plans.queries import Q


def test_node_lookup_needs_no_risk_sequences_or_evidence(spark, con, folder):
    p = open_pipeline(spark, folder, fresh=True)
    assert differences(Q["G04_node_lookup"](p), con, all_sql()["G04_node_lookup"]) == []
    assert not {"nodes", "entity_nodes", "user_risk", "sequences", "user_members", "host_members"} & set(p.__dict__)


def test_ids_of_risk_rows_and_events_ask_for_all_nodes(spark, folder):
    p = open_pipeline(spark, folder, fresh=True)
    p.__dict__["nodes"] = all_nodes = spark.createDataFrame([("N",)], "node_id string")
    event = p.events.select(F.col("event_id").alias("node_id")).limit(1)
    for ids in (event, spark.createDataFrame([("RISK-X",)], "node_id string"), spark.createDataFrame([("SEQ-USR-X",)], "node_id string")):
        assert p.nodes_among(ids) is all_nodes
    assert p.nodes_among(spark.createDataFrame([("nobody",), (None,)], "node_id string")) is not all_nodes
