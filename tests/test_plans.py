"""Plans of reports over large tables: no row is copied for a distinct or missing count."""

import re

from pyspark.sql import functions as F

from vantry.functions import network, text
from vantry.operators import features, quality
from vantry.plans.pipeline import open_pipeline


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_copy_no_rows(spark, folder):
    p = open_pipeline(spark, folder)
    for df in (features.user_features(p.identity, p.iam, p.endpoint), features.host_features(p.identity, p.endpoint, p.firewall)):
        assert not re.search(r"\bExpand\b|CartesianProduct|NestedLoop", plan(df))


def test_missing_report_copies_no_input_rows(spark, folder):
    below = plan(quality.missing_counts(open_pipeline(spark, folder).raw["firewall_raw"])).split("HashAggregate", 1)[1]
    assert not re.search(r"\bExpand\b|\bGenerate\b", below)


def test_a_lookup_makes_its_key_once(spark):
    """A CASE over labels would repeat the key's pattern once a label."""
    df = spark.range(1).select(F.concat(F.lit(" p1 "), F.col("id").cast("string")).alias("v"))
    for label in (text.severity, text.alert_status, text.department):
        assert plan(df.select(label(F.col("v")))).count("regexp_replace") <= 2


def test_addresses_cost_one_projection(spark):
    """Rows of plain addresses are not copied once a step of the IPv6 rewriting."""
    df = spark.range(1).select(F.col("id").cast("string").alias("v"), "id")
    assert plan(network.with_canonical_ip(df, "v", "out")).count("Project") <= 4
