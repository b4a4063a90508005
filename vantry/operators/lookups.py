"""Triage, entity lookup and dashboard queries over the result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text, times
from .joins import one_row, top_per_group


def posture(users: DataFrame, hosts: DataFrame, sequences: DataFrame, outliers: DataFrame, peers: DataFrame) -> DataFrame:
    """Headline counts in one row."""
    level = F.col("risk_level")
    return one_row([
        users.agg(F.count("*").alias("total_users"), F.count_if(level == "CRITICAL").alias("critical_users"),
                  F.count_if(level == "HIGH").alias("high_users")),
        hosts.agg(F.count("*").alias("total_hosts")),
        sequences.agg(F.count("*").alias("sequence_count")),
        outliers.agg(F.count_if("is_multi_dimensional_outlier").alias("multi_dimensional_outliers")),
        peers.agg(F.count_if("peer_outlier_flag").alias("peer_outliers")),
    ])


def quadrants(risk: DataFrame, score: float = 60.0, confidence: float = 0.5) -> DataFrame:
    high, sure = F.col("risk_score") >= score, F.col("risk_confidence_score") >= confidence
    name = F.when(high & sure, "Q1").when(high, "Q2").when(sure, "Q3").otherwise("Q4")
    return risk.groupBy(name.alias("quadrant")).agg(F.count("*").alias("entities"))


def choose(df: DataFrame, **choices: list | None) -> DataFrame:
    """Keep rows whose columns are among the chosen values; no choice keeps all."""
    for column, values in choices.items():
        if values:
            df = df.where(F.col(column).isin(values))
    return df


SORTS = {
    "risk": [F.desc, "risk_score"],
    "confidence": [F.desc, "risk_confidence_score"],
    "cluster": [F.desc_nulls_last, "cluster_id"],
    "entity": [F.asc, "entity_id"],
}


def triage_queue(
    risk: DataFrame, clusters: DataFrame, sort_by: str = "risk", search: str = "", limit: int = 50, **choices
) -> DataFrame:
    """Filtered, searched and sorted users with their cluster, first ``limit``."""
    df = choose(risk, **choices)
    if search:
        df = df.where(text.contains_any(search, F.col("entity_id"), F.col("username")))
    joined = df.join(
        clusters.select("user_id", "cluster_id", "cluster_label", "behavior_deviation_score"),
        df["entity_id"] == F.col("user_id"), "left")
    direction, column = SORTS[sort_by]
    return joined.orderBy(direction(column), "entity_id").limit(limit).select(
        "entity_id", "username", "department", "risk_level", "risk_score", "risk_confidence_score",
        "risk_confidence_level", "cluster_id", "cluster_label", "primary_hypothesis")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def risk_rows(ids: DataFrame, risk: DataFrame) -> DataFrame:
    """Risk row per requested id (column entity_id), defaults when absent."""
    found = ids.select("entity_id").distinct().join(
        risk.select("entity_id", "entity_type", "risk_score", "risk_level", "risk_confidence_score",
                    "risk_confidence_level", "primary_hypothesis"), "entity_id", "left")
    return found.select(
        "entity_id",
        F.col("entity_type").isNotNull().alias("found"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("risk_level", F.lit("LOW")).alias("risk_level"),
        F.coalesce("risk_confidence_score", F.lit(0.5)).alias("risk_confidence_score"),
        F.coalesce("risk_confidence_level", F.lit("MEDIUM")).alias("risk_confidence_level"),
        "primary_hypothesis",
    )


def behavior_profile(user_risk: DataFrame, clusters: DataFrame) -> DataFrame:
    """Observed values, deviations and cluster per user, nested."""
    z = ["authentication_deviation", "network_deviation", "endpoint_deviation", "off_hours_deviation"]
    seen = ["failed_login_count", "authentication_failure_rate", "off_hours_activity_count", "endpoint_alert_count"]
    return user_risk.join(clusters.select("user_id", "cluster_label"), "user_id", "left").select(
        F.col("user_id").alias("entity_id"),
        F.coalesce("cluster_label", F.lit("CLUSTER_0")).alias("cluster_label"),
        F.struct(*seen).alias("observed_values"),
        F.struct(*z).alias("z_deviations"))


def peer_comparison(user_risk: DataFrame, peers: DataFrame) -> DataFrame:
    return user_risk.select(
        "user_id", "department", "department_failed_login_percentile", "peer_failed_login_median"
    ).join(peers.select("user_id", "peer_outlier_flag"), "user_id", "left").select(
        F.col("user_id").alias("entity_id"),
        F.coalesce("peer_outlier_flag", F.lit(False)).alias("peer_outlier_flag"),
        "department",
        numbers.round_half_up(F.col("department_failed_login_percentile"), 4).alias("department_failed_login_percentile"),
        numbers.round_half_up(F.col("peer_failed_login_median"), 4).alias("peer_failed_login_median"))


def first_sequences(sequences: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` sequences per entity next to the entity's total."""
    totals = sequences.groupBy("entity_id").agg(F.count("*").alias("sequence_count"))
    top = top_per_group(sequences, ["entity_id"], ["start_time", "sequence_id"], n)
    return top.select("entity_id", "rank", "sequence_id", "sequence_type", "event_count").join(totals, "entity_id")


def evidence_by_source(evidence: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` evidence events per entity and source."""
    return top_per_group(evidence, ["entity_id", "source_dataset"], ["event_id"], n).select(
        "entity_id", "source_dataset", "rank", "event_id", "severity", "action")


# Edge types that lead to an address.
SHARED_ADDRESS_TYPES = ["CONNECTED_FROM_IP", "COMMUNICATED_WITH_IP"]


def shared_address_connections(edges: DataFrame) -> DataFrame:
    """The address links themselves, one row for each end of an edge."""
    hit = edges.where(F.col("relationship_type").isin(SHARED_ADDRESS_TYPES))
    ends = F.array(F.struct(F.col("source_id").alias("e"), F.col("target_id").alias("o")), F.struct(F.col("target_id").alias("e"), F.col("source_id").alias("o")))
    return hit.withColumn("_x", F.explode(ends)).select(
        F.col("_x.e").alias("entity_id"), "edge_id", "relationship_type", F.col("_x.o").alias("neighbor"),
        "relationship_confidence", "source_dataset", "source_record_id")


def shared_address_links(edges: DataFrame) -> DataFrame:
    """Address links per entity: each edge is seen from both of its ends."""
    hit = edges.where(F.col("relationship_type").isin(SHARED_ADDRESS_TYPES))
    return hit.select(F.explode(F.array("source_id", "target_id")).alias("entity_id"), "relationship_type").groupBy(
        "entity_id").agg(
        F.count("*").alias("shared_ip_count"),
        F.count_if(F.col("relationship_type") == "CONNECTED_FROM_IP").alias("session_links"),
        F.count_if(F.col("relationship_type") == "COMMUNICATED_WITH_IP").alias("flow_links"))


def high_risk_entities(
    risk: DataFrame, level: str | None = "CRITICAL", department: str | None = None, n: int = 20
) -> DataFrame:
    df = choose(risk, risk_level=[level] if level else None, department=[department] if department else None)
    return df.orderBy(F.desc("risk_score"), "entity_id").limit(n).select(
        "entity_id", "department", "risk_score", "risk_level", "risk_confidence_level")


def strongest_signal(contributors: DataFrame) -> DataFrame:
    """Largest contribution per entity; ties go to the first in fixed order."""
    names = ["auth", "network", "endpoint", "operational"]
    values = [F.col(f"{n}_contribution") for n in names]
    top = F.greatest(*values)
    which = F.lit(names[-1])
    for n, v in list(zip(names, values))[-2::-1]:
        which = F.when(v == top, n).otherwise(which)
    return contributors.select("entity_id", "entity_type", which.alias("strongest_signal"), top.alias("points"))


def timelines(events: DataFrame, key: str, n: int = 20) -> DataFrame:
    """First ``n`` events in time order per entity."""
    known = events.where(F.col(key).isNotNull() & F.col("event_timestamp").isNotNull())
    return top_per_group(known, [key], ["event_timestamp", "event_id"], n).select(
        F.col(key).alias("entity_id"), "rank", "event_id",
        times.as_text(F.col("event_timestamp")).alias("event_timestamp"), "source_dataset", "event_category", "action")


# --- fixed values: lineage text per record kind ---------------------------------
LINEAGE = {
    "User Identity": ("identity, iam, endpoint", "clean_identity", "canonical_users", "user_features", "user_risk"),
    "Host Device": ("identity, endpoint, firewall", "clean_identity, clean_endpoint", "canonical_hosts",
                    "host_features", "host_risk"),
    "Temporal Sequence": ("iam, endpoint, firewall", "clean_iam, clean_endpoint, clean_firewall", "canonical_events",
                          "temporal_sequences", "temporal_bursts"),
    "Canonical Event": ("iam, endpoint, firewall", "clean_iam, clean_endpoint, clean_firewall", "canonical_events",
                        "event_features", "normalized_evidence"),
}


def provenance(
    ids: DataFrame, user_risk: DataFrame, host_risk: DataFrame, sequences: DataFrame, events: DataFrame
) -> DataFrame:
    """Lineage record per requested id (column entity_id).

    An id known to several kinds takes the first: user, host, sequence, event.
    """
    wanted = ids.select("entity_id").distinct()
    none = F.lit(None)

    def kind(df: DataFrame, rank: int, name: str, key: str, score: Column, level: Column, status: Column) -> DataFrame:
        source, clean, canonical, feature, risk = (F.lit(x) for x in LINEAGE[name])
        return df.select(F.col(key).alias("entity_id"), F.struct(
            F.lit(rank).alias("rank"), F.lit(name).alias("entity_type"), source.alias("source_datasets"),
            clean.alias("cleaned_table"), canonical.alias("canonical_table"), feature.alias("feature_table"),
            risk.alias("risk_table"), score.cast("double").alias("risk_score"), level.cast("string").alias("risk_level"),
            status.alias("data_quality_status"),
        ).alias("r")).join(wanted, "entity_id", "left_semi")

    found = reduce(DataFrame.unionByName, [
        kind(user_risk, 0, "User Identity", "entity_id", F.col("risk_score"), F.col("risk_level"), F.lit("REPAIRED & VALIDATED")),
        kind(host_risk, 1, "Host Device", "entity_id", F.col("risk_score"), F.col("risk_level"),
             F.lit("CANONICALIZED & VALIDATED")),
        kind(sequences, 2, "Temporal Sequence", "sequence_id", none, none, F.lit("TEMPORALLY CHAINED")),
        kind(events, 3, "Canonical Event", "event_id", none, none, F.col("data_quality_status")),
    ]).groupBy("entity_id").agg(F.min("r").alias("r"))
    return wanted.join(found, "entity_id", "left").select(
        "entity_id", F.col("r").isNotNull().alias("found"), "r.entity_type", "r.source_datasets", "r.cleaned_table",
        "r.canonical_table", "r.feature_table", "r.risk_table", "r.risk_score", "r.risk_level", "r.data_quality_status")


def evidence_packages(
    risk: DataFrame, profiles: DataFrame, peers: DataFrame, sequences: DataFrame, evidence: DataFrame, edges: DataFrame
) -> DataFrame:
    """One nested row per entity: risk, behaviour, peers, first sequences and
    evidence events, and its degree in the graph. All lists are top-n lists."""
    seq = first_sequences(sequences).groupBy("entity_id").agg(
        F.first("sequence_count").alias("sequence_count"),
        F.array_sort(F.collect_list(F.struct("rank", "sequence_id", "sequence_type"))).alias("sequences"))
    ev = evidence_by_source(evidence).groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct("source_dataset", "rank", "event_id"))).alias("evidence_records"))
    degree = edges.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).groupBy("entity_id").agg(
        F.count("*").alias("edge_count"))
    df = risk.select("entity_id", F.struct(
        "entity_type", "risk_score", "risk_level", "risk_confidence_score", "risk_confidence_level", "department",
        "primary_hypothesis", "counter_evidence").alias("risk_assessment"))
    for part in (
        profiles.select("entity_id", F.struct("cluster_label", "observed_values", "z_deviations").alias("behavior_profile")),
        peers.select("entity_id", F.struct("peer_outlier_flag", "department_failed_login_percentile").alias("peer_comparison")),
        seq, ev, degree,
    ):
        df = df.join(part, "entity_id", "left")
    return df.fillna(0, ["sequence_count", "edge_count"])


def resolve_entities(terms: DataFrame, users: DataFrame, hosts: DataFrame, sequences: DataFrame, n: int = 5) -> DataFrame:
    """Resolve query terms (column term) against users, hosts and sequences.

    Exact user, exact host, exact sequence, then users whose id or department
    contains the term. Containment is an equi-join on the substrings of the
    (short) ids and department names; no term meets every user.
    """
    t = terms.select(F.upper(text.trimmed(F.col("term"))).alias("q")).where(F.col("q").isNotNull()).distinct()

    def exact(df: DataFrame, key: str, rank: int, kind: str) -> DataFrame:
        return df.select(F.upper(key).alias("q"), F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                                                           F.upper(key).alias("id")).alias("hit"))

    hits = reduce(DataFrame.unionByName, [
        exact(users, "entity_id", 0, "user"), exact(hosts, "entity_id", 1, "host"),
        exact(sequences, "sequence_id", 2, "sequence"),
    ]).join(t, "q", "left_semi").groupBy("q").agg(F.min("hit").alias("hit"))
    open_terms = t.join(hits, "q", "left_anti")

    ids = users.select(F.upper("entity_id").alias("id"), F.upper("department").alias("dept"))
    # only pieces as long as some open term can match; no more lengths than the longest id has letters
    longest = ids.agg(F.max(F.length("id"))).first()[0] or 0
    found = open_terms.select(F.length("q").alias("k")).where(F.col("k") <= longest).distinct().collect()
    by_id = ids.select("id", F.explode(pieces("id", sorted(r.k for r in found))).alias("q")).join(open_terms, "q", "left_semi")
    heads = top_per_group(ids, ["dept"], ["id"], n).select("id", "dept")
    names = ids.select("dept").distinct().select("dept", F.explode(substrings("dept")).alias("q")).join(
        open_terms, "q", "left_semi")
    by_dept = names.join(heads, "dept").select("id", "q")
    partial = top_per_group(by_id.select("id", "q").unionByName(by_dept).distinct(), ["q"], ["id"], n).groupBy("q").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    joined = t.join(hits, "q", "left").join(partial, "q", "left")
    one = F.col("n") == 1
    return joined.select(
        F.col("q").alias("term"),
        F.when(F.col("hit").isNotNull() | one, "RESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("NOT_FOUND").alias("status"),
        F.coalesce(F.col("hit.kind"), F.when(one, "user")).alias("entity_type"),
        F.coalesce(F.col("hit.id"), F.when(one, F.col("ids")[0])).alias("entity_id"),
        F.when(F.col("n") > 1, F.array_join("ids", "; ")).alias("candidates"))


def pieces(column: str, sizes: list[int]) -> Column:
    """All distinct substrings of a text that have one of the given lengths."""
    if not sizes:
        return F.array().cast("array<string>")
    text_of, n = F.col(column), F.length(column)
    fit = F.filter(F.array(*map(F.lit, sizes)), lambda k: k <= n)
    return F.array_distinct(F.flatten(F.transform(fit, lambda k: F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text_of, i, k)))))


def substrings(column: str) -> Column:
    """All distinct non-empty substrings of a short text."""
    return F.expr(
        f"array_distinct(flatten(transform(sequence(1, length({column})), i -> "
        f"transform(sequence(1, length({column}) - i + 1), k -> substring({column}, i, k)))))")


# --- standing dashboard questions ----------------------------------------------------


def _day(c: str) -> Column:
    return F.date_format(F.col(c), "yyyy-MM-dd")


def failed_logins_by_department_day(iam: DataFrame) -> DataFrame:
    return iam.where((F.col("event_type") == "login_failed") & F.col("timestamp").isNotNull()).groupBy(
        _day("timestamp").alias("day"), F.coalesce("department", F.lit("Unknown")).alias("department")).agg(
        F.count("*").alias("failed_logins"))


def top_users_by_failed_logins(iam: DataFrame, n: int = 20) -> DataFrame:
    failed = iam.where((F.col("event_type") == "login_failed") & F.col("user_id").isNotNull())
    return failed.groupBy("user_id").agg(F.count("*").alias("failed_logins")).orderBy(
        F.desc("failed_logins"), "user_id").limit(n)


def alerts_by_severity(endpoint: DataFrame) -> DataFrame:
    return endpoint.groupBy("alert_name", F.coalesce("severity", F.lit("Unknown")).alias("severity")).agg(
        F.count("*").alias("alerts"))


def deny_trend_by_protocol(firewall: DataFrame) -> DataFrame:
    return firewall.where((F.col("action") == "DENY") & F.col("timestamp").isNotNull()).groupBy(
        _day("timestamp").alias("day"), F.coalesce("protocol", F.lit("Unknown")).alias("protocol")).agg(
        F.count("*").alias("denies"))


def actions_by_protocol(firewall: DataFrame) -> DataFrame:
    return firewall.groupBy(F.coalesce("protocol", F.lit("Unknown")).alias("protocol")).agg(
        F.count_if(F.col("action") == "ALLOW").alias("allowed"), F.count_if(F.col("action") == "DENY").alias("denied"))


def hosts_by_threat_flags(firewall: DataFrame, n: int = 20) -> DataFrame:
    return firewall.where(F.col("threat_flag") & F.col("hostname").isNotNull()).groupBy("hostname").agg(
        F.count("*").alias("threat_flags")).orderBy(F.desc("threat_flags"), "hostname").limit(n)


def mfa_failure_trend(iam: DataFrame) -> DataFrame:
    return iam.where(~F.col("mfa_passed") & F.col("timestamp").isNotNull()).groupBy(
        _day("timestamp").alias("day")).agg(F.count("*").alias("mfa_failures"))


def users_with_failures_and_alerts(features: DataFrame, least: int = 2) -> DataFrame:
    return features.where((F.col("failed_login_count") >= least) & (F.col("endpoint_alert_count") > 0)).select(
        "user_id", "failed_login_count", "endpoint_alert_count")


def critical_alerts_by_day(endpoint: DataFrame) -> DataFrame:
    return endpoint.where((F.col("severity") == "Critical") & F.col("detected_timestamp").isNotNull()).groupBy(
        _day("detected_timestamp").alias("day")).agg(F.count("*").alias("critical_alerts"))
