"""Canonical events, users, hosts, sessions and relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text, times
from .joins import mark_join

EVENT_COLUMNS = [
    "event_id", "event_timestamp", "event_type", "event_category", "user_id", "hostname", "device_id",
    "session_id", "source_ip", "destination_ip", "department", "severity", "action", "source_dataset",
    "source_record_id", "data_quality_status", "resolution_confidence",
]

SOURCES = ["IAM", "Endpoint", "Firewall"]  # of the events made here
CATEGORIES = ["AUTHENTICATION", "ENDPOINT_ALERT", "NETWORK_FLOW"]


def _event_row(**given: Column) -> list[Column]:
    return [given.get(n, F.lit(None).cast("string")).alias(n) for n in EVENT_COLUMNS]


def canonical_events(identity: DataFrame, iam: DataFrame, endpoint: DataFrame, firewall: DataFrame) -> DataFrame:
    """One row per source record in a shared 17-column form."""
    return reduce(DataFrame.unionByName, event_parts(identity, iam, endpoint, firewall).values())


def event_parts(identity: DataFrame, iam: DataFrame, endpoint: DataFrame, firewall: DataFrame) -> dict[str, DataFrame]:
    """The events of each source by its name.

    Membership in the identity master is a mark join per source, so that sources
    without a user never enter the user join.
    """
    known = F.lit("Unknown")
    a = mark_join(iam, "user_id", identity, "user_id", "_user", "event_id").select(*_event_row(
        event_id=F.col("event_id"),
        event_timestamp=F.col("timestamp"),
        event_type=F.col("event_type"),
        event_category=F.lit("AUTHENTICATION"),
        user_id=F.col("user_id"),
        hostname=F.col("hostname"),
        device_id=F.col("device_id"),
        session_id=F.col("session_id"),
        source_ip=F.col("source_ip"),
        department=F.col("department"),
        severity=text.replace_labels(F.col("risk_label"), ["Missing", "Invalid"], "Info"),
        action=F.upper("event_type"),
        source_dataset=F.lit("IAM"),
        source_record_id=F.col("event_id"),
        data_quality_status=F.col("data_quality_status"),
        resolution_confidence=F.when(F.col("_user"), "EXACT").otherwise("UNMATCHED"),
    ))
    marked = mark_join(endpoint, "user_id", identity, "user_id", "_user", "alert_id")
    marked = mark_join(marked, "hostname", identity, "hostname", "_host", "alert_id")
    b = marked.select(*_event_row(
        event_id=F.col("alert_id"),
        event_timestamp=F.col("detected_timestamp"),
        event_type=F.coalesce(F.col("alert_name"), known),
        event_category=F.lit("ENDPOINT_ALERT"),
        user_id=F.col("user_id"),
        hostname=F.col("hostname"),
        severity=F.coalesce(F.col("severity"), known),
        action=F.lit("ALERT_TRIGGERED"),
        source_dataset=F.lit("Endpoint"),
        source_record_id=F.col("alert_id"),
        data_quality_status=F.when(F.col("resolved_timestamp").isNull(), "UNKNOWN").otherwise("VALID"),
        resolution_confidence=F.when(F.col("_user") & F.col("_host"), "EXACT").otherwise("PROBABLE"),
    ))
    action = F.coalesce(F.col("action"), known)
    c = mark_join(firewall, "hostname", identity, "hostname", "_host", "log_id").select(*_event_row(
        event_id=F.col("log_id"),
        event_timestamp=F.col("timestamp"),
        event_type=F.concat_ws("_", F.coalesce(F.col("protocol"), known), action),
        event_category=F.lit("NETWORK_FLOW"),
        hostname=F.col("hostname"),
        session_id=F.col("session_id"),
        source_ip=F.col("src_ip"),
        destination_ip=F.col("dst_ip"),
        severity=F.when(F.col("threat_flag"), "High").otherwise("Low"),
        action=action,
        source_dataset=F.lit("Firewall"),
        source_record_id=F.col("log_id"),
        data_quality_status=F.when(F.col("timestamp").isNull(), "UNKNOWN").otherwise("VALID"),
        resolution_confidence=F.when(F.col("_host"), "PROBABLE").otherwise("UNMATCHED"),
    ))
    return {"IAM": a, "Endpoint": b, "Firewall": c}


def event_times(iam: DataFrame, endpoint: DataFrame, firewall: DataFrame | None = None) -> DataFrame:
    """User, host and time of every event, for counts of observations; nothing is joined or written.

    Firewall events bear no user, so that counts per user need none of them.
    """
    def part(df: DataFrame, user: Column, ts: str) -> DataFrame:
        return df.select(user.alias("user_id"), "hostname", F.col(ts).alias("event_timestamp"))

    both = part(iam, F.col("user_id"), "timestamp").unionByName(part(endpoint, F.col("user_id"), "detected_timestamp"))
    return both if firewall is None else both.unionByName(part(firewall, F.lit(None).cast("string"), "timestamp"))


def events_to_analytical(events: DataFrame) -> DataFrame:
    cells = {n: F.col(n) for n in EVENT_COLUMNS}
    cells["event_timestamp"] = times.as_text(F.col("event_timestamp"))
    return events.select(*[F.coalesce(c, F.lit("Unknown")).alias(n) for n, c in cells.items()])


def canonical_users(identity: DataFrame, iam: DataFrame, endpoint: DataFrame) -> DataFrame:
    """Identity rows with activity counts and the composite threat score."""
    auth = iam.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("*").alias("total_iam_events"),
        F.count_if(F.col("event_type") == "login_failed").alias("failed_logins"),
        F.avg("risk_score").alias("avg_risk_score"),
    )
    alerts = endpoint.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("*").alias("total_endpoint_alerts"),
        F.count_if(F.col("severity") == "Critical").alias("critical_alerts"),
        F.count_if(F.col("severity") == "High").alias("high_alerts"),
    )
    counts = ["total_iam_events", "failed_logins", "total_endpoint_alerts", "critical_alerts", "high_alerts"]
    df = identity.join(auth, "user_id", "left").join(alerts, "user_id", "left").fillna(0, [*counts, "avg_risk_score"])
    score = (
        F.col("failed_logins") * 2.0 + F.col("critical_alerts") * 5.0
        + F.col("high_alerts") * 3.0 + F.col("avg_risk_score") * 0.5
    )
    return df.withColumn("insider_threat_score", numbers.round_half_up(score, 4))


def host_names(identity: DataFrame, firewall: DataFrame, endpoint: DataFrame) -> DataFrame:
    """Distinct host names of the three sources with the managed flag.

    Each source is reduced to its distinct names before the union.
    """
    parts = [
        df.where(F.col("hostname").isNotNull()).select("hostname").distinct().withColumn("_m", F.lit(managed))
        for df, managed in ((identity, True), (firewall, False), (endpoint, False))
    ]
    names = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return names.groupBy("hostname").agg(F.bool_or("_m").alias("is_managed"))


def canonical_hosts(identity: DataFrame, firewall: DataFrame, endpoint: DataFrame) -> DataFrame:
    fw = firewall.where(F.col("hostname").isNotNull()).groupBy("hostname").agg(
        F.count("*").alias("total_firewall_logs"),
        F.count_if(F.col("action") == "DENY").alias("firewall_denies"),
        F.count_if(F.col("threat_flag")).alias("threat_flags"),
    )
    ep = endpoint.where(F.col("hostname").isNotNull()).groupBy("hostname").agg(F.count("*").alias("endpoint_alerts"))
    counts = ["total_firewall_logs", "firewall_denies", "threat_flags", "endpoint_alerts"]
    hosts = host_names(identity, firewall, endpoint)
    return hosts.join(fw, "hostname", "left").join(ep, "hostname", "left").fillna(0, counts)


def canonical_sessions(iam: DataFrame, firewall: DataFrame) -> DataFrame:
    """Sessions seen in either source; EXACT when both have it."""
    def keys(df: DataFrame, source: str) -> DataFrame:
        return df.where(F.col("session_id").isNotNull()).select("session_id").distinct().withColumn("_s", F.lit(source))

    both = keys(iam, "iam").unionByName(keys(firewall, "firewall")).groupBy("session_id").agg(
        F.bool_or(F.col("_s") == "iam").alias("present_in_iam"),
        F.bool_or(F.col("_s") == "firewall").alias("present_in_firewall"),
    )
    exact = F.col("present_in_iam") & F.col("present_in_firewall")
    return both.withColumn("match_status", F.when(exact, "EXACT").otherwise("UNMATCHED"))


def canonical_relationships(identity: DataFrame, endpoint: DataFrame, firewall: DataFrame) -> DataFrame:
    """User-host, user-alert and host-address links, one row per source record."""
    def rel(df, source, source_type, name, target, target_type, confidence, provenance):
        return df.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(
            F.col(source).alias("source_node"),
            F.lit(source_type).alias("source_type"),
            F.lit(name).alias("relationship"),
            F.col(target).alias("target_node"),
            F.lit(target_type).alias("target_type"),
            F.lit(confidence).alias("confidence"),
            F.lit(provenance).alias("provenance"),
        )

    return (
        rel(identity, "user_id", "USER", "OWN_DEVICE", "hostname", "HOST", "EXACT", "Identity_Master")
        .unionByName(rel(endpoint, "user_id", "USER", "TRIGGERED_ALERT", "alert_id", "ALERT", "EXACT", "Endpoint_Alerts"))
        .unionByName(rel(firewall, "hostname", "HOST", "COMMUNICATED_WITH", "dst_ip", "IP", "PROBABLE", "Firewall_Logs"))
    )
