"""Security features per user, host, session and event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, times
from .canonical import host_names
from .joins import with_distinct_counts
from .robust import percentile_rank

USER_COUNTS = [
    "authentication_event_count", "failed_login_count", "successful_login_count", "mfa_failure_count",
    "unique_source_ip_count", "session_count", "unknown_evidence_count", "off_hours_activity_count",
    "endpoint_alert_count", "critical_endpoint_alert_count", "high_endpoint_alert_count",
    "medium_endpoint_alert_count", "low_endpoint_alert_count", "unique_host_count",
]
HOST_COUNTS = [
    "firewall_event_count", "firewall_deny_count", "threat_flag_count", "unique_source_ip_count",
    "unique_destination_ip_count", "session_count", "endpoint_alert_count", "critical_endpoint_alert_count",
]


def user_features(identity: DataFrame, iam: DataFrame, endpoint: DataFrame) -> DataFrame:
    """One row per identity user: 14 counts, two rates, evidence, percentile."""
    known = iam.where(F.col("user_id").isNotNull())
    auth = known.groupBy("user_id").agg(
        F.count("*").alias("authentication_event_count"),
        F.count_if(F.col("event_type") == "login_failed").alias("failed_login_count"),
        F.count_if(F.col("event_type") == "login_success").alias("successful_login_count"),
        F.count_if(~F.col("mfa_passed")).alias("mfa_failure_count"),
        F.count_if(F.col("data_quality_status") == "UNKNOWN").alias("unknown_evidence_count"),
        F.count_if(times.off_hours(F.col("timestamp"))).alias("off_hours_activity_count"),
        F.max("risk_numeric").alias("source_risk_max"),
    )
    auth = with_distinct_counts(auth, known, "user_id", {"unique_source_ip_count": "source_ip", "session_count": "session_id"})
    alerts = endpoint.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("*").alias("endpoint_alert_count"),
        *[
            F.count_if(F.col("severity") == s).alias(f"{s.lower()}_endpoint_alert_count")
            for s in ("Critical", "High", "Medium", "Low")
        ],
        F.count_distinct("hostname").alias("unique_host_count"),
    )
    base = identity.select(
        "user_id",
        *[F.coalesce(F.col(c), F.lit("Unknown")).alias(c) for c in ("username", "department", "status", "hostname")],
    )
    df = base.join(auth, "user_id", "left").join(alerts, "user_id", "left").fillna(0, USER_COUNTS)
    events, failed = F.col("authentication_event_count"), F.col("failed_login_count")
    evidence = events + F.col("endpoint_alert_count")
    df = df.withColumns({
        "authentication_failure_rate": numbers.ratio(failed, events),
        "mfa_failure_rate": numbers.ratio(F.col("mfa_failure_count"), failed),
        "evidence_count": evidence,
        "valid_evidence_count": evidence - F.col("unknown_evidence_count"),
        "feature_confidence": F.when(evidence > 0, "EXACT").otherwise("UNMATCHED"),
    })
    return percentile_rank(df, "department", "failed_login_count", "department_failed_login_percentile")


def host_features(identity: DataFrame, endpoint: DataFrame, firewall: DataFrame) -> DataFrame:
    flows = firewall.where(F.col("hostname").isNotNull())
    fw = flows.groupBy("hostname").agg(
        F.count("*").alias("firewall_event_count"),
        F.count_if(F.col("action") == "DENY").alias("firewall_deny_count"),
        F.count_if(F.col("threat_flag")).alias("threat_flag_count"),
        F.sum("bytes_sent").alias("bytes_sent"),
        F.sum("bytes_received").alias("bytes_received"),
    )
    fw = with_distinct_counts(fw, flows, "hostname", {
        "unique_source_ip_count": "src_ip", "unique_destination_ip_count": "dst_ip", "session_count": "session_id"})
    ep = endpoint.where(F.col("hostname").isNotNull()).groupBy("hostname").agg(
        F.count("*").alias("endpoint_alert_count"),
        F.count_if(F.col("severity") == "Critical").alias("critical_endpoint_alert_count"),
    )
    df = (
        host_names(identity, firewall, endpoint)
        .join(fw, "hostname", "left")
        .join(ep, "hostname", "left")
        .fillna(0, [*HOST_COUNTS, "bytes_sent", "bytes_received"])
    )
    return df.withColumns({
        "firewall_deny_ratio": numbers.ratio(F.col("firewall_deny_count"), F.col("firewall_event_count")),
        "evidence_count": F.col("firewall_event_count") + F.col("endpoint_alert_count"),
        "feature_confidence": F.when(F.col("is_managed"), "EXACT").otherwise("PROBABLE"),
    })


def session_features(iam: DataFrame, firewall: DataFrame) -> DataFrame:
    a = iam.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.count("*").alias("iam_event_count"),
        F.bool_or(F.col("event_type") == "login_failed").alias("has_failed_login"),
    )
    b = firewall.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.count("*").alias("firewall_log_count"),
        F.bool_or(F.coalesce(F.col("action") == "DENY", F.lit(False))).alias("has_firewall_deny"),
        F.bool_or(F.coalesce(F.col("threat_flag"), F.lit(False))).alias("has_threat_flag"),
    )
    df = a.join(b, "session_id", "full_outer")
    df = df.fillna(0, ["iam_event_count", "firewall_log_count"]).fillna(
        False, ["has_failed_login", "has_firewall_deny", "has_threat_flag"])
    in_iam, in_fw = F.col("iam_event_count") > 0, F.col("firewall_log_count") > 0
    status = F.when(in_iam & in_fw, "EXACT").otherwise("UNMATCHED")
    return df.withColumns({
        "present_in_iam": in_iam,
        "present_in_firewall": in_fw,
        "match_status": status,
        "session_event_count": F.col("iam_event_count") + F.col("firewall_log_count"),
        "feature_confidence": status,
    })


def event_features(events: DataFrame, endpoint: DataFrame) -> DataFrame:
    """Off-hours, chronology and confidence flags per canonical event.

    Only endpoint alerts can have reversed times, so only they are joined.
    """
    keep = [
        "event_id", "source_dataset", "source_record_id", "event_category", "event_type", "severity", "action",
        "user_id", "hostname", "session_id", "data_quality_status",
    ]
    base = events.select(
        *keep,
        F.coalesce(times.off_hours(F.col("event_timestamp")), F.lit(False)).alias("is_off_hours"),
        F.when(F.col("data_quality_status") == "VALID", "EXACT").otherwise("PROBABLE").alias("feature_confidence"),
    )
    alert = F.col("source_dataset") == "Endpoint"
    reversed_alerts = endpoint.where("chronology_issue").select(F.col("alert_id").alias("event_id")).distinct()
    flagged = base.where(alert).join(reversed_alerts.withColumn("_r", F.lit(True)), "event_id", "left")
    marked = flagged.withColumn("is_chronology_anomaly", F.col("_r").isNotNull()).drop("_r")
    return marked.unionByName(base.where(~alert).withColumn("is_chronology_anomaly", F.lit(False)))
