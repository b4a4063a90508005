"""Cleaning of the four raw telemetry tables.

Each source has a parse step (exact duplicates removed, every field typed, SQL
NULL for anything unusable) and a finish step (imputation and quality flags).
Sentinel words such as ``Unknown`` are applied only by :func:`to_analytical`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import network, numbers, text, times
from ..session import cut
from .robust import global_medians, require

REPEATS = 2_000_000  # hashes of repeated rows that are broadcast

# Final column names of the exported tables.
IDENTITY_COLUMNS = [
    "user_id", "username", "department", "status", "hire_date", "termination_date", "manager_username",
    "device_id", "location", "hostname", "full_name", "role",
]
IAM_COLUMNS = [
    "event_id", "timestamp", "user_id", "username", "department", "event_type", "auth_method", "source_ip",
    "hostname", "device_id", "session_id", "mfa_passed", "failure_reason", "risk_score", "risk_score_raw",
    "risk_score_numeric", "risk_score_valid", "risk_label", "risk_quality_flag", "geo_location",
    "data_quality_status", "is_imputed", "is_repaired",
]
ENDPOINT_COLUMNS = [
    "alert_id", "detected_timestamp", "resolved_timestamp", "hostname", "user_id", "endpoint_product",
    "alert_name", "severity", "status", "description", "file_path", "process_name", "sha256", "assigned_to",
    "device_criticality", "severity_rank", "resolution_duration_hours",
]
FIREWALL_COLUMNS = [
    "log_id", "timestamp", "hostname", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "action",
    "bytes_sent", "bytes_received", "session_id", "threat_flag", "rule_name", "geo_country",
]


def _deduplicated_text(raw: DataFrame, trim: list[str], na_words: bool = False) -> DataFrame:
    """Whole-row duplicates dropped, then the named columns trimmed.

    Trimming is a projection of its own, so the parsers that follow read plain
    columns instead of repeating the trim inside every pattern test.
    """
    clean = text.drop_na_words if na_words else text.trimmed
    return distinct_rows(raw).withColumns({c: clean(F.col(c)) for c in trim})


def distinct_rows(df: DataFrame, most: int = REPEATS) -> DataFrame:
    """Each whole row once.

    A row whose hash no other row has is unique as it is and stays where it is read. Rows of a repeated hash are compared
    whole, so hashes that collide lose nothing. The repeated hashes are broadcast. Where there are more than ``most``, or
    where one piece of the input holds twice the even share of a core, all rows are dealt by hash and compared.
    """
    row = F.xxhash64(*df.columns)
    hashed = df.withColumn("_h", row)
    dealt = hashed.repartition("_h").dropDuplicates().drop("_h")
    pieces = df.groupBy(F.spark_partition_id().alias("_p")).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
    if (pieces["most"] or 0) * df.sparkSession.sparkContext.defaultParallelism > 2 * (pieces["all"] or 0):
        return dealt
    repeated = cut(df.groupBy(row.alias("_h")).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_h").alias("_r")))
    if repeated.count() > most:
        return dealt
    met = hashed.join(F.broadcast(repeated), F.col("_h") == F.col("_r"), "left")
    again = hashed.join(F.broadcast(repeated), F.col("_h") == F.col("_r"), "left_semi")
    return met.where(F.col("_r").isNull()).select(*df.columns).unionByName(again.select(*df.columns).dropDuplicates())


# --- identity -------------------------------------------------------------------


def clean_identity(raw: DataFrame) -> DataFrame:
    df = _deduplicated_text(raw, ["hire_date", "termination_date"])
    return df.select(
        text.user_id(F.col("user_id")).alias("user_id"),
        text.lower_text(F.col("username")).alias("username"),
        text.department(F.col("department")).alias("department"),
        text.employment_status(F.col("status")).alias("status"),
        times.parse_identity_date(F.col("hire_date")).alias("hire_date"),
        times.parse_identity_date(F.col("termination_date")).alias("termination_date"),
        text.lower_text(F.col("manager_username")).alias("manager_username"),
        text.upper_text(F.col("device_id")).alias("device_id"),
        text.squeeze(F.col("location")).alias("location"),
        text.hostname(F.col("hostname")).alias("hostname"),
        "full_name",
        "role",
    )


# --- iam -------------------------------------------------------------------------

_IAM_TEXT = [
    "user_id", "username", "department", "event_type", "auth_method", "source_ip", "hostname", "device_id",
    "session_id", "geo_location", "failure_reason", "timestamp",
]


def parse_iam(raw: DataFrame) -> DataFrame:
    df = numbers.with_risk(_deduplicated_text(raw, _IAM_TEXT, na_words=True), "risk_score").withColumns({
        "_user": text.user_id(F.col("user_id"), keep_unmatched=True), "_host": text.hostname(F.col("hostname"))})
    user, host = F.col("_user"), F.col("_host")
    event = text.login_event(F.col("event_type"))
    return df.select(
        "event_id",
        times.parse_timestamp(F.col("timestamp"), day_first=False).alias("timestamp"),
        user.alias("user_id"),
        "username",
        text.department(F.col("department"), on_unmapped="keep").alias("department"),
        event.alias("event_type"),
        text.auth_method(F.col("auth_method")).alias("auth_method"),
        network.ip_text(F.col("source_ip")).alias("source_ip"),
        host.alias("hostname"),
        "device_id",
        "session_id",
        text.auth_boolean(F.col("mfa_passed")).alias("mfa_passed"),
        text.failure_reason(F.col("failure_reason")).alias("failure_reason"),
        "risk_raw", "risk_numeric", "risk_valid", "risk_label", "risk_flag", "risk_imputed",
        "geo_location",
        (changed(F.col("user_id"), user) | changed(F.col("hostname"), host)).alias("is_repaired"),
    )


def changed(raw: Column, clean: Column) -> Column:
    """True where cleaning altered the value or there was no value."""
    return raw.isNull() | ~raw.eqNullSafe(clean)


def finish_iam(parsed: DataFrame, risk_median: float | None = None) -> DataFrame:
    """Impute the risk score by the median of valid scores and flag quality."""
    if risk_median is None:
        risk_median = global_medians(parsed, ["risk_numeric"])["risk_numeric"]
    fallback = 50.0 if risk_median is None else risk_median
    failed = F.col("event_type") == "login_failed"
    reason = F.coalesce(F.col("failure_reason"), F.when(~failed, F.lit("Not Applicable")))
    status = quality_status(
        unknown=F.col("timestamp").isNull() | F.col("source_ip").isNull(),
        repaired=F.col("is_repaired"),
        imputed=F.col("risk_imputed"),
    )
    return parsed.withColumns({
        "failure_reason": reason,
        "risk_score": F.coalesce(F.col("risk_numeric"), F.lit(float(fallback))),
        "data_quality_status": status,
    })


def quality_status(unknown: Column, repaired: Column, imputed: Column) -> Column:
    return (
        F.when(unknown, "UNKNOWN").when(repaired, "REPAIRED").when(imputed, "IMPUTED").otherwise("VALID")
    )


# --- endpoint ---------------------------------------------------------------------


def parse_endpoint(raw: DataFrame) -> DataFrame:
    df = _deduplicated_text(raw, ["detected_timestamp", "resolved_timestamp"]).withColumns({
        "detected_timestamp": times.parse_timestamp(F.col("detected_timestamp")),
        "resolved_timestamp": times.parse_timestamp(F.col("resolved_timestamp")),
        "severity": text.severity(F.col("severity")),
    })
    start, end = F.col("detected_timestamp"), F.col("resolved_timestamp")
    return df.select(
        "alert_id",
        "detected_timestamp",
        "resolved_timestamp",
        text.hostname(F.col("hostname")).alias("hostname"),
        text.user_id(F.col("user_id")).alias("user_id"),
        "endpoint_product",
        "alert_name",
        "severity",
        text.alert_status(F.col("status")).alias("status"),
        "description",
        "file_path",
        "process_name",
        text.sha256_clean(F.col("sha256")).alias("sha256"),
        "assigned_to",
        text.criticality(F.col("device_criticality")).alias("device_criticality"),
        text.severity_rank(F.col("severity")).alias("severity_rank"),
        times.hours_between(start, end).alias("duration_hours"),
        times.ends_before_start(start, end).alias("chronology_issue"),
    )


def finish_endpoint(parsed: DataFrame, duration_median: float | None = None) -> DataFrame:
    """Impute the resolution time by the median of valid durations."""
    if duration_median is None:
        duration_median = require(global_medians(parsed, ["duration_hours"]))["duration_hours"]
    hours = F.coalesce(F.col("duration_hours"), F.lit(duration_median))
    return parsed.withColumn("resolution_duration_hours", numbers.round_half_up(hours, 2))


# --- firewall ----------------------------------------------------------------------

_FIREWALL_MEDIANS = ["src_port", "dst_port", "bytes_sent", "bytes_received"]


def parse_firewall(raw: DataFrame) -> DataFrame:
    df = _deduplicated_text(raw, ["timestamp", "src_ip", "dst_ip", *_FIREWALL_MEDIANS])
    return df.select(
        "log_id",
        times.parse_timestamp(F.col("timestamp"), day_first=False, epoch=False, to_utc=True).alias("timestamp"),
        text.hostname(F.col("hostname")).alias("hostname"),
        network.canonical_ip(F.col("src_ip")).alias("src_ip"),
        network.canonical_ip(F.col("dst_ip")).alias("dst_ip"),
        numbers.port(F.col("src_port")).alias("src_port"),
        numbers.port(F.col("dst_port")).alias("dst_port"),
        text.protocol(F.col("protocol")).alias("protocol"),
        text.firewall_action(F.col("action")).alias("action"),
        numbers.byte_size(F.col("bytes_sent")).alias("bytes_sent"),
        numbers.byte_size(F.col("bytes_received")).alias("bytes_received"),
        "session_id",
        text.boolean(F.col("threat_flag")).alias("threat_flag"),
        "rule_name",
        "geo_country",
    )


def finish_firewall(parsed: DataFrame, fill: dict[str, float] | None = None) -> DataFrame:
    """Impute ports and byte counts by the medians of their valid values."""
    fill = fill or require(global_medians(parsed, _FIREWALL_MEDIANS))
    ports = {p: F.coalesce(F.col(p), F.rint(F.lit(fill[p])).cast("int")) for p in ("src_port", "dst_port")}
    sizes = {
        b: numbers.round_half_up(F.coalesce(F.col(b), F.lit(float(fill[b]))), 2)
        for b in ("bytes_sent", "bytes_received")
    }
    return parsed.withColumns({**ports, **sizes})


# --- export form --------------------------------------------------------------------


def _bool_text(c: Column) -> Column:
    return F.when(c, "True").when(~c, "False").otherwise("Unknown")


def to_analytical(df: DataFrame, table: str) -> DataFrame:
    """Export form of a clean table: final columns, sentinels, no NULL left."""
    unknown = F.lit("Unknown")
    if table == "identity":
        left = F.col("status") == "Terminated"
        end = F.coalesce(
            times.as_text(F.col("termination_date")),
            F.when(F.coalesce(left, F.lit(False)), unknown).otherwise("Not Terminated"),
        )
        special = {"hire_date": times.as_text(F.col("hire_date")), "termination_date": end}
        names = IDENTITY_COLUMNS
    elif table == "iam":
        special = {
            "timestamp": times.as_text(F.col("timestamp")),
            "mfa_passed": _bool_text(F.col("mfa_passed")),
            "risk_score": F.col("risk_score"),
            "risk_score_raw": F.col("risk_raw"),
            "risk_score_numeric": F.col("risk_numeric").cast("string"),
            "risk_score_valid": _bool_text(F.col("risk_valid")),
            "risk_quality_flag": F.col("risk_flag"),
            "is_imputed": _bool_text(F.col("risk_imputed")),
            "is_repaired": _bool_text(F.col("is_repaired")),
        }
        names = IAM_COLUMNS
    elif table == "endpoint":
        special = {
            "detected_timestamp": times.as_text(F.col("detected_timestamp")),
            "resolved_timestamp": times.as_text(F.col("resolved_timestamp")),
            "severity_rank": F.col("severity_rank"),
            "resolution_duration_hours": F.col("resolution_duration_hours"),
        }
        names = ENDPOINT_COLUMNS
    elif table == "firewall":
        special = {
            "timestamp": times.as_text(F.col("timestamp")),
            "threat_flag": _bool_text(F.col("threat_flag")),
            **{c: F.col(c) for c in _FIREWALL_MEDIANS},
        }
        names = FIREWALL_COLUMNS
    else:
        raise ValueError(f"unknown table {table}")
    numeric = {"risk_score", "severity_rank", "resolution_duration_hours", *_FIREWALL_MEDIANS}
    return df.select(*[
        (special.get(n, F.col(n)) if n in numeric else F.coalesce(special.get(n, F.col(n)), unknown)).alias(n)
        for n in names
    ])
