"""Observation quality, peer and population baselines, deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, times
from .robust import global_stats, robust_stats

R4 = 4
USER_METRICS = {
    "failed_login_count": "failed_login",
    "authentication_failure_rate": "auth_failure_rate",
    "off_hours_activity_count": "off_hours",
    "endpoint_alert_count": "endpoint_alert",
}
USER_POPULATION = {"unique_source_ip_count": "unique_source_ip", "unique_host_count": "unique_host"}
HOST_POPULATION = {
    "firewall_deny_count": "firewall_deny",
    "firewall_deny_ratio": "firewall_deny_ratio",
    "bytes_sent": "bytes_sent",
    "bytes_received": "bytes_received",
    "unique_source_ip_count": "unique_source_ip",
    "unique_destination_ip_count": "unique_destination_ip",
    "endpoint_alert_count": "endpoint_alert",
}
OBSERVED = [
    "observation_count", "valid_timestamp_count", "distinct_active_days", "distinct_active_hours",
    "unknown_timestamp_count",
]


def observations(events: DataFrame, key: str) -> DataFrame:
    """Event counts and time coverage per entity.

    Hours are a 24-bit set, so only one true distinct count remains and the
    aggregation keeps its map-side combine.
    """
    ts = F.col("event_timestamp")
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("observation_count"),
        F.count(ts).alias("valid_timestamp_count"),
        F.count_distinct(F.to_date(ts)).alias("distinct_active_days"),
        F.coalesce(F.bit_count(F.bit_or(F.expr("shiftleft(1, hour(event_timestamp))"))), F.lit(0)).cast("bigint")
        .alias("distinct_active_hours"),
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
    ).select(
        key,
        "observation_count",
        "valid_timestamp_count",
        "distinct_active_days",
        "distinct_active_hours",
        (F.col("observation_count") - F.col("valid_timestamp_count")).alias("unknown_timestamp_count"),
        F.coalesce(
            numbers.round_half_up((times.micros(F.col("_last")) - times.micros(F.col("_first"))) / F.lit(86.4e9), 2),
            F.lit(0.0),
        ).alias("historical_span_days"),
        numbers.round_half_up(
            numbers.ratio(F.col("valid_timestamp_count"), F.col("observation_count")), R4
        ).alias("timestamp_quality_score"),
    )


def eligibility(obs: Column, days: Column, quality: Column) -> Column:
    return (
        F.when((obs < 5) | (days < 2), "INSUFFICIENT_HISTORY")
        .when(quality < 0.5, "INSUFFICIENT_TIMESTAMP_QUALITY")
        .otherwise("SUFFICIENT_HISTORY")
    )


def baseline_confidence(status: Column, obs: Column, quality: Column) -> Column:
    return (
        F.when(status == "INSUFFICIENT_HISTORY", "UNTRUSTED")
        .when(status == "INSUFFICIENT_TIMESTAMP_QUALITY", "LOW")
        .when((obs >= 10) & (quality >= 0.8), "HIGH")
        .otherwise("MEDIUM")
    )


def with_observations(features: DataFrame, events: DataFrame, key: str) -> DataFrame:
    df = features.join(observations(events, key), key, "left")
    df = df.fillna(0, [*OBSERVED, "historical_span_days", "timestamp_quality_score"])
    obs, quality = F.col("observation_count"), F.col("timestamp_quality_score")
    return df.withColumn("eligibility_status", eligibility(obs, F.col("distinct_active_days"), quality)).withColumns({
        "baseline_confidence": baseline_confidence(F.col("eligibility_status"), obs, quality),
        "baseline_method": F.lit("median_mad"),
        "baseline_window": F.lit("full_historical_observation"),
    })


def peer_baselines(features: DataFrame) -> DataFrame:
    """Median and MAD of four metrics per department, with the group size."""
    stats = robust_stats(features, list(USER_METRICS), ["department"])
    sizes = features.groupBy("department").agg(F.count("*").alias("peer_group_size"))
    renamed = stats.select("department", *[
        F.col(f"{m}_{s}").alias(f"peer_{short}_{s}") for m, short in USER_METRICS.items() for s in ("median", "mad")
    ])
    return sizes.join(renamed, "department")


def user_baselines(features: DataFrame, events: DataFrame) -> DataFrame:
    return with_observations(features, events, "user_id").join(peer_baselines(features), "department", "left")


def host_baselines(features: DataFrame, events: DataFrame) -> DataFrame:
    stats = global_stats(features, ["firewall_deny_ratio", "endpoint_alert_count"])
    names = {"firewall_deny_ratio": "deny_ratio", "endpoint_alert_count": "endpoint_alert"}
    return with_observations(features, events, "hostname").withColumns({
        f"population_{short}_{kind}": F.lit(float(stats[m][i]))
        for m, short in names.items() for i, kind in enumerate(("median", "mad"))
    })


def absolute_deviation(value: Column, median: Column) -> Column:
    return numbers.floor0(value - median)


def relative_deviation(value: Column, median: Column) -> Column:
    return numbers.round_half_up(numbers.floor0(value - median) / (median + 1.0), R4)


def _statuses(df: DataFrame, dims: list[str]) -> DataFrame:
    status = {f"{d}_deviation_status": numbers.deviation_status(F.col(f"{d}_deviation")) for d in dims}
    signals = numbers.count_true(*[F.col(f"{d}_deviation") >= 2.5 for d in dims])
    return df.withColumns({
        **status,
        "overall_deviation_status": numbers.deviation_status(F.col("behavior_deviation_score")),
        "multi_signal_deviation_count": signals.cast("bigint"),
    })


def user_deviations(base: DataFrame) -> DataFrame:
    """Robust z-scores against peers and population, four signal dimensions."""
    pop = global_stats(base, list(USER_POPULATION))
    cols = {}
    for metric, short in USER_METRICS.items():
        value, med, mad = F.col(metric), F.col(f"peer_{short}_median"), F.col(f"peer_{short}_mad")
        cols[f"{short}_abs_dev"] = absolute_deviation(value, med)
        cols[f"{short}_rel_dev"] = relative_deviation(value, med)
        cols[f"{short}_zscore"] = numbers.round_half_up(numbers.robust_z(value, med, mad), R4)
    for metric, short in USER_POPULATION.items():
        med, mad = (F.lit(float(x)) for x in pop[metric])
        cols[f"{short}_zscore"] = numbers.round_half_up(numbers.robust_z(F.col(metric), med, mad), R4)
    z = lambda name: F.col(f"{name}_zscore")
    df = base.withColumns(cols).withColumns({
        "authentication_deviation": numbers.floor0(F.greatest(z("failed_login"), z("auth_failure_rate"))),
        "network_deviation": numbers.floor0(F.greatest(z("unique_source_ip"), z("unique_host"))),
        "endpoint_deviation": numbers.floor0(z("endpoint_alert")),
        "off_hours_deviation": numbers.floor0(z("off_hours")),
    })
    dims = ["authentication", "network", "endpoint", "off_hours"]
    mean = sum((F.col(f"{d}_deviation") for d in dims[1:]), F.col(f"{dims[0]}_deviation")) / 4.0
    return _statuses(df.withColumn("behavior_deviation_score", numbers.round_half_up(mean, R4)), dims)


def host_deviations(base: DataFrame) -> DataFrame:
    """Robust z-scores of seven host metrics, three signal dimensions."""
    pop = global_stats(base, list(HOST_POPULATION))
    cols = {}
    for metric, short in HOST_POPULATION.items():
        med, mad = (F.lit(float(x)) for x in pop[metric])
        cols[f"{short}_zscore"] = numbers.round_half_up(numbers.robust_z(F.col(metric), med, mad), R4)
    deny = F.lit(float(pop["firewall_deny_count"][0]))
    cols["firewall_deny_abs_dev"] = absolute_deviation(F.col("firewall_deny_count"), deny)
    cols["firewall_deny_rel_dev"] = relative_deviation(F.col("firewall_deny_count"), deny)
    z = lambda name: F.col(f"{name}_zscore")
    df = base.withColumns(cols).withColumns({
        "network_deviation": numbers.floor0(
            F.greatest(z("firewall_deny"), z("firewall_deny_ratio"), z("unique_destination_ip"))),
        "endpoint_deviation": numbers.floor0(z("endpoint_alert")),
        "volume_deviation": numbers.floor0(F.greatest(z("bytes_sent"), z("bytes_received"))),
    })
    dims = ["network", "endpoint", "volume"]
    mean = (F.col("network_deviation") + F.col("endpoint_deviation") + F.col("volume_deviation")) / 3.0
    return _statuses(df.withColumn("behavior_deviation_score", numbers.round_half_up(mean, R4)), dims)


def clustering_matrix(user_dev: DataFrame, host_dev: DataFrame) -> DataFrame:
    """Users and hosts in one feature table; features of the other kind are 0."""
    users = user_dev.select(
        F.col("user_id").alias("entity_id"), F.lit("USER").alias("entity_type"),
        "failed_login_zscore", "auth_failure_rate_zscore", "off_hours_zscore", "endpoint_alert_zscore",
        "unique_source_ip_zscore", "unique_host_zscore", "behavior_deviation_score", "multi_signal_deviation_count",
    )
    hosts = host_dev.select(
        F.col("hostname").alias("entity_id"), F.lit("HOST").alias("entity_type"),
        "firewall_deny_zscore", "firewall_deny_ratio_zscore", "bytes_sent_zscore", "bytes_received_zscore",
        "endpoint_alert_zscore", "behavior_deviation_score", "multi_signal_deviation_count",
    )
    return users.unionByName(hosts, allowMissingColumns=True).fillna(0)
