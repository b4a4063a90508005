"""Bounded risk scores with separate evidence confidence and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import numbers, text
from .joins import mark_join

# --- fixed values: signal dimension -> points at full deviation ---------------
USER_WEIGHTS = {"authentication": 25.0, "network": 25.0, "endpoint": 25.0, "off_hours": 25.0}
HOST_WEIGHTS = {"network": 33.33, "endpoint": 33.33, "volume": 33.34}
CONTRIBUTION_NAMES = {
    "authentication": "auth_contribution",
    "network": "network_contribution",
    "endpoint": "endpoint_contribution",
    "off_hours": "operational_contribution",
    "volume": "operational_contribution",
}
SENSITIVITY_FACTORS = {"Baseline (1.0x)": 1.0, "Sensitivity -10% (0.9x)": 0.9, "Sensitivity +10% (1.1x)": 1.1}

SCORE_COLUMNS = [
    "entity_id", "entity_type", "username", "department", "risk_score", "risk_level", "risk_confidence_score",
    "risk_confidence_level", "independent_signal_count", "multi_signal_multiplier", "source_iam_risk_indicator",
    "source_iam_risk_quality", "eligibility_status", "counter_evidence", "primary_hypothesis",
]
CONTRIBUTOR_COLUMNS = [
    "entity_id", "entity_type", "risk_score", "auth_contribution", "network_contribution",
    "endpoint_contribution", "operational_contribution", "multi_signal_boost",
]


def evidence_confidence(obs: Column, ts_quality: Column, baseline: Column) -> Column:
    """0.4 timestamp quality + 0.3 observation share + 0.3 baseline weight."""
    weight = F.lit(0.5)
    for name, value in fv.CONFIDENCE_WEIGHTS.items():
        weight = F.when(F.upper(baseline) == name, F.lit(value)).otherwise(weight)
    seen = F.least(F.lit(1.0), F.coalesce(obs, F.lit(0)) / F.lit(10.0))
    score = F.coalesce(ts_quality, F.lit(0.0)) * 0.4 + seen * 0.3 + weight * 0.3
    return numbers.round_half_up(numbers.clip(score, 0, 1), 4)


def points(z: Column, weight: float) -> Column:
    """Contribution of one dimension: full weight at a deviation of 4."""
    return F.least(F.lit(weight), z / 4.0 * weight)


def _total(cols: list[Column]) -> Column:
    return sum(cols[1:], cols[0])


def scored(df: DataFrame, weights: dict[str, float], factor: float = 1.0) -> DataFrame:
    """Add base points, signal count, multiplier and the unrounded score.

    ``factor`` rescales every deviation (sensitivity runs).
    """
    z = {d: numbers.floor0(F.coalesce(F.col(f"{d}_deviation"), F.lit(0.0))) * factor for d in weights}
    df = df.withColumns({f"_z_{d}": c for d, c in z.items()})
    df = df.withColumns({f"_s_{d}": points(F.col(f"_z_{d}"), w) for d, w in weights.items()})
    df = df.withColumns({
        "_base": _total([F.col(f"_s_{d}") for d in weights]),
        "independent_signal_count": numbers.count_true(*[F.col(f"_z_{d}") >= 2.5 for d in weights]).cast("bigint"),
    })
    df = df.withColumn("multi_signal_multiplier", numbers.signal_multiplier(F.col("independent_signal_count")))
    return df.withColumn("_raw_score", numbers.clip(F.col("_base") * F.col("multi_signal_multiplier"), 0, 100))


def _assessed(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    df = scored(df, weights)
    m = F.col("multi_signal_multiplier")
    parts = {CONTRIBUTION_NAMES[d]: numbers.round_half_up(F.col(f"_s_{d}") * m, 2) for d in weights}
    parts.setdefault("auth_contribution", F.lit(0.0))
    df = df.withColumns({
        **parts,
        "risk_score": numbers.round_half_up(F.col("_raw_score"), 2),
        "multi_signal_boost": numbers.round_half_up(F.col("_base") * (m - 1.0), 2),
        "risk_confidence_score": evidence_confidence(
            F.col("observation_count"), F.col("timestamp_quality_score"), F.col("baseline_confidence")),
    })
    return df.withColumns({
        "risk_level": numbers.risk_level(F.col("risk_score")),
        "risk_confidence_level": numbers.confidence_level(F.col("risk_confidence_score")),
    })


def _flags_common() -> list[tuple[Column, str]]:
    return [
        (F.col("timestamp_quality_score") < 0.5, "LOW_TIMESTAMP_QUALITY"),
        (F.col("eligibility_status") == "INSUFFICIENT_HISTORY", "INSUFFICIENT_BASELINE_HISTORY"),
    ]


_UNCORROBORATED = "UNCORROBORATED_SINGLE_DIMENSION"


def _hypothesis(flags: list[tuple[Column, str]]) -> Column:
    named = text.join_flags(flags, "; ", "NO_ACTIONABLE_HYPOTHESIS")
    return F.when(F.col("risk_score") >= 50.0, named).otherwise("NO_ACTIONABLE_HYPOTHESIS")


def _suspicious_endpoint() -> Column:
    critical = F.coalesce(F.col("critical_endpoint_alert_count"), F.lit(0)) > 0
    return (F.col("endpoint_contribution") >= 15) & ((F.col("network_contribution") >= 10) | critical)


def user_risk(dev: DataFrame) -> DataFrame:
    """Wide risk frame per user: scores, contributions, flags, hypotheses."""
    df = _assessed(dev, USER_WEIGHTS)
    auth, net = F.col("auth_contribution"), F.col("network_contribution")
    ops, active = F.col("operational_contribution"), F.col("independent_signal_count")
    single = (F.col("risk_score") >= 30.0) & (active <= 1)
    counter = [
        *_flags_common(),
        (single, _UNCORROBORATED),
        (F.coalesce(F.col("mfa_failure_count"), F.lit(0)) == 0, "ZERO_MFA_FAILURES_OBSERVED"),
    ]
    hypotheses = [
        ((auth >= 15) & (net >= 10), "POSSIBLE_CREDENTIAL_COMPROMISE"),
        ((auth >= 15) & ((ops >= 10) | (active >= 3)), "POSSIBLE_ACCOUNT_TAKEOVER"),
        (_suspicious_endpoint(), "POSSIBLE_SUSPICIOUS_ENDPOINT_ACTIVITY"),
        ((net >= 15) & (ops >= 10), "POSSIBLE_ANOMALOUS_DATA_EXFILTRATION"),
    ]
    known = F.col("source_risk_max").isNotNull()
    return df.withColumns({
        "entity_id": F.col("user_id"),
        "entity_type": F.lit("USER"),
        "counter_evidence": text.join_flags(counter),
        "primary_hypothesis": _hypothesis(hypotheses),
        "source_iam_risk_indicator": F.coalesce(F.col("source_risk_max").cast("string"), F.lit("Unknown")),
        "source_iam_risk_quality": F.when(known, "VALID_NUMERIC").otherwise("UNKNOWN"),
    })


def host_risk(dev: DataFrame) -> DataFrame:
    df = _assessed(dev, HOST_WEIGHTS)
    net, vol = F.col("network_contribution"), F.col("operational_contribution")
    single = (F.col("risk_score") >= 30.0) & (F.col("independent_signal_count") <= 1)
    counter = [
        *_flags_common(),
        (~F.col("is_managed"), "UNMANAGED_HOST_CONTEXT"),
        (single, _UNCORROBORATED),
    ]
    hypotheses = [
        (_suspicious_endpoint(), "POSSIBLE_SUSPICIOUS_ENDPOINT_ACTIVITY"),
        ((net >= 15) & (vol >= 10), "POSSIBLE_ANOMALOUS_NETWORK_TRAFFIC"),
    ]
    return df.withColumns({
        "entity_id": F.col("hostname"),
        "entity_type": F.lit("HOST"),
        "username": F.lit("Unknown"),
        "department": F.lit("Unknown"),
        "counter_evidence": text.join_flags(counter),
        "primary_hypothesis": _hypothesis(hypotheses),
        "source_iam_risk_indicator": F.lit("Not Applicable"),
        "source_iam_risk_quality": F.lit("NOT_APPLICABLE"),
    })


def risk_scores(wide: DataFrame) -> DataFrame:
    return wide.select(*SCORE_COLUMNS)


def contributors(wide: DataFrame) -> DataFrame:
    return wide.select(*CONTRIBUTOR_COLUMNS)


def hypotheses(wide: DataFrame, kind: str) -> DataFrame:
    """Hypothesis rows with one-line summaries; ``kind`` is USER or HOST."""
    c = {n: F.col(n).cast("string") for n in CONTRIBUTOR_COLUMNS[3:]}
    if kind == "USER":
        signals = F.concat(
            F.lit("Auth:"), c["auth_contribution"], F.lit(", Net:"), c["network_contribution"],
            F.lit(", Ep:"), c["endpoint_contribution"], F.lit(", Ops:"), c["operational_contribution"])
        limits = F.concat(
            F.lit("Observed events: "), F.col("observation_count").cast("string"),
            F.lit(", TS Quality: "), F.col("timestamp_quality_score").cast("string"))
    else:
        signals = F.concat(
            F.lit("Net:"), c["network_contribution"], F.lit(", Ep:"), c["endpoint_contribution"],
            F.lit(", Vol:"), c["operational_contribution"])
        limits = F.concat(
            F.lit("Observed events: "), F.col("observation_count").cast("string"),
            F.lit(", Managed: "), F.when(F.col("is_managed"), "True").otherwise("False"))
    return wide.select(
        "entity_id", "entity_type", F.col("primary_hypothesis").alias("hypothesis"), "risk_score",
        F.col("risk_confidence_score").alias("confidence_score"), signals.alias("supporting_signals"),
        "counter_evidence", limits.alias("limitations"),
    )


def explanations(wide: DataFrame, kind: str) -> DataFrame:
    """Nested "why flagged" objects for entities with a score of 50 or more."""
    s = F.struct
    f = lambda name, alias: F.col(name).alias(alias)
    if kind == "USER":
        top = s(f("auth_contribution", "authentication"), f("network_contribution", "network"),
                f("endpoint_contribution", "endpoint"), f("operational_contribution", "operational_off_hours"))
        seen = s("failed_login_count", f("authentication_failure_rate", "auth_failure_rate"),
                 "off_hours_activity_count", "endpoint_alert_count")
        extra = [
            s(*[numbers.round_half_up(F.col(f"_z_{d}"), 2).alias(f"{d}_zscore") for d in USER_WEIGHTS])
            .alias("deviations"),
            s("department", "peer_failed_login_median", "department_failed_login_percentile").alias("peer_comparison"),
        ]
    else:
        top = s(f("network_contribution", "network"), f("endpoint_contribution", "endpoint"),
                f("operational_contribution", "volume"))
        seen = s("firewall_deny_count", "firewall_deny_ratio", "endpoint_alert_count")
        extra = []
    none = F.col("counter_evidence") == "NONE_OBSERVED"
    return wide.where(F.col("risk_score") >= 50.0).select(
        "entity_id", "entity_type", f("risk_score", "overall_risk"), "risk_level",
        f("risk_confidence_level", "confidence"), f("risk_confidence_score", "confidence_score"),
        top.alias("top_contributors"),
        s(f("independent_signal_count", "active_elevated_signals"), f("multi_signal_multiplier", "multiplier"))
        .alias("multi_signal_corroboration"),
        seen.alias("observed_values"),
        *extra,
        F.when(none, F.array().cast("array<string>")).otherwise(F.split("counter_evidence", "; "))
        .alias("counter_evidence"),
        "primary_hypothesis",
    )


EVIDENCE_COLUMNS = [
    "entity_id", "entity_type", "event_id", "source_dataset", "source_record_id", "event_category",
    "event_timestamp", "severity", "action", "data_quality_status", "resolution_confidence",
]


def normalized_evidence(
    events: DataFrame, users: DataFrame, hosts: DataFrame, threshold: float = 30.0, limit: int | None = None
) -> DataFrame:
    """Events of flagged entities; the user is named before the host.

    ``limit`` keeps the first rows by event id and is off by default.
    """
    flagged_users = users.where(F.col("risk_score") >= threshold)
    flagged_hosts = hosts.where(F.col("risk_score") >= threshold)
    df = mark_join(events, "user_id", flagged_users, "entity_id", "_u", "event_id")
    df = mark_join(df, "hostname", flagged_hosts, "entity_id", "_h", "event_id")
    df = df.where(F.col("_u") | F.col("_h")).withColumns({
        "entity_id": F.when(F.col("_u"), F.col("user_id")).otherwise(F.col("hostname")),
        "entity_type": F.when(F.col("_u"), "USER").otherwise("HOST"),
    }).select(*EVIDENCE_COLUMNS)
    return df if limit is None else df.orderBy("event_id").limit(limit)


def sensitivity(user_dev: DataFrame) -> DataFrame:
    """Mean, median and high-risk share of user scores for rescaled deviations."""
    from .robust import medians

    slim = user_dev.select(*[f"{d}_deviation" for d in USER_WEIGHTS])
    runs = [
        scored(slim, USER_WEIGHTS, factor).select(F.lit(name).alias("variation"), F.col("_raw_score").alias("score"))
        for name, factor in SENSITIVITY_FACTORS.items()
    ]
    scores = runs[0].unionByName(runs[1]).unionByName(runs[2])
    high = F.count_if(F.col("score") >= 60.0)
    means = scores.groupBy("variation").agg(
        numbers.round_half_up(F.avg("score"), 2).alias("mean"),
        high.alias("high_critical_count"),
        numbers.round_half_up(high / F.count("*") * 100.0, 2).alias("pct_high_critical"),
    )
    middle = medians(scores, ["score"], ["variation"]).select(
        "variation", numbers.round_half_up(F.col("median"), 2).alias("median"))
    return means.join(middle, "variation").select(
        "variation", "mean", "median", "high_critical_count", "pct_high_critical")
