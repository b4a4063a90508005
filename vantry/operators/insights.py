"""Behaviour clusters, drift, outliers and summary insights."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..session import TableStore
from .ids import running_number
from .joins import broadcast_if_small, one_row
from .robust import robust_stats

FEATURES = [
    "failed_login_zscore", "auth_failure_rate_zscore", "off_hours_zscore", "endpoint_alert_zscore",
    "unique_source_ip_zscore", "unique_host_zscore",
]
GRID = 10_000
Centroids = list[list[float]]


@dataclass
class KMeansFit:
    """Centroids the labels were drawn from, final centroids, loops used."""

    label_centroids: Centroids
    centroids: Centroids
    iterations: int
    converged: bool


def distances(features: list[str], centroids: Centroids) -> list[Column]:
    """Squared Euclidean distance to each centroid."""
    out = []
    for centroid in centroids:
        terms = [(F.col(f) - F.lit(x)) * (F.col(f) - F.lit(x)) for f, x in zip(features, centroid)]
        out.append(sum(terms[1:], terms[0]))
    return out


def nearest(dists: list[Column]) -> Column:
    """Index of the least distance, the lowest index on ties."""
    best = F.least(*dists)
    out = F.lit(len(dists) - 1)
    for i in range(len(dists) - 2, -1, -1):
        out = F.when(dists[i] == best, i).otherwise(out)
    return out


def grid_mean(feature: str) -> Column:
    """Mean of a feature with four decimals, summed as whole numbers.

    Integer sums do not depend on the order of partitions.
    """
    units = F.sum(F.round(F.col(feature) * GRID).cast("bigint"))
    return units.cast("double") / F.count("*") / float(GRID)


def numbered_points(points: DataFrame, store: TableStore) -> tuple[DataFrame, int]:
    """Points with their place in entity order, written once, and how many there are."""
    numbered = running_number(points, ["entity_id"], store, store.fresh("points"), "_row")
    numbered = store.put(store.fresh("numbered"), numbered)
    return numbered, numbered.count()


def initial_centroids(numbered: DataFrame, count: int, k: int, features: list[str] = FEATURES) -> Centroids:
    """Rows 0, s, 2s, ... with s = n // k in entity order; only k rows are fetched."""
    rows = numbered.where(F.col("_row").isin([i * (count // k) for i in range(k)])).orderBy("_row").collect()
    return [[float(r[f]) for f in features] for r in rows]


def kmeans(
    points: DataFrame, start: Centroids, max_iter: int = 300, tol: float = 1e-5, features: list[str] = FEATURES
) -> KMeansFit:
    """Lloyd iterations; each is one aggregation to k rows.

    An empty cluster keeps its centroid. Convergence keeps the centroids that
    produced the labels.
    """
    centroids = start
    for i in range(max_iter):
        means = (
            points.groupBy(nearest(distances(features, centroids)).alias("label"))
            .agg(*[grid_mean(f).alias(f) for f in features]).collect()
        )
        moved = [list(c) for c in centroids]
        for row in means:
            moved[row.label] = [row[f] for f in features]
        close = all(
            abs(a - b) <= tol + tol * abs(b) for old, new in zip(centroids, moved) for a, b in zip(old, new))
        if close:
            return KMeansFit(centroids, centroids, i + 1, True)
        previous, centroids = centroids, moved
    return KMeansFit(previous, centroids, max_iter, False)


def assigned(points: DataFrame, fit: KMeansFit, features: list[str] = FEATURES) -> DataFrame:
    """Label, distance to centroid and silhouette width of every point.

    The silhouette is the centroid form: distance to the own centroid against
    distance to the next one.
    """
    k = len(fit.centroids)
    df = points.withColumn("label", nearest(distances(features, fit.label_centroids)))
    df = df.withColumns({f"_d{i}": d for i, d in enumerate(distances(features, fit.centroids))})
    sizes = {r.label: r.n for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    d = [F.col(f"_d{i}") for i in range(k)]
    own, other, single = F.lit(0.0), F.lit(0.0), F.lit(False)
    for i in range(k):
        mine = F.col("label") == i
        rest = [d[j] for j in range(k) if j != i]
        own = F.when(mine, d[i]).otherwise(own)
        other = F.when(mine, F.least(*rest) if len(rest) > 1 else rest[0]).otherwise(other)
        if sizes.get(i, 0) <= 1:
            single = single | mine
    df = df.withColumns({
        "min_sq": F.least(*d),
        "own_distance": F.sqrt(own),
        "nearest_label": nearest(d),
        "_a": F.when(single, 0.0).otherwise(F.sqrt(own)),
        "_b": F.sqrt(other),
    })
    width = F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    return df.withColumn("silhouette_raw", width).drop("_a", "_b", *[f"_d{i}" for i in range(k)])


def fit_quality(assigned_points: DataFrame) -> DataFrame:
    """Inertia and mean silhouette as one row."""
    return assigned_points.agg(
        numbers.round_half_up(F.sum("min_sq"), 2).alias("inertia"),
        numbers.round_half_up(F.avg("silhouette_raw"), 4).alias("silhouette"),
    )


def k_sweep(points: DataFrame, store: TableStore, ks: range = range(2, 7), max_iter: int = 300) -> DataFrame:
    """Inertia and silhouette for several k; one row of fit figures each."""
    numbered, count = numbered_points(points, store)
    parts = []
    for k in ks:
        fit = kmeans(numbered, initial_centroids(numbered, count, k), max_iter)
        parts.append(fit_quality(assigned(numbered, fit)).select(
            F.lit(k).cast("bigint").alias("k"), F.lit(fit.iterations).cast("bigint").alias("iterations"), "inertia", "silhouette"))
    return reduce(DataFrame.unionByName, parts)


def cluster_name(c: Column) -> Column:
    return F.concat(F.lit("CLUSTER_"), c.cast("string"))


def cluster_profiles(points: DataFrame, risk: DataFrame) -> DataFrame:
    """Size, feature means, risk and a label per cluster.

    ``points`` has entity_id, label and the features.
    """
    short = ["failed_login", "auth_fail_rate", "off_hours", "endpoint_alert", "source_ip", "host"]
    joined = points.join(risk.select("entity_id", "risk_score", "risk_level"), "entity_id", "left")
    df = joined.groupBy("label").agg(
        F.count("*").alias("population_count"),
        *[grid_mean(f).alias(f"_m{i}") for i, f in enumerate(FEATURES)],
        (F.sum(F.round(F.coalesce("risk_score", F.lit(0.0)) * 100).cast("bigint")) / F.count("*") / 100.0).alias("_r"),
        F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("high_risk_count"),
    )
    total = points.count()
    m = [F.col(f"_m{i}") for i in range(6)]
    rules = [
        ((m[0] > 5) | (m[1] > 2) | (m[2] > 5) | (m[4] > 5), "SECURITY_SENSITIVE_OUTLIERS",
         "Extremely High Auth Failures, Off-Hours & IP Diversity"),
        (m[3] > 1.5, "HIGH_ENDPOINT_ALERT_PROFILE", "Elevated Endpoint Alerts"),
        ((m[0] > 1) | (m[1] > 0.5) | (m[2] > 0.5), "IRREGULAR_AUTHENTICATION_BEHAVIOR",
         "Moderate Auth Failure & Off-Hours Deviations"),
    ]
    label, dominant = F.lit("NORMAL_BUSINESS_ACTIVITY"), F.lit("Standard Baseline Activity across all features")
    for cond, name, words in reversed(rules):
        label, dominant = F.when(cond, name).otherwise(label), F.when(cond, words).otherwise(dominant)
    return df.select(
        cluster_name(F.col("label")).alias("cluster_id"),
        label.alias("cluster_label"),
        "population_count",
        numbers.round_half_up(F.col("population_count") * 100.0 / F.lit(float(total)), 2).alias("population_percent"),
        *[numbers.round_half_up(c, 4).alias(f"avg_{s}_z") for c, s in zip(m, short)],
        numbers.round_half_up(F.col("_r"), 2).alias("avg_risk_score"),
        "high_risk_count",
        dominant.alias("dominant_features"),
    )


def user_clusters(points: DataFrame, profiles: DataFrame, identity: DataFrame, risk: DataFrame) -> DataFrame:
    """Cluster membership with identity and risk metadata."""
    who = identity.select(F.col("user_id").alias("entity_id"), "username", "department")
    labels = broadcast_if_small(profiles.select("cluster_id", "cluster_label"))
    unknown = F.lit("Unknown")
    return (
        points.withColumn("cluster_id", cluster_name(F.col("label")))
        .join(who, "entity_id", "left")
        .join(risk.select("entity_id", "risk_score", "risk_level"), "entity_id", "left")
        .join(labels, "cluster_id", "left")
        .select(
            F.col("entity_id").alias("user_id"),
            F.coalesce("username", unknown).alias("username"),
            F.coalesce("department", unknown).alias("department"),
            "cluster_id",
            numbers.round_half_up(F.sqrt("min_sq"), 4).alias("distance_to_centroid"),
            numbers.round_half_up(F.col("silhouette_raw"), 4).alias("silhouette_width"),
            "behavior_deviation_score",
            F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
            F.coalesce("risk_level", F.lit("LOW")).alias("risk_level"),
            "cluster_label",
        )
    )


def drift(points: DataFrame, profiles: DataFrame) -> DataFrame:
    """Distance from the assigned centroid as a drift score."""
    labels = broadcast_if_small(profiles.select("cluster_id", "cluster_label"))
    dist, score = F.col("drift_distance"), F.col("drift_score")
    changed = F.col("nearest_label") != F.col("label")
    df = points.withColumns({
        "assigned_cluster": cluster_name(F.col("label")),
        "drift_distance": numbers.round_half_up(F.col("own_distance"), 4),
    }).withColumn("drift_score", numbers.round_half_up(F.least(F.lit(100.0), dist * 15.0), 2))
    return df.join(labels, F.col("assigned_cluster") == F.col("cluster_id"), "left").select(
        F.col("entity_id").alias("user_id"),
        "assigned_cluster",
        "cluster_label",
        "drift_distance",
        "drift_score",
        numbers.round_half_up(F.lit(1.0) / (dist * 0.1 + 1.0), 4).alias("drift_confidence"),
        F.when((score >= 50) | changed, "HIGH_DRIFT").when(score >= 20, "MODERATE_DRIFT").otherwise("STABLE")
        .alias("drift_category"),
        changed.alias("cluster_changed"),
    )


def _outliers(df: DataFrame, kind: str, key: str, dims: list[tuple[str, Column, float]], shown: dict) -> DataFrame:
    z = {name: F.col(f"_{name}") for name, _, _ in dims}
    df = df.withColumns({f"_{name}": numbers.round_half_up(c, 2) for name, c, _ in dims})
    active = [(z[name] > 2.0, name) for name, _, _ in dims]
    n = numbers.count_true(*[cond for cond, _ in active]).cast("bigint")
    parts = [z[name] * weight for name, _, weight in dims]
    return df.select(
        F.col(key).alias("entity_id"),
        F.lit(kind).alias("entity_type"),
        n.alias("outlier_dimension_count"),
        text.join_flags(active, "|", "NONE").alias("active_dimensions"),
        *[c.alias(name) for name, c in shown(z).items()],
        numbers.round_half_up(sum(parts[1:], parts[0]), 2).alias("multi_dimension_outlier_score"),
        numbers.round_half_up(F.least(F.lit(1.0), n * 0.15 + 0.5), 2).alias("outlier_confidence"),
        (n >= 2).alias("is_multi_dimensional_outlier"),
    )


def user_outliers(dev: DataFrame) -> DataFrame:
    """Users beyond z = 2 in several of four dimensions."""
    dims = [
        ("AUTHENTICATION", F.col("failed_login_zscore"), 0.3),
        ("NETWORK_IP", F.col("unique_source_ip_zscore"), 0.25),
        ("ENDPOINT", F.col("endpoint_alert_zscore"), 0.25),
        ("OFF_HOURS", F.col("off_hours_zscore"), 0.2),
    ]
    return _outliers(dev, "USER", "user_id", dims, lambda z: {
        "auth_zscore": z["AUTHENTICATION"], "network_zscore": z["NETWORK_IP"],
        "endpoint_zscore": z["ENDPOINT"], "off_hours_zscore": z["OFF_HOURS"]})


def host_outliers(dev: DataFrame) -> DataFrame:
    dims = [
        ("FIREWALL_DENY", F.col("firewall_deny_zscore"), 0.4),
        ("NETWORK_VOLUME", F.greatest("bytes_sent_zscore", "bytes_received_zscore"), 0.3),
        ("ENDPOINT", F.col("endpoint_deviation"), 0.3),
    ]
    return _outliers(dev, "HOST", "hostname", dims, lambda z: {
        "auth_zscore": F.lit(0.0), "network_zscore": F.greatest(z["FIREWALL_DENY"], z["NETWORK_VOLUME"]),
        "endpoint_zscore": z["ENDPOINT"], "off_hours_zscore": F.lit(0.0)})


def peer_outliers(dev: DataFrame) -> DataFrame:
    """Global against department behaviour; a MAD near 0 counts as 1."""
    metric = "behavior_deviation_score"
    stats = broadcast_if_small(robust_stats(dev, [metric], ["department"]))
    score, med = F.col(metric), F.col(f"{metric}_median")
    mad = F.when(F.col(f"{metric}_mad") > 1e-4, F.col(f"{metric}_mad")).otherwise(F.lit(1.0))
    odd_peer, odd_global = F.col("dept_peer_behavior_score") > 2.5, F.col("global_behavior_score") > 2.0
    side = lambda cond: F.when(cond, "ANOMALOUS").otherwise("NORMAL")
    return dev.join(stats, "department", "left").select(
        "user_id", "username", "department",
        score.alias("global_behavior_score"),
        numbers.round_half_up((score - med) / (mad * 1.4826), 4).alias("dept_peer_behavior_score"),
        numbers.round_half_up(score - med, 4).alias("peer_deviation_delta"),
    ).withColumns({
        "global_vs_peer_behavior": F.concat(side(odd_global), F.lit("_GLOBALLY_"), side(odd_peer), F.lit("_PEER")),
        "peer_outlier_flag": odd_peer,
    })


def risk_concentration(clusters: DataFrame, label: str = "SECURITY_SENSITIVE_OUTLIERS") -> DataFrame:
    """Share of all high and critical users that sit in one cluster label."""
    high = F.col("risk_level").isin("HIGH", "CRITICAL")
    inside = F.col("cluster_label") == label
    df = clusters.agg(
        F.count_if(inside).alias("cluster_users"),
        F.count_if(high).alias("all_high_critical"),
        F.count_if(high & inside).alias("cluster_high_critical"),
    )
    pct = numbers.ratio(F.col("cluster_high_critical") * 100.0, F.col("all_high_critical"))
    return df.withColumn("concentration_pct", numbers.round_half_up(pct, 2))


def top_shared_address(edges: DataFrame) -> DataFrame:
    """The address with most distinct neighbours over CONNECTED_FROM_IP."""
    from .graph import degrees

    return degrees(edges, "CONNECTED_FROM_IP").orderBy(F.desc("neighbors"), "node_id").limit(1)


def insight_summary(
    clusters: DataFrame, quality: DataFrame, outliers: DataFrame, peers: DataFrame, burst_table: DataFrame, edges: DataFrame
) -> DataFrame:
    """One row of headline counts; every input is reduced to one row first."""
    sensitive = F.col("cluster_label") == "SECURITY_SENSITIVE_OUTLIERS"
    parts = [
        clusters.agg(
            F.count("*").alias("total_users_clustered"),
            F.count_distinct("cluster_id").alias("cluster_count"),
            F.count_if(sensitive).alias("sensitive_cluster_users"),
            F.count_if(sensitive & F.col("risk_level").isin("HIGH", "CRITICAL")).alias("sensitive_cluster_high_risk"),
        ),
        quality.select("inertia", F.col("silhouette").alias("silhouette_score")),
        outliers.agg(F.count_if("is_multi_dimensional_outlier").alias("multi_dimensional_outlier_count")),
        peers.agg(F.count_if(F.col("global_vs_peer_behavior") == "NORMAL_GLOBALLY_ANOMALOUS_PEER")
                  .alias("peer_group_hidden_insiders_count")),
        burst_table.agg(F.count("*").alias("temporal_burst_count")),
        top_shared_address(edges).agg(
            F.max("node_id").alias("top_shared_ip"), F.coalesce(F.max("neighbors"), F.lit(0)).alias("top_shared_ip_users")),
    ]
    return one_row(parts)

