"""Every operator as a query over a driver folder.

Names start with the operator's row in the inventory. Each entry takes a
:class:`Pipeline` and returns a DataFrame over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network, numbers, text, times
from ..operators import baselines, canonical, clean, graph, ids, insights, joins, lookups, quality, risk, robust, suites, temporal
from ..sources import fixtures, io
from .pipeline import Pipeline, open_pipeline

Q: dict[str, Callable[[Pipeline], DataFrame]] = {}
c = F.col
USER, TARGET = "EMP7", "EMP12"
KEYS = {"identity": "user_id", "iam": "event_id", "endpoint": "alert_id", "firewall": "log_id"}
SPELLED = {
    "identity": ["department", "status"], "iam": ["department", "event_type", "auth_method"],
    "endpoint": ["severity", "status"], "firewall": ["protocol", "action"],
}
TIMES = [  # table, column, whether an ambiguous date has its day first
    ("iam", "timestamp", False), ("endpoint", "detected_timestamp", True), ("endpoint", "resolved_timestamp", True), ("firewall", "timestamp", False),
]


def query(name: str):
    def keep(fn):
        Q[name] = fn
        return fn

    return keep


def scalars(name: str, table: str, keep: str, **cols) -> None:
    """A query that shows a raw column next to one or more derived ones."""
    Q[name] = lambda p: p.raw[table].select(c(keep).alias("raw"), *[f(c(keep)).alias(n) for n, f in cols.items()])


def big(col) -> F.Column:
    return col.cast("bigint")


# --- S: sources and sinks ---------------------------------------------------------


def _path(p: Pipeline, name: str) -> str:
    return f"{p.store.root}/{p.store.fresh('io')}/{name}"


@query("S01_csv_scan")
def _(p):
    path = _path(p, "firewall.csv")
    io.write_csv(p.raw["firewall_raw"], path)
    df = io.read_csv(p.spark, path, clean.FIREWALL_COLUMNS)
    return df.groupBy("protocol", "action").agg(F.count("*").alias("n"), F.count("timestamp").alias("with_time"))


@query("S02_json_scan")
def _(p):
    path = _path(p, "iam.json")
    io.write_json(p.raw["iam_raw"], path)
    return io.read_json(p.spark, path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("S03_scan_by_suffix")
def _(p):
    path = _path(p, "endpoint.parquet")
    io.write_parquet(p.raw["endpoint_raw"], path)
    return io.read_table(p.spark, path).groupBy("severity").agg(F.count("*").alias("n"))


SOURCES = ["identity", "iam", "endpoint", "firewall"]


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def each_raw(report) -> Callable[[Pipeline], DataFrame]:
    """A report over each of the four raw tables, one below the other."""
    return lambda p: stacked([report(p.raw[f"{n}_raw"], n) for n in SOURCES])


@query("S04_source_set")
def _(p):
    paths = {n: _path(p, n) for n in ("identity_raw.csv", "iam_raw.json", "endpoint_raw.parquet", "firewall_raw.csv")}
    for name, path in paths.items():
        table, kind = name.split(".")
        {"csv": io.write_csv, "json": io.write_json, "parquet": io.write_parquet}[kind](p.raw[table], path)
    read = io.read_sources(p.spark, {n.split(".")[0]: path for n, path in paths.items()})
    return stacked([df.agg(F.count("*").alias("n")).select(F.lit(n).alias("source"), "n") for n, df in read.items()])


@query("S05_csv_sink")
def _(p):
    path = _path(p, "iam_clean.csv")
    io.write_csv(clean.to_analytical(p.iam, "iam"), path)
    df = io.read_csv(p.spark, path, clean.IAM_COLUMNS)
    return df.groupBy("event_type", "data_quality_status").agg(F.count("*").alias("n"))


@query("S06_parquet_sink")
def _(p):
    path = _path(p, "events")
    io.write_parquet(p.events, path, ["source_dataset"])
    return p.spark.read.parquet(path).groupBy("source_dataset", "event_type").agg(F.count("*").alias("n"))


@query("S07_nested_json_sink")
def _(p):
    path = _path(p, "why.json")
    both = risk.explanations(p.user_risk, "USER").unionByName(risk.explanations(p.host_risk, "HOST"), allowMissingColumns=True)
    io.write_json(both, path)
    schema = both.schema
    return p.spark.read.schema(schema).json(path).select(
        "entity_id", "entity_type", "overall_risk", c("top_contributors.authentication").alias("auth"), c("top_contributors.network").alias("network"))


@query("S08_table_or_empty")
def _(p):
    folder = p.store.root
    p.user_features
    schema = p.user_features.schema
    found = io.load_table(p.spark, folder, ["absent_table", "user_features"], schema)
    absent = io.load_table(p.spark, folder, ["absent_table"], schema)
    return joins.one_row([found.agg(F.count("*").alias("found_rows")), absent.agg(F.count("*").alias("absent_rows"))])


@query("S09_keyed_records")
def _(p):
    keyed = stacked([io.as_map(risk.explanations(df, kind), "entity_id") for df, kind in ((p.user_risk, "USER"), (p.host_risk, "HOST"))])
    return keyed.select(
        c("key").alias("entity_id"), F.get_json_object("value", "$.overall_risk").cast("double").alias("overall_risk"),
        F.get_json_object("value", "$.risk_level").alias("risk_level"))


@query("S10_standard_headers")
def _(p):
    messy = p.raw["iam_raw"].select(c("event_id").alias(" Event ID "), c("risk_score").alias("Risk Score"))
    return io.standard_headers(messy).groupBy("risk_score").agg(F.count("event_id").alias("n"))


# --- C, M: text and categories -------------------------------------------------------

scalars("C01_trimmed_text", "identity_raw", "location", value=text.trimmed)
scalars("C02_na_words_to_null", "iam_raw", "failure_reason", value=text.drop_na_words)
scalars("C03_case_folding", "identity_raw", "username", upper=text.upper_text, lower=text.lower_text)
scalars("C04_squeezed_whitespace", "identity_raw", "location", value=text.squeeze)
scalars("C05_category_key", "endpoint_raw", "status", value=text.category_key)
scalars("C06_user_id_strict", "endpoint_raw", "user_id", value=text.user_id)
scalars("C07_user_id_lenient", "iam_raw", "user_id", value=lambda x: text.user_id(x, keep_unmatched=True))
scalars("C08_hostname", "firewall_raw", "hostname", value=text.hostname)
scalars("C09_join_key", "iam_raw", "session_id", value=text.join_key)
scalars("C10_hostname_join_key", "endpoint_raw", "hostname", value=text.hostname_join_key)
scalars("C11_sha256_clean", "endpoint_raw", "sha256", value=text.sha256_clean)
scalars("C12_sha256_reason", "endpoint_raw", "sha256", value=text.sha256_reason)
scalars("C13_sha256_status", "endpoint_raw", "sha256", value=text.sha256_status)
scalars("C14_ip_validity", "firewall_raw", "dst_ip", value=lambda x: network.ip_status(text.trimmed(x)))
Q["C15_ip_canonical"] = lambda p: network.with_canonical_ip(
    p.raw["iam_raw"].select(c("source_ip").alias("raw")), "raw", "value")
Q["C16_protocol_action_label"] = lambda p: p.raw["firewall_raw"].select(
    F.concat_ws("_", F.coalesce(text.protocol(c("protocol")), F.lit("Unknown")),
                F.coalesce(text.firewall_action(c("action")), F.lit("Unknown"))).alias("label")
).groupBy("label").agg(F.count("*").alias("n"))
Q["C17_department_node_id"] = lambda p: p.identity.where(c("department").isNotNull()).select(
    "department", text.department_node(c("department")).alias("node_id")).distinct()
Q["C18_prefix_add_remove"] = lambda p: p.events.where(c("source_ip").isNotNull()).select("source_ip").distinct().select(
    "source_ip", text.add_prefix(c("source_ip"), "IP-").alias("node_id")
).withColumn("back", text.drop_prefix(c("node_id"), "IP-"))
Q["C19_contains_any_column"] = lambda p: p.identity.where(
    text.contains_any("mP1", c("user_id"), c("username"))).select("user_id", "username")
Q["C20_joined_flags"] = lambda p: p.endpoint.select("alert_id", text.join_flags([
    (c("user_id").isNull(), "NO_USER"), (c("severity").isNull(), "NO_SEVERITY"), (c("sha256").isNull(), "NO_HASH")
]).alias("gaps"))
Q["C21_scrubbed_markup"] = lambda p: fixtures.driver_tables(p.spark, p.folder)["conversations"].select(
    "conv_id", "turn", text.scrub_markup(c("text")).alias("shown"))
Q["C22_scrubbed_phrases"] = lambda p: fixtures.driver_tables(p.spark, p.folder)["documents"].select(
    "doc_id", F.md5(text.scrub_phrases(c("text"))).alias("digest"))
scalars("M01_department_strict", "identity_raw", "department", value=text.department)
scalars("M02_department_kept", "iam_raw", "department", value=lambda x: text.department(x, "keep"))
scalars("M03_employment_status", "identity_raw", "status", value=text.employment_status)
scalars("M04_login_event", "iam_raw", "event_type", value=text.login_event)
scalars("M05_auth_method", "iam_raw", "auth_method", value=text.auth_method)
scalars("M06_failure_reason", "iam_raw", "failure_reason", value=text.failure_reason)
scalars("M07_severity", "endpoint_raw", "severity", value=text.severity)
scalars("M08_severity_rank", "endpoint_raw", "severity", value=lambda x: big(text.severity_rank(text.severity(x))))
scalars("M09_alert_status", "endpoint_raw", "status", value=text.alert_status)
scalars("M10_device_criticality", "endpoint_raw", "device_criticality", value=text.criticality)
scalars("M11_protocol", "firewall_raw", "protocol", value=text.protocol)
scalars("M12_firewall_action", "firewall_raw", "action", value=text.firewall_action)
scalars("M13_boolean_words", "firewall_raw", "threat_flag", plain=text.boolean, auth=text.auth_boolean)
Q["M14_replaced_labels"] = lambda p: p.iam.groupBy(
    text.replace_labels(c("risk_label"), ["Missing", "Invalid"], "Info").alias("label")).agg(F.count("*").alias("n"))

# --- N: numbers and times ---------------------------------------------------------------

trimmed = text.trimmed
scalars("N01_port", "firewall_raw", "dst_port", value=lambda x: big(numbers.port(trimmed(x))))
scalars("N02_port_status", "firewall_raw", "dst_port", strict=lambda x: numbers.port_status(trimmed(x)),
        with_zero=lambda x: numbers.port_status(trimmed(x), low=0))
scalars("N03_byte_size", "firewall_raw", "bytes_sent", value=lambda x: numbers.byte_size(trimmed(x)),
        signed=lambda x: numbers.byte_size(trimmed(x), allow_negative=True))
Q["N04_risk_text"] = lambda p: numbers.with_risk(p.raw["iam_raw"].select("event_id", "risk_score"), "risk_score").drop("risk_score")
Q["N05_risk_category"] = lambda p: p.raw["iam_raw"].groupBy(
    numbers.risk_category(trimmed(c("risk_score"))).alias("category")).agg(F.count("*").alias("n"))


def _time(name, table, col, **kw):
    Q[name] = lambda p: p.raw[table].select(trimmed(c(col)).alias("raw")).select(
        "raw", times.as_text(times.parse_timestamp(c("raw"), **kw)).alias("value"))


_time("N06_iam_time", "iam_raw", "timestamp", day_first=False)
_time("N07_alert_time", "endpoint_raw", "detected_timestamp")
_time("N09_utc_time", "firewall_raw", "timestamp", day_first=False, epoch=False, to_utc=True)
Q["N08_identity_date"] = lambda p: p.raw["identity_raw"].select(trimmed(c("hire_date")).alias("raw")).select(
    "raw", times.as_text(times.parse_identity_date(c("raw"))).alias("value"))
Q["N10_time_text"] = lambda p: p.iam.select("event_id", times.as_text(c("timestamp")).alias("value"))
Q["N11_date_parts"] = lambda p: p.events.where(c("event_timestamp").isNotNull()).groupBy(
    big(F.hour("event_timestamp")).alias("hour"), F.date_format("event_timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
Q["N12_off_hours"] = lambda p: p.iam.where(c("timestamp").isNotNull()).groupBy(
    times.off_hours(c("timestamp")).alias("off_hours")).agg(F.count("*").alias("n"))
Q["N13_chronology_flag"] = lambda p: p.endpoint.select(
    "alert_id", times.ends_before_start(c("detected_timestamp"), c("resolved_timestamp")).alias("flag"))
Q["N14_duration_hours"] = lambda p: p.endpoint.select("alert_id", numbers.round_half_up(
    times.hours_between(c("detected_timestamp"), c("resolved_timestamp")), 6).alias("hours"))
Q["N15_guarded_ratio"] = lambda p: p.user_features.select("user_id", numbers.round_half_up(
    numbers.ratio(c("failed_login_count"), c("authentication_event_count")), 6).alias("rate"))
Q["N16_clip"] = lambda p: p.firewall.groupBy("hostname").agg(F.sum("bytes_sent").alias("b")).select(
    "hostname", numbers.clip(c("b"), 1000, 5_000_000).alias("clipped"))
Q["N17_row_max_mean"] = lambda p: p.user_risk.select(
    "user_id", F.greatest("authentication_deviation", "network_deviation", "endpoint_deviation", "off_hours_deviation").alias("top"),
    numbers.round_half_up((c("authentication_deviation") + c("network_deviation") + c("endpoint_deviation")
                           + c("off_hours_deviation")) / 4.0, 4).alias("mean"))
Q["N18_rounding"] = lambda p: fixtures.driver_tables(p.spark, p.folder)["lineitem"].select(
    "l_orderkey", "l_linenumber", numbers.round_half_up(c("l_extendedprice") * c("l_discount"), 2).alias("rounded"))
Q["N19_threshold_bands"] = lambda p: p.risk_scores.select(
    "entity_id", numbers.risk_level(c("risk_score")).alias("level"),
    numbers.confidence_level(c("risk_confidence_score")).alias("confidence"),
    numbers.deviation_status(c("risk_score") / 20.0).alias("status"))
Q["N20_count_multiplier"] = lambda p: p.user_risk.groupBy(
    "independent_signal_count", numbers.signal_multiplier(c("independent_signal_count")).alias("multiplier")).agg(F.count("*").alias("n"))

# --- P: projections, filters, imputation --------------------------------------------------

Q["P01_select_rename"] = lambda p: clean.to_analytical(p.identity, "identity").select(
    c("user_id").alias("id"), c("department").alias("dept"), "status")
Q["P02_constant_columns"] = lambda p: p.endpoint.select(
    "alert_id", F.lit("Endpoint").alias("source_dataset"), F.lit("ALERT_TRIGGERED").alias("action"))
Q["P03_conditional_column"] = lambda p: p.endpoint.select(
    "alert_id", F.when(c("resolved_timestamp").isNull(), "UNKNOWN").otherwise("VALID").alias("status"))
Q["P04_filters"] = lambda p: p.risk_scores.where(
    (c("entity_type") == "USER") & (c("risk_score") >= 30) & (c("risk_confidence_score") >= 0.5)).select("entity_id", "risk_score")
Q["P05_set_filter"] = lambda p: lookups.choose(p.risk_scores, risk_level=["HIGH", "MODERATE"], department=[]).select("entity_id", "risk_level")
Q["P06_drop_null_rows"] = lambda p: p.events.dropna(subset=["event_timestamp", "hostname"]).groupBy("source_dataset").agg(F.count("*").alias("n"))
Q["P07_sentinel_fill"] = lambda p: p.firewall.fillna(
    {"hostname": "Unknown", "src_ip": "Unknown", "dst_ip": "Unknown", "session_id": "Unknown"}).groupBy(
    "hostname", "session_id").agg(F.count("*").alias("n"))
Q["P08_fill_after_outer_join"] = lambda p: p.session_features.select(
    "session_id", "iam_event_count", "has_failed_login", "firewall_log_count", "has_threat_flag")
Q["P09_zero_fill_numbers"] = lambda p: p.users.select("user_id", "department", "total_iam_events", "total_endpoint_alerts")
Q["P10_median_imputation"] = lambda p: p.firewall.select("log_id", big(c("src_port")).alias("src_port"), "bytes_received")


@query("P11_median_required")
def _(p):
    values = robust.require(robust.global_medians(p.firewall_parsed, ["src_port", "dst_port", "bytes_sent", "bytes_received"]))
    return p.firewall_parsed.agg(F.count("*").alias("n")).select(*[F.lit(float(v)).alias(k) for k, v in values.items()])


Q["P12_termination_semantics"] = lambda p: clean.to_analytical(p.identity, "identity").select("user_id", "status", "termination_date")
Q["P13_failure_semantics"] = lambda p: p.iam.groupBy("event_type", "failure_reason").agg(F.count("*").alias("n"))
Q["P14_repair_flags"] = lambda p: p.iam.select("event_id", "is_repaired", c("risk_imputed").alias("is_imputed"))
Q["P15_quality_status"] = lambda p: p.iam.select("event_id", "data_quality_status")
Q["P16_field_issue_class"] = lambda p: p.raw["endpoint_raw"].select(
    trimmed(c("detected_timestamp")).alias("raw")).select("raw", F.when(c("raw").isNull(), "missing").when(
        times.parse_timestamp(c("raw")).isNull(), "invalid_format").otherwise("valid").alias("issue")
).groupBy("issue").agg(F.count("*").alias("n"))
Q["P17_tristate_validity"] = lambda p: p.raw["firewall_raw"].select(trimmed(c("dst_port")).alias("raw")).select(
    F.when(c("raw").isNotNull(), numbers.port(c("raw")).isNotNull()).alias("valid")).groupBy("valid").agg(F.count("*").alias("n"))

# --- J: joins ----------------------------------------------------------------------------

Q["J01_left_join_aggregate"] = lambda p: p.identity.select("user_id").join(
    p.iam.where(c("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("events")), "user_id", "left").fillna(0, ["events"])
Q["J02_peer_stats_join"] = lambda p: p.user_baselines.select(
    "user_id", "department", "peer_group_size", "peer_failed_login_median", "peer_failed_login_mad")
Q["J03_full_outer_join"] = lambda p: p.session_features.select("session_id", "iam_event_count", "firewall_log_count")
Q["J04_join_other_key_name"] = lambda p: p.user_risk.select("entity_id", "risk_score").join(
    p.user_features.select("user_id", "evidence_count"), c("entity_id") == c("user_id"), "left").select("entity_id", "risk_score", "evidence_count")
Q["J05_mark_join"] = lambda p: joins.mark_join(p.firewall, "hostname", p.identity, "hostname", "known_host", "log_id").select("log_id", "known_host")
Q["J06_semi_join"] = lambda p: p.sequences.join(
    p.risk_scores.where("risk_score >= 30").select("entity_id"), "entity_id", "left_semi").select("sequence_id")
Q["J07_two_key_semi_join"] = lambda p: p.risk_evidence.select("event_id", "entity_id", "entity_type")
Q["J08_both_ends_present"] = lambda p: graph.with_both_ends(
    p.relationships.select(c("source_node").alias("source_id"), c("target_node").alias("target_id")).distinct(), p.node_ids)
Q["J09_anti_join"] = lambda p: joins.unmatched(p.iam, "user_id", p.identity, "user_id").select("event_id", "user_id")


@query("J10_join_coverage")
def _(p):
    key, hk = (lambda n: text.join_key(c(n))), (lambda n: text.hostname_join_key(c(n)))
    parts = [
        joins.coverage(p.iam, key("user_id"), p.identity, key("user_id"), "iam_user"),
        joins.coverage(p.endpoint, key("user_id"), p.identity, key("user_id"), "endpoint_user"),
        joins.coverage(p.endpoint, hk("hostname"), p.identity, hk("hostname"), "endpoint_host"),
        joins.coverage(p.firewall, hk("hostname"), p.identity, hk("hostname"), "firewall_host"),
        joins.coverage(p.iam, key("session_id"), p.firewall, key("session_id"), "iam_session"),
    ]
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df.withColumn("pct_matched", numbers.round_half_up(c("pct_raw"), 2)).drop("pct_raw")


Q["J11_session_presence"] = lambda p: p.sessions
Q["J12_attribute_default"] = lambda p: p.iam.where(c("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("n")).join(
    p.identity.select("user_id", "username"), "user_id", "left").select("user_id", F.coalesce("username", F.lit("Unknown")).alias("username"), "n")
Q["J13_referential_subset"] = lambda p: quality.missing_members(p.iam, "user_id", p.identity, "user_id")

# --- A: aggregations ------------------------------------------------------------------------

Q["A01_group_aggregates"] = lambda p: p.endpoint.groupBy("severity").agg(
    F.count("*").alias("n"), big(F.sum("severity_rank")).alias("rank_sum"), big(F.min("severity_rank")).alias("rank_min"),
    big(F.max("severity_rank")).alias("rank_max"), numbers.round_half_up(F.avg("resolution_duration_hours"), 4).alias("mean_hours"))
Q["A02_conditional_counts"] = lambda p: p.firewall.groupBy("hostname").agg(
    F.count_if(c("action") == "DENY").alias("denies"), F.count_if("threat_flag").alias("threats"))
Q["A03_distinct_counts"] = lambda p: joins.with_distinct_counts(
    p.iam.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("events")), p.iam.where("user_id is not null"), "user_id",
    {"ips": "source_ip", "sessions": "session_id"})
Q["A04_any"] = lambda p: p.iam.where(c("session_id").isNotNull()).groupBy("session_id").agg(
    F.bool_or(c("event_type") == "login_failed").alias("any_failed"))
Q["A05_distinct_days_hours"] = lambda p: baselines.observations(p.events, "user_id").select("user_id", "distinct_active_days", "distinct_active_hours")
Q["A06_median"] = lambda p: robust.medians(p.user_features, ["failed_login_count", "endpoint_alert_count"], ["department"])
Q["A07_median_absolute_deviation"] = lambda p: robust.robust_stats(p.host_features, ["bytes_sent", "firewall_deny_ratio"], ["feature_confidence"]).select(
    "feature_confidence", *[numbers.round_half_up(c(f"{m}_{s}"), 6).alias(f"{m}_{s}") for m in ("bytes_sent", "firewall_deny_ratio") for s in ("median", "mad")])
Q["A08_value_counts"] = lambda p: p.raw["endpoint_raw"].groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")
Q["A09_distinct_values"] = lambda p: p.events.select(c("source_ip").alias("ip")).union(p.events.select("destination_ip")).where("ip is not null").distinct()
Q["A10_row_duplicates"] = each_raw(quality.duplicate_rows)
Q["A11_key_duplicates"] = each_raw(lambda df, n: quality.duplicate_keys(df, n, KEYS[n]))
Q["A12_conflicting_duplicates"] = lambda p: stacked([
    *[quality.conflicting_keys(p.raw[f"{n}_raw"], n, KEYS[n]) for n in SOURCES],
    quality.conflicting_keys(p.raw["firewall_raw"].drop("log_id"), "firewall", "session_id")])
Q["A13_span_days"] = lambda p: baselines.observations(p.events, "hostname").select("hostname", "historical_span_days")
Q["A14_share_of_total"] = lambda p: quality.shares(p.endpoint, "alert_name")
Q["A15_group_byte_sum"] = lambda p: p.firewall.groupBy("hostname").agg(F.sum("bytes_sent").alias("sent"), F.sum("bytes_received").alias("received"))

# --- W, O, U: windows, order, sets ------------------------------------------------------------

Q["W01_percentile_rank"] = lambda p: p.user_features.select("user_id", numbers.round_half_up(c("department_failed_login_percentile"), 6).alias("pct"))
Q["W02_step_number"] = lambda p: p.user_sequence_evidence.select("sequence_id", "event_id", big(c("step")).alias("step"))
Q["W03_running_number"] = lambda p: ids.running_number(
    p.sequences.select("entity_id", "start_time", "sequence_id"), ["entity_id", "start_time", "sequence_id"],
    p.store, p.store.fresh("numbered"), "number", 1000).select("sequence_id", big(c("number")).alias("number"))
Q["W04_group_statistic_on_rows"] = lambda p: p.user_baselines.select("user_id", "peer_endpoint_alert_median", "failed_login_count")
Q["O01_multi_key_sort"] = lambda p: quality.variations(p.raw["endpoint_raw"], "endpoint", ["severity", "status"]).orderBy("column_name", F.desc("frequency"), "raw_value")
Q["O02_sort_with_tie_break"] = lambda p: joins.top_per_group(
    p.events.where(c("user_id").isNotNull() & c("event_timestamp").isNotNull()), ["user_id"], ["event_timestamp", "event_id"], 1).select("user_id", "event_id")
Q["O03_top_k"] = lambda p: p.risk_scores.orderBy(F.desc("risk_score"), "entity_id").limit(50).select("entity_id", "risk_score")
Q["O04_head_n"] = lambda p: p.events.where(c("user_id") == USER).orderBy("event_id").limit(20).select("event_id", "event_type")
Q["O05_top_group"] = lambda p: insights.top_shared_address(p.edges_of("CONNECTED_FROM_IP"))
Q["O06_drop_duplicates"] = lambda p: p.raw["firewall_raw"].dropDuplicates().groupBy("protocol").agg(F.count("*").alias("n"))
Q["O07_first_per_key"] = lambda p: p.nodes.select("node_id", "node_type", "label")
Q["U01_union_all"] = lambda p: p.risk_scores.select("entity_id", "entity_type", "risk_level")
Q["U02_union_fill"] = lambda p: baselines.clustering_matrix(p.user_risk, p.host_risk)
Q["U03_distinct_union"] = lambda p: canonical.host_names(p.identity, p.firewall, p.endpoint).select("hostname")
Q["U04_set_difference"] = lambda p: p.endpoint.where(c("hostname").isNotNull()).select("hostname").subtract(p.identity.select("hostname"))

# --- F: clean tables, canonical model, features ---------------------------------------------------


def _ints(df: DataFrame) -> DataFrame:
    """32-bit integers widened, so both engines give the same type."""
    return df.select(*[big(c(f.name)).alias(f.name) if f.dataType.simpleString() == "int" else c(f.name) for f in df.schema.fields])


Q["F01_clean_identity"] = lambda p: clean.to_analytical(p.identity, "identity")
Q["F02_clean_iam"] = lambda p: clean.to_analytical(p.iam, "iam")
Q["F03_clean_endpoint"] = lambda p: _ints(clean.to_analytical(p.endpoint, "endpoint"))
Q["F04_clean_firewall"] = lambda p: _ints(clean.to_analytical(p.firewall, "firewall"))
Q["F05_canonical_events"] = lambda p: canonical.events_to_analytical(p.events)
Q["F06_canonical_users"] = lambda p: p.users.select(
    "user_id", "department", "total_iam_events", "failed_logins", numbers.round_half_up(c("avg_risk_score"), 4).alias("avg_risk_score"),
    "total_endpoint_alerts", "critical_alerts", "high_alerts", "insider_threat_score")
Q["F07_canonical_hosts"] = lambda p: p.hosts
Q["F08_canonical_sessions"] = lambda p: p.sessions
Q["F09_canonical_relationships"] = lambda p: p.relationships
Q["F10_user_features"] = lambda p: p.user_features.withColumns({
    m: numbers.round_half_up(c(m), 6) for m in ("authentication_failure_rate", "mfa_failure_rate", "department_failed_login_percentile")})
Q["F11_host_features"] = lambda p: p.host_features.withColumn("firewall_deny_ratio", numbers.round_half_up(c("firewall_deny_ratio"), 6))
Q["F12_session_features"] = lambda p: p.session_features
Q["F13_event_features"] = lambda p: p.event_features.select(
    "event_id", "source_dataset", "is_off_hours", "is_chronology_anomaly", "feature_confidence")

# --- B: baselines -------------------------------------------------------------------------------

Q["B01_robust_z"] = lambda p: p.user_risk.select("user_id", *[f"{m}_zscore" for m in (
    "failed_login", "auth_failure_rate", "off_hours", "endpoint_alert", "unique_source_ip", "unique_host")])
Q["B02_observation_stats"] = lambda p: baselines.observations(p.events, "user_id")
Q["B03_eligibility"] = lambda p: p.user_baselines.select("user_id", "eligibility_status")
Q["B04_baseline_confidence"] = lambda p: p.host_baselines.select("hostname", "baseline_confidence")
Q["B05_user_baselines"] = lambda p: p.user_baselines.select("user_id", "department", "peer_group_size", *baselines.OBSERVED, *[
    numbers.round_half_up(c(f"peer_{s}_{k}"), 6).alias(f"peer_{s}_{k}") for s in baselines.USER_METRICS.values() for k in ("median", "mad")],
    "eligibility_status", "baseline_confidence")
Q["B06_host_baselines"] = lambda p: p.host_baselines.select("hostname", *baselines.OBSERVED, *[
    numbers.round_half_up(c(f"population_{s}_{k}"), 6).alias(f"population_{s}_{k}") for s in ("deny_ratio", "endpoint_alert") for k in ("median", "mad")],
    "eligibility_status", "baseline_confidence")
Q["B07_abs_rel_deviation"] = lambda p: p.user_risk.select("user_id", *[
    numbers.round_half_up(c(f"{s}_abs_dev"), 6).alias(f"{s}_abs_dev") for s in baselines.USER_METRICS.values()],
    *[f"{s}_rel_dev" for s in baselines.USER_METRICS.values()])
Q["B08_user_deviations"] = lambda p: p.user_risk.select(
    "user_id", "authentication_deviation", "network_deviation", "endpoint_deviation", "off_hours_deviation", "behavior_deviation_score",
    *[f"{d}_deviation_status" for d in ("authentication", "network", "endpoint", "off_hours", "overall")], "multi_signal_deviation_count")
Q["B09_host_deviations"] = lambda p: p.host_risk.select(
    "hostname", *[f"{s}_zscore" for s in baselines.HOST_POPULATION.values()], "network_deviation", "endpoint_deviation", "volume_deviation",
    "behavior_deviation_score", "firewall_deny_rel_dev", *[f"{d}_deviation_status" for d in ("network", "endpoint", "volume", "overall")],
    "multi_signal_deviation_count")
Q["B10_clustering_matrix"] = lambda p: baselines.clustering_matrix(p.user_risk, p.host_risk)

# --- R: risk -----------------------------------------------------------------------------------

Q["R01_evidence_confidence"] = lambda p: p.user_baselines.select("user_id", risk.evidence_confidence(
    c("observation_count"), c("timestamp_quality_score"), c("baseline_confidence")).alias("confidence"))
Q["R02_user_risk"] = lambda p: risk.risk_scores(p.user_risk)
Q["R03_host_risk"] = lambda p: risk.risk_scores(p.host_risk)
Q["R04_contributors"] = lambda p: risk.contributors(p.user_risk).unionByName(risk.contributors(p.host_risk))
Q["R05_counter_evidence"] = lambda p: p.risk_scores.select("entity_id", "counter_evidence")
Q["R06_hypothesis_rules"] = lambda p: p.risk_scores.select("entity_id", "primary_hypothesis")
Q["R07_hypotheses"] = lambda p: p.hypotheses


def _flat(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "struct":
            cols += [c(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        elif kind == "array":
            cols.append(F.array_join(f.name, "; ").alias(f.name))
        else:
            cols.append(c(f.name))
    return df.select(*cols)


Q["R08_user_explanations"] = lambda p: _flat(risk.explanations(p.user_risk, "USER")).withColumns({
    n: numbers.round_half_up(c(n), 6) for n in ("observed_values_auth_failure_rate", "peer_comparison_department_failed_login_percentile")})
Q["R08_host_explanations"] = lambda p: _flat(risk.explanations(p.host_risk, "HOST")).withColumn(
    "observed_values_firewall_deny_ratio", numbers.round_half_up(c("observed_values_firewall_deny_ratio"), 6))
Q["R09_combined_risk"] = lambda p: p.risk_scores
Q["R10_normalized_evidence"] = lambda p: p.risk_evidence.withColumn("event_timestamp", times.as_text(c("event_timestamp")))
Q["R11_sensitivity"] = lambda p: risk.sensitivity(p.user_risk)

# --- T: temporal ----------------------------------------------------------------------------------

Q["T01_sequence_confidence"] = lambda p: p.sequences.select("sequence_id", "sequence_confidence")
Q["T02_sequence_strength"] = lambda p: p.sequences.select("sequence_id", "sequence_strength")
Q["T03_user_sequences"] = lambda p: p.exported_sequences.where("entity_type = 'USER'")
Q["T04_host_sequences"] = lambda p: p.exported_sequences.where("entity_type = 'HOST'")
Q["T05_bursts"] = lambda p: p.bursts
Q["T06_sequence_types"] = lambda p: p.sequences.groupBy("entity_type", "sequence_type").agg(F.count("*").alias("n"))
Q["T07_sequence_counter_evidence"] = lambda p: p.sequences.select("sequence_id", "counter_evidence")
Q["T08_sequence_evidence"] = lambda p: p.sequence_evidence.select(
    "sequence_id", "entity_id", "entity_type", "event_id", "source_dataset", "source_record_id", "event_timestamp", "event_category", "role_in_sequence")
Q["T09_pattern_frequency"] = lambda p: temporal.pattern_frequency(p.sequences)
Q["T10_user_signals"] = lambda p: temporal.temporal_signals(p.sequences.where("entity_type = 'USER'"), p.identity, "user_id", ["username"])
Q["T10_host_signals"] = lambda p: temporal.temporal_signals(p.sequences.where("entity_type = 'HOST'"), p.host_features, "hostname")
Q["T11_burst_measures"] = lambda p: p.bursts.groupBy("burst_category", "severity_level").agg(
    F.count("*").alias("n"), numbers.round_half_up(F.max("event_density_per_min"), 2).alias("max_density"))

# --- G: graph ---------------------------------------------------------------------------------------

Q["G01_nodes"] = lambda p: p.nodes
Q["G02_edges"] = lambda p: p.edges
Q["G03_metadata"] = lambda p: graph.graph_metadata(p.nodes, p.edges)


@query("G04_node_lookup")
def _(p):
    wanted = p.iam.where(c("user_id").isNotNull()).select(c("user_id").alias("node_id")).union(
        p.events.where(c("source_ip").isNotNull()).select(F.concat(F.lit("IP-"), c("source_ip")))).union(
        p.raw["identity_raw"].where(c("role").isNotNull()).select("role"))
    return graph.lookup_nodes(p.nodes_among(wanted), wanted)


Q["G05_connections"] = lambda p: graph.connections(p.edges, USER)
Q["G06_user_hosts"] = lambda p: graph.typed_targets(p.edges_of("ASSOCIATED_WITH_HOST"), "ASSOCIATED_WITH_HOST")
Q["G07_host_addresses"] = lambda p: graph.typed_targets(p.edges_of("COMMUNICATED_WITH_IP"), "COMMUNICATED_WITH_IP", strip="IP-")
Q["G08_shared_address"] = lambda p: graph.shared_addresses(p.edges)
Q["G09_entity_sequences"] = lambda p: graph.typed_targets(p.edges_of("INVOLVED_IN_SEQUENCE"), "INVOLVED_IN_SEQUENCE")
Q["G10_risk_evidence"] = lambda p: graph.risk_evidence_of(p.edges_of("SUPPORTED_BY_EVIDENCE"), p.risk_scores, "WS-3")
Q["G11_neighborhood"] = lambda p: graph.neighborhood(p.edges, USER, 2, p.store, p.links)
Q["G11_neighborhood_edges"] = lambda p: graph.neighborhood_edges(p.links, graph.neighborhood(p.edges, USER, 2, p.store, p.links), 2, p.store)
Q["G11_neighborhood_summary"] = lambda p: graph.neighborhood_summary(
    p.edges, graph.neighborhood(p.edges, USER, 2, p.store, p.links), USER, 2, p.links)
Q["G12_shortest_path"] = lambda p: graph.shortest_path(p.edges, USER, TARGET, p.store, p.links)
Q["G13_investigation_context"] = lambda p: graph.investigation_context(
    p.entity_nodes, p.entity_edges, p.hypotheses, p.risk_scores.select("entity_id"))
Q["G13_context_items"] = lambda p: graph.context_items(p.edges_of("INVOLVED_IN_SEQUENCE", "SUPPORTED_BY_EVIDENCE"), p.risk_scores.select("entity_id"))
Q["G14_scenarios"] = lambda p: graph.scenarios(p.address_edges, p.risk_scores)
Q["G14_scenario_contexts"] = lambda p: p.scenario_contexts
Q["G15_distinct_neighbors"] = lambda p: graph.degrees(p.edges_of("CONNECTED_FROM_IP"), "CONNECTED_FROM_IP")

# --- I: insights -------------------------------------------------------------------------------------


Q["I01_kmeans_converged"] = lambda p: p.clustered.select("entity_id", big(c("label")).alias("label"))
Q["I02_inertia"] = lambda p: insights.fit_quality(p.clustered).select("inertia")
Q["I03_silhouette"] = lambda p: insights.fit_quality(p.clustered).select("silhouette")
Q["I04_k_sweep"] = lambda p: insights.k_sweep(p.points, p.store)
Q["I05_cluster_assignment"] = lambda p: p.user_clusters
Q["I06_cluster_profiles"] = lambda p: p.cluster_profiles
Q["I07_drift"] = lambda p: insights.drift(p.clustered, p.cluster_profiles)
Q["I08_user_outliers"] = lambda p: insights.user_outliers(p.user_risk)
Q["I09_host_outliers"] = lambda p: insights.host_outliers(p.host_risk)
Q["I10_peer_outliers"] = lambda p: p.peer_outliers
Q["I11_insight_summary"] = lambda p: insights.insight_summary(
    p.user_clusters, insights.fit_quality(p.clustered), p.outliers, p.peer_outliers, p.bursts, p.edges_of("CONNECTED_FROM_IP"))
Q["I12_risk_concentration"] = lambda p: insights.risk_concentration(p.user_clusters)

# --- L: lookups ----------------------------------------------------------------------------------------

Q["L01_posture"] = lambda p: lookups.posture(p.user_risk, p.host_risk, p.sequences, p.outliers, p.peer_outliers)
Q["L02_quadrants"] = lambda p: lookups.quadrants(p.risk_scores)
Q["L03_triage_by_risk"] = lambda p: lookups.triage_queue(risk.risk_scores(p.user_risk), p.user_clusters)
Q["L03_triage_filtered"] = lambda p: lookups.triage_queue(
    risk.risk_scores(p.user_risk), p.user_clusters, "confidence", "emp1", risk_level=["MODERATE", "HIGH", "CRITICAL"])
Q["L03_triage_by_cluster"] = lambda p: lookups.triage_queue(risk.risk_scores(p.user_risk), p.user_clusters, "cluster")
Q["L03_triage_by_entity"] = lambda p: lookups.triage_queue(risk.risk_scores(p.user_risk), p.user_clusters, "entity")
Q["L04_cluster_population"] = lambda p: lookups.distribution(p.user_clusters, "cluster_label")
Q["L05_risk_rows"] = lambda p: lookups.risk_rows(
    p.iam.where(c("user_id").isNotNull()).select(c("user_id").alias("entity_id")), p.risk_scores)
Q["L06_behavior_profile"] = lambda p: _flat(lookups.behavior_profile(p.user_risk, p.user_clusters)).withColumn(
    "observed_values_authentication_failure_rate", numbers.round_half_up(c("observed_values_authentication_failure_rate"), 6))
Q["L07_peer_comparison"] = lambda p: lookups.peer_comparison(p.user_risk, p.peer_outliers)
Q["L08_first_sequences"] = lambda p: _ints(lookups.first_sequences(p.sequences))
Q["L09_evidence_by_source"] = lambda p: _ints(lookups.evidence_by_source(p.risk_evidence))
Q["L10_shared_address_connections"] = lambda p: lookups.shared_address_connections(p.edges_of(*lookups.SHARED_ADDRESS_TYPES))
Q["L10_shared_address_links"] = lambda p: lookups.shared_address_links(p.edges_of(*lookups.SHARED_ADDRESS_TYPES))
Q["L11_high_risk_entities"] = lambda p: lookups.high_risk_entities(risk.risk_scores(p.user_risk), "MODERATE")
Q["L11_high_risk_by_department"] = lambda p: lookups.distribution(
    lookups.choose(risk.risk_scores(p.user_risk), risk_level=["MODERATE", "HIGH", "CRITICAL"]), "department")
Q["L12_cluster_profile"] = lambda p: p.cluster_profiles.where(c("cluster_id") == "CLUSTER_1")
Q["L13_provenance"] = lambda p: lookups.provenance(
    p.events.select(c("event_id").alias("entity_id")).union(p.iam.where(c("user_id").isNotNull()).select("user_id")).union(
        p.endpoint.where(c("hostname").isNotNull()).select("hostname")).union(p.sequences.select("sequence_id")).union(
        p.raw["iam_raw"].select("event_type")),
    p.user_risk, p.host_risk, p.sequences, p.events)
Q["L14_evidence_packages"] = lambda p: p.evidence_packages.select(
    "entity_id", c("risk_assessment.risk_score").alias("risk_score"), c("peer_comparison.peer_outlier_flag").alias("peer_outlier_flag"),
    "sequence_count", F.array_join(F.transform("sequences", lambda x: x["sequence_id"]), "; ").alias("first_sequences"),
    F.array_join(F.transform("evidence_records", lambda x: x["event_id"]), "; ").alias("first_events"), "edge_count")


@query("L15_entity_resolution")
def _(p):
    terms = p.raw["identity_raw"].select(c("department").alias("term")).union(p.raw["iam_raw"].select("user_id")).union(
        p.raw["firewall_raw"].select("hostname")).union(p.raw["iam_raw"].select("hostname")).union(
        p.sequences.where("entity_type = 'USER'").select("sequence_id")).distinct()
    return lookups.resolve_entities(terms, risk.risk_scores(p.user_risk), risk.risk_scores(p.host_risk), p.sequences)


def _questions(p: Pipeline) -> DataFrame:
    t = fixtures.driver_tables(p.spark, p.folder)
    a = t["conversations"].select(F.concat(F.lit("c"), c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string")).alias("id"), "text")
    b = t["documents"].select(F.concat(F.lit("d"), c("doc_id").cast("string")).alias("id"), "text")
    e = p.raw["endpoint_raw"].select("alert_id", F.concat_ws(" ", F.lit("why is"), "user_id", F.lit("on host"), "hostname", "description").alias("text"))
    s = p.sequences.select(F.concat(F.lit("s"), "sequence_id").alias("id"), F.concat(F.lit("what led to "), "sequence_id").alias("text"))
    return a.union(b).union(e).union(s)


Q["L16_entity_in_text"] = lambda p: _questions(p).select("id", F.lower("text").alias("low")).select(
    "id", text.entity_in_text(c("low")).alias("entity"))
Q["L17_intent"] = lambda p: _questions(p).select(
    "id", F.lower("text").alias("low")).select("id", "low", text.entity_in_text(c("low")).alias("entity")).select(
    "id", text.intent(c("low"), c("entity")).alias("intent"))
Q["L18_strongest_signal"] = lambda p: lookups.strongest_signal(risk.contributors(p.user_risk).unionByName(risk.contributors(p.host_risk)))
Q["L19_timelines"] = lambda p: _ints(lookups.timelines(p.events, "user_id"))
Q["L20_failed_logins_by_department"] = lambda p: lookups.failed_logins_by_department_day(p.iam)
Q["L20_top_failed_users"] = lambda p: lookups.top_users_by_failed_logins(p.iam)
Q["L20_alerts_by_severity"] = lambda p: lookups.alerts_by_severity(p.endpoint)
Q["L20_deny_trend"] = lambda p: lookups.deny_trend_by_protocol(p.firewall)
Q["L20_actions_by_protocol"] = lambda p: lookups.actions_by_protocol(p.firewall)
Q["L20_impossible_resolution"] = lambda p: quality.chronology_issues(p.endpoint).select("alert_id", "duration_hours")
Q["L20_threat_flag_hosts"] = lambda p: lookups.hosts_by_threat_flags(p.firewall)
Q["L20_mfa_failure_trend"] = lambda p: lookups.mfa_failure_trend(p.iam)
Q["L20_failures_and_alerts"] = lambda p: lookups.users_with_failures_and_alerts(p.user_features)
Q["L20_critical_alerts_by_day"] = lambda p: lookups.critical_alerts_by_day(p.endpoint)

# --- Q: profiling and checks ---------------------------------------------------------------------------

Q["Q01_column_profile"] = lambda p: stacked([quality.column_profile(p.stored_raw(n), n) for n in SOURCES])
Q["Q02_missing_report"] = each_raw(quality.missing_report)
Q["Q03_top_values"] = lambda p: _ints(each_raw(quality.top_values)(p))
Q["Q04_variations"] = each_raw(lambda df, n: quality.variations(df, n, SPELLED[n]))
Q["Q05_timestamp_profile"] = lambda p: stacked([
    quality.timestamp_profile(p.raw[f"{n}_raw"], n, column, day_first=first) for n, column, first in TIMES])
Q["Q06_parse_failures"] = lambda p: stacked([
    quality.parse_failures(p.raw[f"{n}_raw"], column, day_first=first).withColumns({"dataset": F.lit(n), "column_name": F.lit(column)})
    for n, column, first in TIMES])
Q["Q07_chronology_issues"] = lambda p: quality.chronology_issues(p.endpoint)
Q["Q08_invalid_values"] = lambda p: quality.invalid_values(
    p.raw["endpoint_raw"], "sha256", text.sha256_status(c("raw_value")), ["valid_sha256", "missing"])
Q["Q09_validity_profile"] = lambda p: quality.validity_profile(
    p.raw["firewall_raw"], "firewall", ["src_ip", "dst_ip"], ["src_port", "dst_port"], ["bytes_sent", "bytes_received"])
Q["Q10_key_normalization"] = lambda p: quality.key_normalization(p.raw["iam_raw"], "iam", "user_id", p.identity, "user_id")
Q["Q11_reconciliation"] = lambda p: quality.reconciliation({
    n: (p.raw[f"{n}_raw"], getattr(p, n)) for n in ("identity", "iam", "endpoint", "firewall")})
FIREWALL_MEASURED = ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "bytes_sent", "bytes_received"]
Q["Q12_cleaning_summary"] = lambda p: stacked([
    quality.cleaning_summary(p.endpoint_parsed, "endpoint", ["user_id", "severity", "detected_timestamp", "sha256"], ["duration_hours"]),
    quality.cleaning_summary(p.firewall_parsed, "firewall", FIREWALL_MEASURED, FIREWALL_MEASURED[3:]),
    quality.row_measures(p.raw["endpoint_raw"], p.endpoint, "endpoint"), quality.row_measures(p.raw["firewall_raw"], p.firewall, "firewall")])
FINAL_COLUMNS = {
    "identity": clean.IDENTITY_COLUMNS, "iam": clean.IAM_COLUMNS, "endpoint": clean.ENDPOINT_COLUMNS, "firewall": clean.FIREWALL_COLUMNS}
Q["Q13_schema_report"] = lambda p: stacked([
    quality.schema_report(df, FINAL_COLUMNS[n], name) for n in SOURCES
    for name, df in ((n, clean.to_analytical(getattr(p, n), n)), (f"{n}_raw", p.raw[f"{n}_raw"]))])
Q["Q14_key_checks"] = lambda p: quality.report([
    quality.counted("duplicate rows", "iam", quality.repeated_keys(clean.to_analytical(p.iam, "iam"), *clean.IAM_COLUMNS)),
    quality.counted("unique event_id", "iam", quality.repeated_keys(p.iam, "event_id")),
    quality.counted("unique user_id", "identity", quality.repeated_keys(p.identity, "user_id")),
    quality.counted("unique alert_id", "endpoint", quality.repeated_keys(p.endpoint, "alert_id")),
    quality.counted("unique log_id", "firewall", quality.repeated_keys(p.firewall, "log_id")),
])
R = quality.Rule
Q["Q15_domain_checks"] = lambda p: quality.report([
    quality.suite(clean.to_analytical(p.endpoint, "endpoint"), [
        R("severity", c("severity").isin("Critical", "High", "Medium", "Low", "Unknown")),
        R("user_id format", c("user_id").rlike("^EMP[0-9]+$") | (c("user_id") == "Unknown")),
        R("sha256 format", c("sha256").rlike("^[0-9a-f]{64}$") | (c("sha256") == "Unknown")),
        R("known severity", c("severity") != "Unknown"),
    ], "endpoint"),
    quality.suite(clean.to_analytical(p.firewall, "firewall"), [
        R("protocol", c("protocol").isin("TCP", "UDP", "ICMP", "Unknown")),
        R("action", c("action").isin("ALLOW", "DENY", "Unknown")),
        R("hostname canonical", (c("hostname") == F.upper("hostname")) | (c("hostname") == "Unknown")),
    ], "firewall"),
])
Q["Q15_identity_suite"] = lambda p: suites.identity_suite(clean.to_analytical(p.identity, "identity"))
Q["Q15_iam_suite"] = lambda p: suites.iam_suite(clean.to_analytical(p.iam, "iam"))
Q["Q16_range_checks"] = lambda p: quality.report([
    quality.suite(p.risk_scores, [
        R("risk in 0..100", c("risk_score").between(0, 100)),
        R("confidence in 0..1", c("risk_confidence_score").between(0, 1)),
        R("risk under 30", c("risk_score") < 30),
    ], "risk"),
    quality.suite(p.user_features, [
        R("failure rate in 0..1", c("authentication_failure_rate").between(0, 1)),
        R("counts not negative", c("failed_login_count") >= 0),
    ], "user_features"),
    quality.suite(p.firewall, [R("ports", c("dst_port").between(1, 65535)), R("bytes", c("bytes_sent") >= 0)], "firewall"),
])
Q["Q17_null_checks"] = lambda p: quality.report([
    quality.suite(clean.to_analytical(p.iam, "iam"), [R(f"{n} filled", c(n).isNotNull()) for n in clean.IAM_COLUMNS], "iam"),
    quality.suite(p.raw["iam_raw"], [R(f"{n} not blank", F.coalesce(trimmed(c(n)), F.lit("")) != "") for n in ("timestamp", "source_ip", "geo_location")], "iam_raw"),
])
Q["Q18_cross_column_checks"] = lambda p: quality.report([
    quality.suite(clean.to_analytical(p.identity, "identity"), [
        R("not terminated has no end", (c("status") == "Terminated") | (c("termination_date") == "Not Terminated")),
        R("terminated is not open", (c("status") != "Terminated") | (c("termination_date") != "Not Terminated")),
    ], "identity"),
    quality.suite(p.iam, [R("failed login has no n/a reason", (c("event_type") != "login_failed") | (F.coalesce("failure_reason", F.lit("?")) != "Not Applicable"))], "iam"),
    quality.suite(p.risk_scores, [R("level fits score", c("risk_level") == numbers.risk_level(c("risk_score")))], "risk"),
    quality.suite(p.user_baselines, [R("counts add up", c("observation_count") == c("valid_timestamp_count") + c("unknown_timestamp_count"))], "user_baselines"),
])
Q["Q19_graph_checks"] = lambda p: quality.report([
    quality.suite(p.edges, [
        R("provenance", c("source_dataset").isNotNull() & c("source_record_id").isNotNull() & (c("source_dataset") != "Unknown")),
        R("no self-loop", c("source_id") != c("target_id")),
        R("known type", c("relationship_type").isin(graph.EDGE_TYPES)),
        R("known confidence", c("relationship_confidence").isin("EXACT", "PROBABLE", "UNMATCHED")),
    ], "edges"),
    quality.counted("unique edge", "edges", quality.repeated_hashed_keys(p.edges, *graph.KEY)),
    quality.member_checks(p.nodes, "node_id", "unique node", "nodes", p.edges, {"source exists": "source_id", "target exists": "target_id"}, "edges"),
])
Q["Q20_temporal_checks"] = lambda p: quality.report([
    quality.suite(p.sequence_evidence, [R("known time", c("event_timestamp").isNotNull())], "sequence_evidence"),
    quality.suite(p.sequences, [
        R("start before end", c("start_time") <= c("end_time")),
        R("within window", c("duration_seconds").between(0, 3600)),
        R("two or more events", c("event_count") >= 2),
    ], "sequences"),
    quality.counted("events exist", "sequence_evidence", quality.missing_members(p.sequence_evidence, "event_id", p.events, "event_id")),
    quality.counted("unique sequence", "sequences", quality.repeated_keys(p.sequences, "sequence_id")),
])
Q["Q21_report_totals"] = lambda p: quality.totals(Q["Q15_domain_checks"](p).unionByName(Q["Q16_range_checks"](p)))
Q["Q22_finite_numbers"] = lambda p: quality.report([quality.suite(
    p.user_risk, quality.not_a_number(p.user_risk, ["failed_login_zscore", "off_hours_zscore", "behavior_deviation_score", "source_risk_max"]), "user_risk")])


def bound() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries that take (spark, folder)."""
    return {name: (lambda spark, folder, fn=fn: fn(open_pipeline(spark, folder))) for name, fn in Q.items()}
