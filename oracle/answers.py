"""SQL text per query. Missing names have a rows-only check."""

from __future__ import annotations

from vantry.functions import fixed_values as fv
from vantry.operators import clean

from .ctes import (
    C, CONTRIB, K, NUM, SCORES, _PCT, _UM, assemble, bare, cat_key, dev_status, band, flags, host, id_date, ip, mapped, na, num, off,
    port, q, rnd, scored, size, squeeze, text, trim, uid, when, words, _UW,
)

A: dict[str, str] = {}
USER, TARGET = "EMP7", "EMP12"


def show(name: str, table: str, col: str, **cols: str) -> None:
    A[name] = f"SELECT {col} AS raw, {', '.join(f'{sql} AS {n}' for n, sql in cols.items())} FROM {table}"


def pct(a: str, b: str) -> str:
    return rnd(f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0e0 END * 100e0", 2)


# --- S
A["S01_csv_scan"] = "SELECT protocol, action, count(*) AS n, count(timestamp) AS with_time FROM firewall_raw GROUP BY 1, 2"
A["S02_json_scan"] = "SELECT event_type, count(*) AS n FROM iam_raw GROUP BY 1"
A["S03_scan_by_suffix"] = "SELECT severity, count(*) AS n FROM endpoint_raw GROUP BY 1"
A["S04_source_set"] = " UNION ALL ".join(f"SELECT '{n}_raw' AS source, count(*) AS n FROM {n}_raw" for n in ("identity", "iam", "endpoint", "firewall"))
A["S05_csv_sink"] = "SELECT event_type, data_quality_status, count(*) AS n FROM iam GROUP BY 1, 2"
A["S06_parquet_sink"] = "SELECT source_dataset, event_type, count(*) AS n FROM events_c GROUP BY 1, 2"
A["S07_nested_json_sink"] = """SELECT entity_id, 'USER' AS entity_type, risk_score AS overall_risk, auth_contribution AS auth, network_contribution AS network FROM urisk WHERE risk_score >= 50
UNION ALL SELECT entity_id, 'HOST', risk_score, NULL, network_contribution FROM hrisk WHERE risk_score >= 50"""
A["S08_table_or_empty"] = "SELECT count(*) AS found_rows, CAST(0 AS BIGINT) AS absent_rows FROM uf"
A["S09_keyed_records"] = "SELECT entity_id, risk_score AS overall_risk, risk_level FROM urisk WHERE risk_score >= 50 UNION ALL SELECT entity_id, risk_score, risk_level FROM hrisk WHERE risk_score >= 50"
A["S10_standard_headers"] = "SELECT risk_score, count(*) AS n FROM iam_raw GROUP BY 1"

# --- C, M
show("C01_trimmed_text", "identity_raw", "location", value=trim("location"))
show("C02_na_words_to_null", "iam_raw", "failure_reason", value=na("failure_reason"))
show("C03_case_folding", "identity_raw", "username", upper=f"upper({trim('username')})", lower=f"lower({trim('username')})")
show("C04_squeezed_whitespace", "identity_raw", "location", value=squeeze("location"))
show("C05_category_key", "endpoint_raw", "status", value=cat_key("status"))
show("C06_user_id_strict", "endpoint_raw", "user_id", value=uid("user_id"))
show("C07_user_id_lenient", "iam_raw", "user_id", value=f"coalesce({uid('user_id')}, {bare(na('user_id'))})")
show("C08_hostname", "firewall_raw", "hostname", value=host("hostname"))
show("C09_join_key", "iam_raw", "session_id", value=f"nullif({trim('session_id')}, 'Unknown')")
show("C10_hostname_join_key", "endpoint_raw", "hostname",
     value=f"replace(regexp_replace(upper(nullif({trim('hostname')}, 'Unknown')), '\\.CORP\\.LOCAL$', ''), '_', '-')")
_hex = f"regexp_full_match({trim('sha256')}, '[0-9a-fA-F]{{64}}')"
_reason = f"CASE WHEN {trim('sha256')} IS NULL THEN 'missing' WHEN {_hex} THEN 'valid' WHEN length({trim('sha256')}) <> 64 THEN 'invalid_length' ELSE 'invalid_characters' END"
_status = (f"CASE WHEN {trim('sha256')} IS NULL THEN 'missing' WHEN {_hex} THEN 'valid_sha256' WHEN lower({trim('sha256')}) IN {words(fv.HASH_PLACEHOLDERS)} "
           f"THEN 'placeholder' WHEN length({trim('sha256')}) <> 64 THEN 'invalid_length' ELSE 'invalid_characters' END")
show("C11_sha256_clean", "endpoint_raw", "sha256", value=f"CASE WHEN {_hex} THEN lower({trim('sha256')}) END")
show("C12_sha256_reason", "endpoint_raw", "sha256", value=_reason)
show("C13_sha256_status", "endpoint_raw", "sha256", value=_status)
show("C14_ip_validity", "firewall_raw", "dst_ip",
     value=f"CASE WHEN {trim('dst_ip')} IS NULL THEN 'missing' WHEN {ip('dst_ip')} IS NOT NULL THEN 'valid' ELSE 'invalid' END")
show("C15_ip_canonical", "iam_raw", "source_ip", value=ip("source_ip"))
_proto, _act = mapped(f"upper({trim('protocol')})", fv.PROTOCOLS), mapped(f"upper({trim('action')})", fv.FIREWALL_ACTIONS)
A["C16_protocol_action_label"] = f"SELECT coalesce({_proto}, 'Unknown') || '_' || coalesce({_act}, 'Unknown') AS label, count(*) AS n FROM firewall_raw GROUP BY 1"
A["C17_department_node_id"] = "SELECT DISTINCT department, 'DEPT-' || replace(upper(department), ' ', '_') AS node_id FROM identity WHERE department IS NOT NULL"
A["C18_prefix_add_remove"] = "SELECT DISTINCT source_ip, 'IP-' || source_ip AS node_id, source_ip AS back FROM events_c WHERE source_ip IS NOT NULL"
A["C19_contains_any_column"] = "SELECT user_id, username FROM identity WHERE user_id ILIKE '%mp1%' OR username ILIKE '%mp1%'"
A["C20_joined_flags"] = f"SELECT alert_id, {flags([('user_id IS NULL', 'NO_USER'), ('severity IS NULL', 'NO_SEVERITY'), ('sha256 IS NULL', 'NO_HASH')])} AS gaps FROM endpoint"
_ws = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_mk = f"trim(text, {_ws})"
for _t in fv.MARKUP_TOKENS:
    _mk = f"replace({_mk}, {q(_t)}, '')"
A["C21_scrubbed_markup"] = f"SELECT conv_id, turn, coalesce({_mk}, 'Unknown') AS shown FROM conversations"
_sc = f"coalesce(trim(text, {_ws}), '')"
for _t in fv.FORBIDDEN_PHRASES:
    _sc = f"regexp_replace({_sc}, {q(_t)}, {q(fv.SCRUB_MARKER)}, 'gi')"
A["C22_scrubbed_phrases"] = f"SELECT doc_id, md5({_sc}) AS digest FROM documents"
show("M01_department_strict", "identity_raw", "department", value=mapped(f"lower({squeeze('department')})", fv.DEPARTMENTS))
show("M02_department_kept", "iam_raw", "department", value=mapped(f"lower({na('department')})", fv.DEPARTMENTS, na("department")))
show("M03_employment_status", "identity_raw", "status", value=mapped(f"upper({squeeze('status')})", fv.EMPLOYMENT_STATUS))
show("M04_login_event", "iam_raw", "event_type",
     value=mapped(f"replace(replace(lower({na('event_type')}), '-', '_'), ' ', '_')", fv.LOGIN_EVENTS, "'other'"))
show("M05_auth_method", "iam_raw", "auth_method", value=mapped(f"lower({na('auth_method')})", fv.AUTH_METHODS, f"lower({na('auth_method')})"))
show("M06_failure_reason", "iam_raw", "failure_reason", value=mapped(f"lower({na('failure_reason')})", fv.FAILURE_REASONS, na("failure_reason")))
_sev = mapped(cat_key("severity"), fv.SEVERITIES)
show("M07_severity", "endpoint_raw", "severity", value=_sev)
show("M08_severity_rank", "endpoint_raw", "severity",
     value=f"CAST(CASE {_sev} WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END AS BIGINT)")
show("M09_alert_status", "endpoint_raw", "status", value=mapped(cat_key("status"), fv.ALERT_STATUS))
show("M10_device_criticality", "endpoint_raw", "device_criticality", value=mapped(cat_key("device_criticality"), fv.CRITICALITY))
show("M11_protocol", "firewall_raw", "protocol", value=_proto)
show("M12_firewall_action", "firewall_raw", "action", value=_act)
_b = "CASE WHEN lower(trim(threat_flag)) IN {} THEN true WHEN lower(trim(threat_flag)) IN {} THEN false END"
show("M13_boolean_words", "firewall_raw", "threat_flag", plain=_b.format(words(fv.TRUE_WORDS), words(fv.FALSE_WORDS)),
     auth=_b.format(words(fv.TRUE_WORDS_AUTH), words(fv.FALSE_WORDS_AUTH)))
A["M14_replaced_labels"] = "SELECT CASE WHEN risk_label IN ('Missing', 'Invalid') THEN 'Info' ELSE risk_label END AS label, count(*) AS n FROM iam GROUP BY 1"

# --- N
show("N01_port", "firewall_raw", "dst_port", value=f"CAST({port('dst_port')} AS BIGINT)")


def _pstat(low: int) -> str:
    return f"CASE WHEN {trim('dst_port')} IS NULL THEN 'missing' WHEN {port('dst_port', low)} IS NOT NULL THEN 'valid' ELSE 'invalid' END"


show("N02_port_status", "firewall_raw", "dst_port", strict=_pstat(1), with_zero=_pstat(0))
show("N03_byte_size", "firewall_raw", "bytes_sent", value=size("bytes_sent"), signed=size("bytes_sent", True))
A["N04_risk_text"] = f"""
SELECT r.event_id, p.risk_raw, p.risk_numeric, p.risk_valid, p.risk_label, p.risk_flag, p.risk_imputed
FROM iam_raw r JOIN iam_parsed p ON p.event_id = r.event_id"""
_rs = trim("risk_score")
A["N05_risk_category"] = f"""
SELECT CASE WHEN {_rs} IS NULL THEN 'missing' WHEN regexp_full_match({_rs}, {q(NUM)}) THEN 'numeric'
  WHEN regexp_full_match({_rs}, {q(_PCT)}) THEN 'numeric_fraction' WHEN lower({_rs}) IN ('high','medium','low') THEN 'categorical_risk'
  ELSE 'invalid' END AS category, count(*) AS n FROM iam_raw GROUP BY 1"""
A["N06_iam_time"] = f"SELECT {trim('timestamp')} AS raw, {text(when(trim('timestamp'), day_first=False))} AS value FROM iam_raw"
A["N07_alert_time"] = f"SELECT {trim('detected_timestamp')} AS raw, {text(when(trim('detected_timestamp')))} AS value FROM endpoint_raw"
A["N08_identity_date"] = f"SELECT {trim('hire_date')} AS raw, {text(id_date('hire_date'))} AS value FROM identity_raw"
A["N09_utc_time"] = f"SELECT {trim('timestamp')} AS raw, {text(when(trim('timestamp'), day_first=False, epoch=False, to_utc=True))} AS value FROM firewall_raw"
A["N10_time_text"] = f"SELECT event_id, {text('timestamp')} AS value FROM iam"
A["N11_date_parts"] = "SELECT hour(ts) AS hour, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events_c WHERE ts IS NOT NULL GROUP BY 1, 2"
A["N12_off_hours"] = f"SELECT {off('timestamp')} AS off_hours, count(*) AS n FROM iam WHERE timestamp IS NOT NULL GROUP BY 1"
A["N13_chronology_flag"] = "SELECT alert_id, coalesce(resolved_timestamp < detected_timestamp, false) AS flag FROM endpoint"
A["N14_duration_hours"] = f"SELECT alert_id, {rnd('duration_hours', 6)} AS hours FROM endpoint"
A["N15_guarded_ratio"] = f"SELECT user_id, {rnd('authentication_failure_rate', 6)} AS rate FROM uf"
A["N16_clip"] = "SELECT hostname, greatest(1000e0, least(5000000e0, sum(bytes_sent))) AS clipped FROM firewall GROUP BY 1"
A["N17_row_max_mean"] = f"""SELECT user_id, greatest(authentication_deviation, network_deviation, endpoint_deviation, off_hours_deviation) AS top,
  {rnd('(authentication_deviation + network_deviation + endpoint_deviation + off_hours_deviation) / 4e0', 4)} AS mean FROM udev"""
A["N18_rounding"] = f"SELECT l_orderkey, l_linenumber, {rnd('l_extendedprice * l_discount', 2)} AS rounded FROM lineitem"
_LEVEL = band("risk_score", [(30, "LOW"), (60, "MODERATE"), (80, "HIGH")], "CRITICAL")
A["N19_threshold_bands"] = f"SELECT entity_id, {_LEVEL} AS level, risk_confidence_level AS confidence, {dev_status('risk_score / 20')} AS status FROM risk_all"
A["N20_count_multiplier"] = """SELECT independent_signal_count, CASE independent_signal_count WHEN 2 THEN 1.25e0 WHEN 3 THEN 1.5e0 WHEN 4 THEN 1.75e0 ELSE 1e0 END AS multiplier,
  count(*) AS n FROM urisk GROUP BY 1, 2"""

# --- export forms
_f = lambda c: f"coalesce({c}, 'Unknown') AS {c}"
_tf = lambda c, a: f"CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' ELSE 'Unknown' END AS {a}"
_END = f"coalesce({text('termination_date')}, CASE WHEN status = 'Terminated' THEN 'Unknown' ELSE 'Not Terminated' END) AS termination_date"
X_IDENTITY = f"""SELECT {_f('user_id')}, {_f('username')}, {_f('department')}, {_f('status')}, coalesce({text('hire_date')}, 'Unknown') AS hire_date, {_END},
  {', '.join(_f(x) for x in ('manager_username', 'device_id', 'location', 'hostname', 'full_name', 'role'))} FROM identity"""
X_IAM = f"""SELECT {_f('event_id')}, coalesce({text('timestamp')}, 'Unknown') AS timestamp,
  {', '.join(_f(x) for x in ('user_id', 'username', 'department', 'event_type', 'auth_method', 'source_ip', 'hostname', 'device_id', 'session_id',
   'failure_reason', 'risk_label', 'geo_location', 'data_quality_status'))},
  {_tf('mfa_passed', 'mfa_passed')}, risk_score, risk_raw AS risk_score_raw, coalesce(CAST(risk_numeric AS VARCHAR), 'Unknown') AS risk_score_numeric,
  {_tf('risk_valid', 'risk_score_valid')}, risk_flag AS risk_quality_flag, {_tf('risk_imputed', 'is_imputed')}, {_tf('is_repaired', 'is_repaired')} FROM iam"""
X_ENDPOINT = f"""SELECT {', '.join(_f(x) for x in ('alert_id', 'hostname', 'user_id', 'endpoint_product', 'alert_name', 'severity', 'status', 'description',
   'file_path', 'process_name', 'sha256', 'assigned_to', 'device_criticality'))},
  coalesce({text('detected_timestamp')}, 'Unknown') AS detected_timestamp, coalesce({text('resolved_timestamp')}, 'Unknown') AS resolved_timestamp,
  CAST(severity_rank AS BIGINT) AS severity_rank, resolution_duration_hours FROM endpoint"""
X_FIREWALL = f"""SELECT {', '.join(_f(x) for x in ('log_id', 'hostname', 'src_ip', 'dst_ip', 'protocol', 'action', 'session_id', 'rule_name', 'geo_country'))},
  coalesce({text('timestamp')}, 'Unknown') AS timestamp, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, bytes_sent, bytes_received,
  {_tf('threat_flag', 'threat_flag')} FROM firewall"""

# --- P
A["P01_select_rename"] = f"SELECT user_id AS id, department AS dept, status FROM ({X_IDENTITY})"
A["P02_constant_columns"] = "SELECT alert_id, 'Endpoint' AS source_dataset, 'ALERT_TRIGGERED' AS action FROM endpoint"
A["P03_conditional_column"] = "SELECT alert_id, CASE WHEN resolved_timestamp IS NULL THEN 'UNKNOWN' ELSE 'VALID' END AS status FROM endpoint"
A["P04_filters"] = "SELECT entity_id, risk_score FROM risk_all WHERE entity_type = 'USER' AND risk_score >= 30 AND risk_confidence_score >= 0.5"
A["P05_set_filter"] = "SELECT entity_id, risk_level FROM risk_all WHERE risk_level IN ('HIGH', 'MODERATE')"
A["P06_drop_null_rows"] = "SELECT source_dataset, count(*) AS n FROM events_c WHERE ts IS NOT NULL AND hostname IS NOT NULL GROUP BY 1"
A["P07_sentinel_fill"] = "SELECT coalesce(hostname, 'Unknown') AS hostname, coalesce(session_id, 'Unknown') AS session_id, count(*) AS n FROM firewall GROUP BY 1, 2"
A["P08_fill_after_outer_join"] = "SELECT session_id, iam_event_count, has_failed_login, firewall_log_count, has_threat_flag FROM sf"
A["P09_zero_fill_numbers"] = "SELECT user_id, nullif(department, 'Unknown') AS department, authentication_event_count AS total_iam_events, endpoint_alert_count AS total_endpoint_alerts FROM uf"
A["P10_median_imputation"] = "SELECT log_id, CAST(src_port AS BIGINT) AS src_port, bytes_received FROM firewall"
A["P11_median_required"] = "SELECT median(src_port) AS src_port, median(dst_port) AS dst_port, median(bytes_sent) AS bytes_sent, median(bytes_received) AS bytes_received FROM firewall_parsed"
A["P12_termination_semantics"] = f"SELECT user_id, status, termination_date FROM ({X_IDENTITY})"
A["P13_failure_semantics"] = "SELECT event_type, failure_reason, count(*) AS n FROM iam GROUP BY 1, 2"
A["P14_repair_flags"] = "SELECT event_id, is_repaired, risk_imputed AS is_imputed FROM iam"
A["P15_quality_status"] = "SELECT event_id, data_quality_status FROM iam"
A["P16_field_issue_class"] = f"""SELECT CASE WHEN {trim('detected_timestamp')} IS NULL THEN 'missing' WHEN {when(trim('detected_timestamp'))} IS NULL THEN 'invalid_format'
  ELSE 'valid' END AS issue, count(*) AS n FROM endpoint_raw GROUP BY 1"""
A["P17_tristate_validity"] = f"SELECT CASE WHEN {trim('dst_port')} IS NOT NULL THEN {port('dst_port')} IS NOT NULL END AS valid, count(*) AS n FROM firewall_raw GROUP BY 1"

# --- J
A["J01_left_join_aggregate"] = "SELECT user_id, authentication_event_count AS events FROM uf"
A["J02_peer_stats_join"] = "SELECT user_id, department, peer_group_size, peer_failed_login_median, peer_failed_login_mad FROM ub"
A["J03_full_outer_join"] = "SELECT session_id, iam_event_count, firewall_log_count FROM sf"
A["J04_join_other_key_name"] = "SELECT entity_id, risk_score, evidence_count FROM urisk"
A["J05_mark_join"] = "SELECT log_id, coalesce(hostname IN (FROM known_hosts), false) AS known_host FROM firewall"
A["J06_semi_join"] = "SELECT sequence_id FROM seqs WHERE entity_id IN (SELECT entity_id FROM risk_all WHERE risk_score >= 30)"
A["J07_two_key_semi_join"] = "SELECT event_id, entity_id, entity_type FROM revid"
A["J08_both_ends_present"] = """SELECT DISTINCT source_node AS source_id, target_node AS target_id FROM relations
WHERE source_node IN (SELECT node_id FROM nodes) AND target_node IN (SELECT node_id FROM nodes)"""
A["J09_anti_join"] = "SELECT event_id, user_id FROM iam WHERE user_id IS NOT NULL AND user_id NOT IN (FROM known_users)"


def _cov(name: str, table: str, key: str, other: str) -> str:
    return f"""SELECT '{name}' AS join_name, count({key}) AS usable, count(*) FILTER ({key} IN (SELECT {key} FROM {other} WHERE {key} IS NOT NULL)) AS matched,
  count({key}) - count(*) FILTER ({key} IN (SELECT {key} FROM {other} WHERE {key} IS NOT NULL)) AS unmatched,
  {rnd(f"CASE WHEN count({key}) > 0 THEN count(*) FILTER ({key} IN (SELECT {key} FROM {other} WHERE {key} IS NOT NULL)) * 100e0 / count({key}) ELSE 0e0 END", 2)} AS pct_matched
FROM {table}"""


A["J10_join_coverage"] = " UNION ALL ".join([
    _cov("iam_user", "iam", "user_id", "identity"), _cov("endpoint_user", "endpoint", "user_id", "identity"),
    _cov("endpoint_host", "endpoint", "hostname", "identity"), _cov("firewall_host", "firewall", "hostname", "identity"),
    _cov("iam_session", "iam", "session_id", "firewall")])
A["J11_session_presence"] = "SELECT * FROM sessions_c"
A["J12_attribute_default"] = """SELECT a.user_id, coalesce(i.username, 'Unknown') AS username, n FROM (SELECT user_id, count(*) AS n FROM iam WHERE user_id IS NOT NULL GROUP BY 1) a
LEFT JOIN identity i ON i.user_id = a.user_id"""
A["J13_referential_subset"] = "SELECT DISTINCT user_id FROM iam WHERE user_id IS NOT NULL AND user_id NOT IN (FROM known_users)"

# --- A
A["A01_group_aggregates"] = f"""SELECT severity, count(*) AS n, CAST(sum(severity_rank) AS BIGINT) AS rank_sum, CAST(min(severity_rank) AS BIGINT) AS rank_min,
  CAST(max(severity_rank) AS BIGINT) AS rank_max, {rnd('avg(resolution_duration_hours)', 4)} AS mean_hours FROM endpoint GROUP BY 1"""
A["A02_conditional_counts"] = "SELECT hostname, count(*) FILTER (action = 'DENY') AS denies, count(*) FILTER (threat_flag) AS threats FROM firewall GROUP BY 1"
A["A03_distinct_counts"] = "SELECT user_id, count(*) AS events, count(DISTINCT source_ip) AS ips, count(DISTINCT session_id) AS sessions FROM iam WHERE user_id IS NOT NULL GROUP BY 1"
A["A04_any"] = "SELECT session_id, bool_or(event_type = 'login_failed') AS any_failed FROM iam WHERE session_id IS NOT NULL GROUP BY 1"
A["A05_distinct_days_hours"] = "SELECT user_id, distinct_active_days, distinct_active_hours FROM uobs"
A["A06_median"] = " UNION ALL ".join(
    f"SELECT department, '{m}' AS metric, count({m}) AS n, median(CAST({m} AS DOUBLE)) AS median FROM uf GROUP BY 1" for m in ("failed_login_count", "endpoint_alert_count"))
A["A07_median_absolute_deviation"] = f"""SELECT feature_confidence, {", ".join(
    f"{rnd(f'any_value({m}_m)', 6)} AS {m}_median, {rnd(f'median(abs({m} - {m}_m))', 6)} AS {m}_mad" for m in ("bytes_sent", "firewall_deny_ratio"))}
FROM (SELECT hf.*, bytes_sent_m, firewall_deny_ratio_m FROM hf JOIN (SELECT feature_confidence AS g, median(bytes_sent) AS bytes_sent_m,
  median(firewall_deny_ratio) AS firewall_deny_ratio_m FROM hf GROUP BY 1) ON g = feature_confidence) GROUP BY 1"""
A["A08_value_counts"] = "SELECT status, count(*) AS n FROM endpoint_raw GROUP BY 1"
A["A09_distinct_values"] = "SELECT source_ip AS ip FROM events_c WHERE source_ip IS NOT NULL UNION SELECT destination_ip FROM events_c WHERE destination_ip IS NOT NULL"


def _dups(table: str, cols: list[str], name: str) -> str:
    g = ", ".join(cols)
    return f"""SELECT '{name}' AS dataset, CAST(sum(n) AS BIGINT) AS total_rows, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS exact_duplicate_rows,
  count(*) FILTER (n > 1) AS exact_duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS surplus_rows,
  {pct('coalesce(sum(n) FILTER (n > 1), 0)', 'sum(n)')} AS duplicate_percentage FROM (SELECT {g}, count(*) AS n FROM {table} GROUP BY {g})"""


IAM_RAW_COLS = ["event_id", "timestamp", "user_id", "username", "department", "event_type", "auth_method", "source_ip", "hostname",
                "device_id", "session_id", "mfa_passed", "failure_reason", "risk_score", "geo_location"]
ENDPOINT_RAW_COLS = [x for x in clean.ENDPOINT_COLUMNS if x not in ("severity_rank", "resolution_duration_hours")]
RAW_COLS = {"identity": clean.IDENTITY_COLUMNS, "iam": IAM_RAW_COLS, "endpoint": ENDPOINT_RAW_COLS, "firewall": clean.FIREWALL_COLUMNS}
RAW_KEYS = {"identity": "user_id", "iam": "event_id", "endpoint": "alert_id", "firewall": "log_id"}
RAW_TIMES = [("iam", "timestamp", False), ("endpoint", "detected_timestamp", True), ("endpoint", "resolved_timestamp", True), ("firewall", "timestamp", False)]


def over_raw(one) -> str:
    """A report for each raw table: ``one(table, columns, name)``."""
    return " UNION ALL ".join(f"FROM ({one(f'{n}_raw', cols, n)})" for n, cols in RAW_COLS.items())


A["A10_row_duplicates"] = over_raw(_dups)
A["A11_key_duplicates"] = over_raw(lambda t, cols, n: f"""SELECT '{n}' AS dataset, '{RAW_KEYS[n]}' AS id_column, count({RAW_KEYS[n]}) AS unique_ids, count(*) FILTER (n > 1) AS duplicate_id_values,
  CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_with_duplicate_ids FROM (SELECT {RAW_KEYS[n]}, count(*) AS n FROM {t} GROUP BY 1)""")
A["A12_conflicting_duplicates"] = over_raw(lambda t, cols, n: f"""SELECT '{n}' AS dataset, '{RAW_KEYS[n]}' AS id_column, {RAW_KEYS[n]} AS id_value, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_row_count
FROM (SELECT {', '.join(cols)}, count(*) AS n FROM {t} WHERE {RAW_KEYS[n]} IS NOT NULL GROUP BY ALL) GROUP BY {RAW_KEYS[n]} HAVING count(*) > 1""") + f""" UNION ALL SELECT 'firewall', 'session_id', session_id, CAST(sum(n) AS BIGINT), count(*)
FROM (SELECT {', '.join(x for x in clean.FIREWALL_COLUMNS if x != 'log_id')}, count(*) AS n FROM firewall_raw WHERE session_id IS NOT NULL GROUP BY ALL) GROUP BY session_id HAVING count(*) > 1"""
A["A13_span_days"] = "SELECT hostname, historical_span_days FROM hobs"
A["A14_share_of_total"] = f"SELECT alert_name, count(*) AS n, {rnd('count(*) * 100e0 / sum(count(*)) OVER ()', 2)} AS pct FROM endpoint GROUP BY 1"
A["A15_group_byte_sum"] = "SELECT hostname, sum(bytes_sent) AS sent, sum(bytes_received) AS received FROM firewall GROUP BY 1"

# --- W, O, U
A["W01_percentile_rank"] = f"SELECT user_id, {rnd('department_failed_login_percentile', 6)} AS pct FROM uf"
A["W02_step_number"] = "SELECT sequence_id, event_id, step FROM useq_ev"
A["W03_running_number"] = "SELECT sequence_id, 999 + row_number() OVER (ORDER BY entity_id, start_time, sequence_id) AS number FROM seqs"
A["W04_group_statistic_on_rows"] = "SELECT user_id, peer_endpoint_alert_median, failed_login_count FROM ub"
_var = lambda t, ds, cols: " UNION ALL ".join(
    f"SELECT '{ds}' AS dataset, '{x}' AS column_name, trim({x}) AS raw_value, count(*) AS frequency FROM {t} WHERE {x} IS NOT NULL GROUP BY 3" for x in cols)
A["O01_multi_key_sort"] = _var("endpoint_raw", "endpoint", ["severity", "status"])
A["O02_sort_with_tie_break"] = """SELECT user_id, event_id FROM events_c WHERE user_id IS NOT NULL AND ts IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"""
A["O03_top_k"] = "SELECT entity_id, risk_score FROM risk_all ORDER BY risk_score DESC, entity_id LIMIT 50"
A["O04_head_n"] = f"SELECT event_id, event_type FROM events_c WHERE user_id = '{USER}' ORDER BY event_id LIMIT 20"
_SHARED = "SELECT target_id AS node_id, count(DISTINCT source_id) AS neighbors FROM edges WHERE relationship_type = 'CONNECTED_FROM_IP' GROUP BY 1"
A["O05_top_group"] = f"{_SHARED} ORDER BY neighbors DESC, node_id LIMIT 1"
A["O06_drop_duplicates"] = "SELECT protocol, count(*) AS n FROM (SELECT DISTINCT * FROM firewall_raw) GROUP BY 1"
A["O07_first_per_key"] = "SELECT node_id, node_type, label FROM nodes"
A["U01_union_all"] = "SELECT entity_id, entity_type, risk_level FROM risk_all"
_MATRIX = """
SELECT user_id AS entity_id, 'USER' AS entity_type, failed_login_zscore, auth_failure_rate_zscore, off_hours_zscore, endpoint_alert_zscore, unique_source_ip_zscore,
  unique_host_zscore, behavior_deviation_score, multi_signal_deviation_count, 0e0 AS firewall_deny_zscore, 0e0 AS firewall_deny_ratio_zscore,
  0e0 AS bytes_sent_zscore, 0e0 AS bytes_received_zscore FROM udev
UNION ALL
SELECT hostname, 'HOST', 0, 0, 0, endpoint_alert_zscore, 0, 0, behavior_deviation_score, multi_signal_deviation_count, firewall_deny_zscore, firewall_deny_ratio_zscore,
  bytes_sent_zscore, bytes_received_zscore FROM hdev"""
A["U02_union_fill"] = _MATRIX
A["U03_distinct_union"] = "SELECT hostname FROM all_hosts"
A["U04_set_difference"] = "SELECT hostname FROM endpoint WHERE hostname IS NOT NULL EXCEPT SELECT hostname FROM identity"

# --- F
A["F01_clean_identity"] = X_IDENTITY
A["F02_clean_iam"] = X_IAM
A["F03_clean_endpoint"] = X_ENDPOINT
A["F04_clean_firewall"] = X_FIREWALL
A["F05_canonical_events"] = f"""SELECT {', '.join(_f(x) for x in ('event_id', 'event_type', 'event_category', 'user_id', 'hostname', 'device_id', 'session_id', 'source_ip',
  'destination_ip', 'department', 'severity', 'action', 'source_dataset', 'source_record_id', 'data_quality_status', 'resolution_confidence'))},
  coalesce({text('ts')}, 'Unknown') AS event_timestamp FROM events_c"""
A["F06_canonical_users"] = f"""SELECT i.user_id, i.department, coalesce(a.n, 0) AS total_iam_events, coalesce(a.f, 0) AS failed_logins, {rnd('coalesce(a.r, 0)', 4)} AS avg_risk_score,
  coalesce(e.n, 0) AS total_endpoint_alerts, coalesce(e.c, 0) AS critical_alerts, coalesce(e.h, 0) AS high_alerts,
  {rnd('coalesce(a.f, 0) * 2e0 + coalesce(e.c, 0) * 5e0 + coalesce(e.h, 0) * 3e0 + coalesce(a.r, 0) * 0.5e0', 4)} AS insider_threat_score
FROM identity i LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'login_failed') AS f, avg(risk_score) AS r FROM iam GROUP BY 1) a ON a.user_id = i.user_id
LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (severity = 'Critical') AS c, count(*) FILTER (severity = 'High') AS h FROM endpoint GROUP BY 1) e ON e.user_id = i.user_id"""
A["F07_canonical_hosts"] = """SELECT hostname, is_managed, firewall_event_count AS total_firewall_logs, firewall_deny_count AS firewall_denies, threat_flag_count AS threat_flags,
  endpoint_alert_count AS endpoint_alerts FROM hf"""
A["F08_canonical_sessions"] = "SELECT * FROM sessions_c"
A["F09_canonical_relationships"] = "SELECT * FROM relations"
A["F10_user_features"] = f"""SELECT * EXCLUDE (authentication_failure_rate, mfa_failure_rate, department_failed_login_percentile), {", ".join(
    f"{rnd(m, 6)} AS {m}" for m in ("authentication_failure_rate", "mfa_failure_rate", "department_failed_login_percentile"))} FROM uf"""
A["F11_host_features"] = f"SELECT * EXCLUDE (firewall_deny_ratio), {rnd('firewall_deny_ratio', 6)} AS firewall_deny_ratio FROM hf"
A["F12_session_features"] = "SELECT * FROM sf"
A["F13_event_features"] = f"""SELECT event_id, source_dataset, coalesce({off('ts')}, false) AS is_off_hours,
  event_id IN (SELECT alert_id FROM endpoint WHERE chronology_issue) AS is_chronology_anomaly,
  CASE WHEN data_quality_status = 'VALID' THEN 'EXACT' ELSE 'PROBABLE' END AS feature_confidence FROM events_c"""

# --- B
A["B01_robust_z"] = "SELECT user_id, failed_login_zscore, auth_failure_rate_zscore, off_hours_zscore, endpoint_alert_zscore, unique_source_ip_zscore, unique_host_zscore FROM udev"
A["B02_observation_stats"] = "SELECT * FROM uobs"
A["B03_eligibility"] = "SELECT user_id, eligibility_status FROM ub"
A["B04_baseline_confidence"] = "SELECT hostname, baseline_confidence FROM hb"
_O = "observation_count, valid_timestamp_count, distinct_active_days, distinct_active_hours, unknown_timestamp_count"
A["B05_user_baselines"] = f"""SELECT user_id, department, peer_group_size, {_O}, {", ".join(
    f"{rnd(f'peer_{s}_{k}', 6)} AS peer_{s}_{k}" for s in _UM.values() for k in ("median", "mad"))}, eligibility_status, baseline_confidence FROM ub"""
A["B06_host_baselines"] = f"""SELECT hostname, {_O}, {", ".join(
    f"{rnd(f'population_{s}_{k}', 6)} AS population_{s}_{k}" for s in ("deny_ratio", "endpoint_alert") for k in ("median", "mad"))}, eligibility_status, baseline_confidence FROM hb"""
A["B07_abs_rel_deviation"] = f"SELECT user_id, {', '.join(f'{rnd(f'{s}_abs_dev', 6)} AS {s}_abs_dev, {s}_rel_dev' for s in _UM.values())} FROM udev"
A["B08_user_deviations"] = f"""SELECT user_id, authentication_deviation, network_deviation, endpoint_deviation, off_hours_deviation, behavior_deviation_score,
  {', '.join(f'{d}_deviation_status' for d in ('authentication', 'network', 'endpoint', 'off_hours', 'overall'))}, multi_signal_deviation_count FROM udev"""
A["B09_host_deviations"] = f"""SELECT hostname, {', '.join(f'{s}_zscore' for s in ('firewall_deny', 'firewall_deny_ratio', 'bytes_sent', 'bytes_received',
  'unique_source_ip', 'unique_destination_ip', 'endpoint_alert'))}, network_deviation, endpoint_deviation, volume_deviation, behavior_deviation_score,
  firewall_deny_rel_dev, {', '.join(f'{d}_deviation_status' for d in ('network', 'endpoint', 'volume', 'overall'))}, multi_signal_deviation_count FROM hdev"""
A["B10_clustering_matrix"] = _MATRIX

# --- R
A["R01_evidence_confidence"] = "SELECT user_id, risk_confidence_score AS confidence FROM urisk"
A["R02_user_risk"] = f"SELECT {SCORES} FROM urisk"
A["R03_host_risk"] = f"SELECT {SCORES} FROM hrisk"
A["R04_contributors"] = f"SELECT {CONTRIB} FROM urisk UNION ALL SELECT {CONTRIB} FROM hrisk"
A["R05_counter_evidence"] = "SELECT entity_id, counter_evidence FROM risk_all"
A["R06_hypothesis_rules"] = "SELECT entity_id, primary_hypothesis FROM risk_all"
A["R07_hypotheses"] = "SELECT * FROM hyps"
_EXPL = """entity_id, entity_type, risk_score AS overall_risk, risk_level, risk_confidence_level AS confidence, risk_confidence_score AS confidence_score,
  independent_signal_count AS multi_signal_corroboration_active_elevated_signals, multi_signal_multiplier AS multi_signal_corroboration_multiplier,
  CASE WHEN counter_evidence = 'NONE_OBSERVED' THEN '' ELSE counter_evidence END AS counter_evidence, primary_hypothesis"""
A["R08_user_explanations"] = f"""SELECT {_EXPL}, auth_contribution AS top_contributors_authentication, network_contribution AS top_contributors_network,
  endpoint_contribution AS top_contributors_endpoint, operational_contribution AS top_contributors_operational_off_hours,
  failed_login_count AS observed_values_failed_login_count, {rnd('authentication_failure_rate', 6)} AS observed_values_auth_failure_rate,
  off_hours_activity_count AS observed_values_off_hours_activity_count, endpoint_alert_count AS observed_values_endpoint_alert_count,
  {', '.join(f'{rnd(f"z_{d}", 2)} AS deviations_{d}_zscore' for d in _UW)}, department AS peer_comparison_department,
  peer_failed_login_median AS peer_comparison_peer_failed_login_median,
  {rnd('department_failed_login_percentile', 6)} AS peer_comparison_department_failed_login_percentile FROM urisk WHERE risk_score >= 50"""
A["R08_host_explanations"] = f"""SELECT {_EXPL}, network_contribution AS top_contributors_network, endpoint_contribution AS top_contributors_endpoint,
  operational_contribution AS top_contributors_volume, firewall_deny_count AS observed_values_firewall_deny_count,
  {rnd('firewall_deny_ratio', 6)} AS observed_values_firewall_deny_ratio, endpoint_alert_count AS observed_values_endpoint_alert_count FROM hrisk WHERE risk_score >= 50"""
A["R09_combined_risk"] = "SELECT * FROM risk_all"
A["R10_normalized_evidence"] = f"SELECT * REPLACE ({text('event_timestamp')} AS event_timestamp) FROM revid"
A["R11_sensitivity"] = f"""SELECT variation, {rnd('avg(raw_score)', 2)} AS mean, {rnd('median(raw_score)', 2)} AS median, count(*) FILTER (raw_score >= 60) AS high_critical_count,
  {rnd('count(*) FILTER (raw_score >= 60) / count(*) * 100e0', 2)} AS pct_high_critical FROM (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS variation, raw_score FROM ({scored('udev', _UW, f)})" for n, f in
    (("Baseline (1.0x)", 1.0), ("Sensitivity -10% (0.9x)", 0.9), ("Sensitivity +10% (1.1x)", 1.1))) + ") GROUP BY 1"

# --- T
A["T01_sequence_confidence"] = "SELECT sequence_id, sequence_confidence FROM seqs"
A["T02_sequence_strength"] = "SELECT sequence_id, sequence_strength FROM seqs"
A["T03_user_sequences"] = "SELECT * FROM useq_s"
A["T04_host_sequences"] = "SELECT * FROM hseq_s"
A["T05_bursts"] = "SELECT * FROM bursts_all"
A["T06_sequence_types"] = "SELECT entity_type, sequence_type, count(*) AS n FROM seqs GROUP BY 1, 2"
A["T07_sequence_counter_evidence"] = "SELECT sequence_id, counter_evidence FROM seqs"
A["T08_sequence_evidence"] = """SELECT sequence_id, entity_id, entity_type, event_id, source_dataset, source_record_id, event_timestamp, event_category,
  'step_' || step AS role_in_sequence FROM seq_ev"""
A["T09_pattern_frequency"] = f"""SELECT sequence_type, count(*) AS pattern_occurrence_count, count(DISTINCT entity_id) AS unique_entities, {rnd('avg(event_count)', 2)} AS avg_event_count,
  {rnd('avg(duration_seconds)', 2)} AS avg_duration_sec, CASE WHEN count(*) > 50 THEN 'COMMON' WHEN count(*) >= 10 THEN 'UNUSUAL' ELSE 'RARE' END AS rarity_category FROM seqs GROUP BY 1"""


def _signals(entities: str, key: str, seq: str, extra: str = "") -> str:
    return f"""SELECT e.{key}{extra}, coalesce(n, 0) AS temporal_sequence_count, coalesce(s, 0) AS strongest_sequence_strength, coalesce(v, 0) AS temporal_evidence_count,
  coalesce(c, 0) AS temporal_confidence, coalesce(n, 0) > 0 AS temporal_signal_present FROM {entities} e LEFT JOIN (SELECT entity_id, count(*) AS n, max(sequence_strength) AS s,
  CAST(sum(event_count) AS BIGINT) AS v, max(sequence_confidence) AS c FROM {seq} GROUP BY 1) q ON q.entity_id = e.{key}"""


A["T10_user_signals"] = _signals("identity", "user_id", "useq_s", ", e.username")
A["T10_host_signals"] = _signals("hf", "hostname", "hseq_s")
A["T11_burst_measures"] = f"SELECT burst_category, severity_level, count(*) AS n, {rnd('max(event_density_per_min)', 2)} AS max_density FROM bursts_all GROUP BY 1, 2"

# --- G
A["G01_nodes"] = "SELECT * FROM nodes"
A["G02_edges"] = "SELECT edge_id, source_id, target_id, relationship_type, relationship_confidence, source_dataset, source_record_id, evidence_type FROM edges"
A["G03_metadata"] = """SELECT 'node' AS section, node_type AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', relationship_type, count(*) FROM edges GROUP BY 2
UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges"""
A["G04_node_lookup"] = """SELECT w.node_id, coalesce(n.node_type, 'UNKNOWN') AS node_type, coalesce(n.label, 'NO_VERIFIED_RELATIONSHIP') AS label, coalesce(n.department, 'Unknown') AS department,
  coalesce(n.status, 'Unknown') AS status FROM (SELECT user_id AS node_id FROM iam WHERE user_id IS NOT NULL UNION SELECT 'IP-' || source_ip FROM events_c WHERE source_ip IS NOT NULL
  UNION SELECT role FROM identity_raw WHERE role IS NOT NULL) w LEFT JOIN nodes n ON n.node_id = w.node_id"""
A["G05_connections"] = f"""SELECT 'outbound' AS direction, target_id AS neighbor, relationship_type, edge_id FROM edges WHERE source_id = '{USER}'
UNION ALL SELECT 'inbound', source_id, relationship_type, edge_id FROM edges WHERE target_id = '{USER}'"""
_typed = lambda kind: f"SELECT source_id AS entity_id, target_id AS neighbor FROM edges WHERE relationship_type = '{kind}'"
A["G06_user_hosts"] = _typed("ASSOCIATED_WITH_HOST")
A["G07_host_addresses"] = "SELECT source_id AS entity_id, substr(target_id, 4) AS neighbor FROM edges WHERE relationship_type = 'COMMUNICATED_WITH_IP'"
A["G08_shared_address"] = """SELECT substr(target_id, 4) AS ip_address, source_id AS entity_id, count(*) OVER (PARTITION BY target_id) AS connected_entities_count
FROM edges WHERE starts_with(target_id, 'IP-')"""
A["G09_entity_sequences"] = _typed("INVOLVED_IN_SEQUENCE")
A["G10_risk_evidence"] = """SELECT r.entity_id, r.risk_score, r.risk_level, e.target_id AS event_id FROM risk_all r LEFT JOIN (
  SELECT target_id FROM edges WHERE relationship_type = 'SUPPORTED_BY_EVIDENCE' AND source_id = 'RISK-WS-3') e ON true WHERE r.entity_id = 'WS-3'"""
_HOOD = f"""h0 AS (SELECT '{USER}' AS node_id), h1 AS (SELECT DISTINCT b AS node_id FROM links JOIN h0 ON a = node_id WHERE b NOT IN (FROM h0)),
h2 AS (SELECT DISTINCT b AS node_id FROM links JOIN h1 ON a = node_id WHERE b NOT IN (FROM h0) AND b NOT IN (FROM h1)),
hood AS (SELECT node_id, CAST(0 AS BIGINT) AS depth FROM h0 UNION ALL SELECT node_id, 1 FROM h1 UNION ALL SELECT node_id, 2 FROM h2)"""
A["G11_neighborhood"] = f"FROM (WITH {_HOOD} SELECT node_id, depth FROM hood)"
A["G11_neighborhood_edges"] = f"""FROM (WITH {_HOOD}, ends AS (SELECT edge_id, source_id, target_id, relationship_type, source_id AS node_id FROM edges
  UNION ALL SELECT edge_id, source_id, target_id, relationship_type, target_id FROM edges)
SELECT DISTINCT edge_id, source_id, target_id, relationship_type FROM ends WHERE node_id IN (SELECT node_id FROM hood WHERE depth < 2))"""
A["G11_neighborhood_summary"] = f"""FROM (WITH {_HOOD}, ends AS (SELECT edge_id, source_id AS node_id FROM edges UNION ALL SELECT edge_id, target_id FROM edges)
SELECT '{USER}' AS root_entity, CAST(2 AS BIGINT) AS max_hops, (SELECT count(*) FROM hood) AS node_count, count(*) AS edge_count, count(DISTINCT edge_id) AS distinct_edge_count
FROM ends WHERE node_id IN (SELECT node_id FROM hood WHERE depth < 2))"""
_WALK = f"""w AS (SELECT CAST(0 AS BIGINT) AS step, '{USER}' AS node_id, d FROM dist WHERE node_id = '{USER}'
UNION ALL SELECT any_value(w.step) + 1, min(l.b), any_value(w.d) - 1 FROM w JOIN links l ON l.a = w.node_id JOIN dist t ON t.node_id = l.b AND t.d = w.d - 1 HAVING count(*) > 0)"""
# breadth-first from the target, each node once at its first level
A["G12_shortest_path"] = f"""FROM (WITH RECURSIVE level(node_id, d) USING KEY (node_id) AS (
  SELECT '{TARGET}' AS node_id, CAST(0 AS BIGINT) AS d
  UNION SELECT l.b, level.d + 1 FROM level JOIN links l ON l.a = level.node_id
  WHERE l.b NOT IN (SELECT node_id FROM recurring.level)),
dist AS MATERIALIZED (SELECT node_id, d FROM level), {_WALK} SELECT step, node_id FROM w)"""
A["G13_investigation_context"] = """SELECT r.entity_id, n.node_type AS entity_type, n.label, n.department, n.status, h.hypothesis, h.risk_score, coalesce(o.c, 0) AS outbound_count,
  coalesce(i.c, 0) AS inbound_count, 'READY' AS investigation_readiness FROM risk_all r JOIN nodes n ON n.node_id = r.entity_id JOIN hyps h ON h.entity_id = r.entity_id
LEFT JOIN (SELECT source_id, count(*) AS c FROM edges GROUP BY 1) o ON o.source_id = r.entity_id LEFT JOIN (SELECT target_id, count(*) AS c FROM edges GROUP BY 1) i ON i.target_id = r.entity_id"""
A["G13_context_items"] = """SELECT source_id AS entity_id, 'sequence' AS item_type, target_id AS item_id FROM edges WHERE relationship_type = 'INVOLVED_IN_SEQUENCE'
  AND source_id IN (SELECT entity_id FROM risk_all)
UNION ALL SELECT substr(source_id, 6), 'event', target_id FROM edges WHERE relationship_type = 'SUPPORTED_BY_EVIDENCE'"""
A["G14_scenarios"] = """FROM (WITH u AS (SELECT entity_id FROM urisk ORDER BY risk_score DESC, entity_id LIMIT 1), h AS (SELECT entity_id FROM hrisk ORDER BY risk_score DESC, entity_id LIMIT 1),
ips AS (SELECT coalesce((SELECT min(target_id) FROM edges WHERE relationship_type = 'COMMUNICATED_WITH_IP' AND source_id = (FROM h)),
  (SELECT min(target_id) FROM edges WHERE starts_with(target_id, 'IP-'))) AS e),
s AS (SELECT e.target_id FROM edges e JOIN risk_all r ON r.entity_id = e.source_id WHERE relationship_type = 'INVOLVED_IN_SEQUENCE'
  ORDER BY CASE WHEN r.entity_id = (FROM u) THEN 0 ELSE 1 END, r.risk_score DESC, r.entity_id, e.target_id LIMIT 1)
SELECT 'SCENARIO-01' AS scenario_id, 'Highest Risk User Investigation' AS title, entity_id AS target_entity FROM u
UNION ALL SELECT 'SCENARIO-02', 'High Risk Host Endpoint & Network Investigation', entity_id FROM h
UNION ALL SELECT 'SCENARIO-03', 'Shared Infrastructure IP Investigation', e FROM ips WHERE e IS NOT NULL
UNION ALL SELECT 'SCENARIO-04', 'Temporal Sequence Event Chain Investigation', target_id FROM s)"""
A["G14_scenario_contexts"] = f"""SELECT s.*, n.node_type AS entity_type, n.label, n.department, n.status, coalesce(h.hypothesis, 'NO_ACTIONABLE_HYPOTHESIS') AS hypothesis, h.risk_score,
  (SELECT count(*) FROM edges e WHERE e.source_id = s.target_entity) AS outbound_count, (SELECT count(*) FROM edges e WHERE e.target_id = s.target_entity) AS inbound_count,
  'READY' AS investigation_readiness
FROM ({A['G14_scenarios']}) s LEFT JOIN nodes n ON n.node_id = s.target_entity LEFT JOIN hyps h ON h.entity_id = s.target_entity"""
A["G15_distinct_neighbors"] = _SHARED

# --- I
A["I01_kmeans_converged"] = "SELECT entity_id, CAST(label AS BIGINT) AS label FROM assigned"
A["I04_k_sweep"] = " UNION ALL ".join(
    f"SELECT CAST({k} AS BIGINT) AS k, any_value(loops) AS iterations, {rnd('sum(min_sq)', 2)} AS inertia, {rnd('avg(silhouette_raw)', 4)} AS silhouette FROM {'assigned' if k == 4 else f'assigned{k}'}"
    for k in range(2, 7))
A["I02_inertia"] = f"SELECT {rnd('sum(min_sq)', 2)} AS inertia FROM assigned"
A["I03_silhouette"] = f"SELECT {rnd('avg(silhouette_raw)', 4)} AS silhouette FROM assigned"
A["I05_cluster_assignment"] = "SELECT * FROM clusters"
A["I06_cluster_profiles"] = "SELECT * FROM profiles"
A["I07_drift"] = f"""SELECT entity_id AS user_id, 'CLUSTER_' || label AS assigned_cluster, cluster_label, dd AS drift_distance, ds AS drift_score, {rnd('1e0 / (dd * 0.1e0 + 1e0)', 4)} AS drift_confidence,
  CASE WHEN ds >= 50 OR nearest_label <> label THEN 'HIGH_DRIFT' WHEN ds >= 20 THEN 'MODERATE_DRIFT' ELSE 'STABLE' END AS drift_category, nearest_label <> label AS cluster_changed
FROM (SELECT *, {rnd('least(100e0, dd * 15e0)', 2)} AS ds FROM (SELECT a.*, p.cluster_label, {rnd('own_distance', 4)} AS dd FROM assigned a JOIN profiles p ON p.cluster_id = 'CLUSTER_' || a.label))"""
A["I08_user_outliers"] = "SELECT * FROM uout"
A["I09_host_outliers"] = "SELECT * FROM hout"
A["I10_peer_outliers"] = "SELECT * FROM peers"
_SENS = "cluster_label = 'SECURITY_SENSITIVE_OUTLIERS'"
_HIGH = "risk_level IN ('HIGH', 'CRITICAL')"
A["I11_insight_summary"] = f"""SELECT (SELECT count(*) FROM clusters) AS total_users_clustered, (SELECT count(DISTINCT cluster_id) FROM clusters) AS cluster_count,
  (SELECT count(*) FROM clusters WHERE {_SENS}) AS sensitive_cluster_users, (SELECT count(*) FROM clusters WHERE {_SENS} AND {_HIGH}) AS sensitive_cluster_high_risk,
  (SELECT {rnd('sum(min_sq)', 2)} FROM assigned) AS inertia, (SELECT {rnd('avg(silhouette_raw)', 4)} FROM assigned) AS silhouette_score,
  (SELECT count(*) FROM outliers WHERE is_multi_dimensional_outlier) AS multi_dimensional_outlier_count,
  (SELECT count(*) FROM peers WHERE global_vs_peer_behavior = 'NORMAL_GLOBALLY_ANOMALOUS_PEER') AS peer_group_hidden_insiders_count,
  (SELECT count(*) FROM bursts_all) AS temporal_burst_count, t.node_id AS top_shared_ip, t.neighbors AS top_shared_ip_users FROM ({A['O05_top_group']}) t"""
A["I12_risk_concentration"] = f"""SELECT count(*) FILTER ({_SENS}) AS cluster_users, count(*) FILTER ({_HIGH}) AS all_high_critical, count(*) FILTER ({_HIGH} AND {_SENS}) AS cluster_high_critical,
  {rnd(f"CASE WHEN count(*) FILTER ({_HIGH}) > 0 THEN count(*) FILTER ({_HIGH} AND {_SENS}) * 100e0 / count(*) FILTER ({_HIGH}) ELSE 0e0 END", 2)} AS concentration_pct FROM clusters"""

# --- L
A["L01_posture"] = """SELECT (SELECT count(*) FROM urisk) AS total_users, (SELECT count(*) FROM urisk WHERE risk_level = 'CRITICAL') AS critical_users,
  (SELECT count(*) FROM urisk WHERE risk_level = 'HIGH') AS high_users, (SELECT count(*) FROM hrisk) AS total_hosts, (SELECT count(*) FROM seqs) AS sequence_count,
  (SELECT count(*) FROM outliers WHERE is_multi_dimensional_outlier) AS multi_dimensional_outliers, (SELECT count(*) FROM peers WHERE peer_outlier_flag) AS peer_outliers"""
A["L02_quadrants"] = """SELECT CASE WHEN risk_score >= 60 AND risk_confidence_score >= 0.5 THEN 'Q1' WHEN risk_score >= 60 THEN 'Q2' WHEN risk_confidence_score >= 0.5 THEN 'Q3' ELSE 'Q4' END AS quadrant,
  count(*) AS entities FROM risk_all GROUP BY 1"""


def _triage(order: str, filt: str = "true") -> str:
    return f"""SELECT r.entity_id, r.username, r.department, r.risk_level, r.risk_score, r.risk_confidence_score, r.risk_confidence_level, k.cluster_id, k.cluster_label, r.primary_hypothesis
FROM urisk r LEFT JOIN clusters k ON k.user_id = r.entity_id WHERE {filt} ORDER BY {order}r.entity_id LIMIT 50"""


A["L03_triage_by_risk"] = _triage("r.risk_score DESC, ")
A["L03_triage_filtered"] = _triage("r.risk_confidence_score DESC, ",
                                   "r.risk_level IN ('MODERATE', 'HIGH', 'CRITICAL') AND (r.entity_id ILIKE '%emp1%' OR r.username ILIKE '%emp1%')")
A["L03_triage_by_cluster"] = _triage("k.cluster_id DESC NULLS LAST, ")
A["L03_triage_by_entity"] = _triage("")
A["L04_cluster_population"] = "SELECT cluster_label, count(*) AS n FROM clusters GROUP BY 1"
A["L05_risk_rows"] = """SELECT w.user_id AS entity_id, r.entity_id IS NOT NULL AS found, coalesce(r.risk_score, 0) AS risk_score, coalesce(r.risk_level, 'LOW') AS risk_level,
  coalesce(r.risk_confidence_score, 0.5e0) AS risk_confidence_score, coalesce(r.risk_confidence_level, 'MEDIUM') AS risk_confidence_level, r.primary_hypothesis
FROM (SELECT DISTINCT user_id FROM iam WHERE user_id IS NOT NULL) w LEFT JOIN risk_all r ON r.entity_id = w.user_id"""
A["L06_behavior_profile"] = f"""SELECT r.entity_id, coalesce(k.cluster_label, 'CLUSTER_0') AS cluster_label, failed_login_count AS observed_values_failed_login_count,
  {rnd('authentication_failure_rate', 6)} AS observed_values_authentication_failure_rate, off_hours_activity_count AS observed_values_off_hours_activity_count,
  endpoint_alert_count AS observed_values_endpoint_alert_count, {', '.join(f'{d}_deviation AS z_deviations_{d}_deviation' for d in _UW)}
FROM urisk r LEFT JOIN clusters k ON k.user_id = r.entity_id"""
A["L07_peer_comparison"] = f"""SELECT r.entity_id, coalesce(p.peer_outlier_flag, false) AS peer_outlier_flag, r.department,
  {rnd('r.department_failed_login_percentile', 4)} AS department_failed_login_percentile, {rnd('r.peer_failed_login_median', 4)} AS peer_failed_login_median
FROM urisk r LEFT JOIN peers p ON p.user_id = r.entity_id"""
_FIRST = """SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY start_time, sequence_id) AS rank, sequence_id, sequence_type, event_count,
  count(*) OVER (PARTITION BY entity_id) AS sequence_count FROM seqs QUALIFY rank <= 5"""
A["L08_first_sequences"] = _FIRST
_BYSRC = """SELECT entity_id, source_dataset, row_number() OVER (PARTITION BY entity_id, source_dataset ORDER BY event_id) AS rank, event_id, severity, action FROM revid QUALIFY rank <= 10"""
A["L09_evidence_by_source"] = _BYSRC
A["L10_shared_address_connections"] = """SELECT entity_id, edge_id, relationship_type, neighbor, relationship_confidence, source_dataset, source_record_id FROM (
  SELECT source_id AS entity_id, target_id AS neighbor, * FROM edges UNION ALL SELECT target_id, source_id, * FROM edges) WHERE relationship_type IN ('CONNECTED_FROM_IP', 'COMMUNICATED_WITH_IP')"""
A["L10_shared_address_links"] = """SELECT entity_id, count(*) AS shared_ip_count, count(*) FILTER (relationship_type = 'CONNECTED_FROM_IP') AS session_links,
  count(*) FILTER (relationship_type = 'COMMUNICATED_WITH_IP') AS flow_links FROM (SELECT source_id AS entity_id, relationship_type FROM edges UNION ALL SELECT target_id, relationship_type FROM edges)
WHERE relationship_type IN ('CONNECTED_FROM_IP', 'COMMUNICATED_WITH_IP') GROUP BY 1"""
A["L11_high_risk_entities"] = "SELECT entity_id, department, risk_score, risk_level, risk_confidence_level FROM urisk WHERE risk_level = 'MODERATE' ORDER BY risk_score DESC, entity_id LIMIT 20"
A["L11_high_risk_by_department"] = "SELECT department, count(*) AS n FROM urisk WHERE risk_level IN ('MODERATE', 'HIGH', 'CRITICAL') GROUP BY 1"
A["L12_cluster_profile"] = "SELECT * FROM profiles WHERE cluster_id = 'CLUSTER_1'"
_LIN = "'{0}' AS entity_type, '{1}' AS source_datasets, '{2}' AS cleaned_table, '{3}' AS canonical_table, '{4}' AS feature_table, '{5}' AS risk_table"
_IEF = "iam, endpoint, firewall"
_CL3 = "clean_iam, clean_endpoint, clean_firewall"
A["L13_provenance"] = f"""FROM (WITH w AS (SELECT event_id AS entity_id FROM events_c UNION SELECT user_id FROM iam WHERE user_id IS NOT NULL UNION SELECT hostname FROM endpoint WHERE hostname IS NOT NULL
  UNION SELECT sequence_id FROM seqs UNION SELECT event_type FROM iam_raw),
k AS (SELECT entity_id, 0 AS rk, {_LIN.format('User Identity', 'identity, iam, endpoint', 'clean_identity', 'canonical_users', 'user_features', 'user_risk')}, risk_score, risk_level,
    'REPAIRED & VALIDATED' AS data_quality_status FROM urisk
  UNION ALL SELECT entity_id, 1, {_LIN.format('Host Device', 'identity, endpoint, firewall', 'clean_identity, clean_endpoint', 'canonical_hosts', 'host_features', 'host_risk')}, risk_score, risk_level,
    'CANONICALIZED & VALIDATED' FROM hrisk
  UNION ALL SELECT sequence_id, 2, {_LIN.format('Temporal Sequence', _IEF, _CL3, 'canonical_events', 'temporal_sequences', 'temporal_bursts')}, NULL, NULL, 'TEMPORALLY CHAINED' FROM seqs
  UNION ALL SELECT event_id, 3, {_LIN.format('Canonical Event', _IEF, _CL3, 'canonical_events', 'event_features', 'normalized_evidence')}, NULL, NULL, data_quality_status FROM events_c)
SELECT w.entity_id, k.entity_id IS NOT NULL AS found, k.entity_type, source_datasets, cleaned_table, canonical_table, feature_table, risk_table, risk_score, risk_level, data_quality_status
FROM w LEFT JOIN k ON k.entity_id = w.entity_id QUALIFY row_number() OVER (PARTITION BY w.entity_id ORDER BY rk) = 1)"""
A["L14_evidence_packages"] = f"""FROM (WITH f AS ({_FIRST}), v AS ({_BYSRC}),
d AS (SELECT id, count(*) AS c FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1),
fs AS (SELECT entity_id, any_value(sequence_count) AS c, string_agg(sequence_id, '; ' ORDER BY rank) AS ids FROM f GROUP BY 1),
vs AS (SELECT entity_id, string_agg(event_id, '; ' ORDER BY source_dataset, rank) AS ids FROM v GROUP BY 1)
SELECT r.entity_id, r.risk_score, p.peer_outlier_flag, coalesce(fs.c, 0) AS sequence_count, fs.ids AS first_sequences, vs.ids AS first_events, coalesce(d.c, 0) AS edge_count
FROM risk_all r LEFT JOIN peers p ON p.user_id = r.entity_id LEFT JOIN fs ON fs.entity_id = r.entity_id LEFT JOIN vs ON vs.entity_id = r.entity_id LEFT JOIN d ON d.id = r.entity_id)"""
A["L15_entity_resolution"] = """FROM (WITH t AS (SELECT DISTINCT upper(nullif(trim(term), '')) AS q FROM (SELECT department AS term FROM identity_raw UNION ALL SELECT user_id FROM iam_raw
  UNION ALL SELECT hostname FROM firewall_raw UNION ALL SELECT hostname FROM iam_raw UNION ALL SELECT sequence_id FROM useq_s)),
x AS (SELECT upper(entity_id) AS id, 0 AS rk, 'user' AS kind FROM urisk UNION ALL SELECT upper(entity_id), 1, 'host' FROM hrisk UNION ALL SELECT upper(sequence_id), 2, 'sequence' FROM seqs),
hit AS (SELECT q, arg_min(kind, rk) AS kind FROM t JOIN x ON x.id = t.q GROUP BY 1),
part AS (SELECT q, count(*) AS n, min(id) AS id, string_agg(id, '; ' ORDER BY id) AS ids FROM (
  SELECT q, upper(u.entity_id) AS id FROM t JOIN urisk u ON contains(upper(u.entity_id), q) OR contains(upper(u.department), q) WHERE q NOT IN (SELECT q FROM hit)
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY upper(u.entity_id)) <= 5) GROUP BY 1)
SELECT t.q AS term, CASE WHEN hit.q IS NOT NULL OR n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS status,
  coalesce(kind, CASE WHEN n = 1 THEN 'user' END) AS entity_type, coalesce(hit.q, CASE WHEN n = 1 THEN part.id END) AS entity_id, CASE WHEN n > 1 THEN ids END AS candidates
FROM t LEFT JOIN hit ON hit.q = t.q LEFT JOIN part ON part.q = t.q WHERE t.q IS NOT NULL)"""
_QUESTIONS = """(SELECT 'c' || conv_id || '-' || turn AS id, text FROM conversations UNION ALL SELECT 'd' || doc_id, text FROM documents
UNION ALL SELECT alert_id, concat_ws(' ', 'why is', user_id, 'on host', hostname, description) FROM endpoint_raw
UNION ALL SELECT 's' || sequence_id, concat('what led to ', sequence_id) FROM seqs)"""


# written from the id shapes: sequence, user, machine, custom token, named host, address
_SHAPES = [r"\b(SEQ-(USR|HST)-[A-Z0-9-]+-\d+|SEQ-[A-Z]+-\d+|SEQ_\d+)\b", r"\b(EMP\d+)\b", r"\b((VDR|WS|LPT)[-_]\d+)\b", r"\b(USER_[A-Z0-9_-]+|HOST_[A-Z0-9_-]+|DOES_NOT_EXIST|[A-Z]+_\d{5,})\b",
           r"\bhost\s+([A-Z0-9_-]+)\b", r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"]


def _found(i: int) -> str:
    hit = f"upper(nullif(regexp_extract(text, {q(_SHAPES[i])}, 1, 'i'), ''))"
    return f"replace({hit}, '_', '-')" if i == 2 else hit


_ENTITY = "coalesce(" + ", ".join(_found(i) for i in range(6)) + ")"
A["L16_entity_in_text"] = f"SELECT id, {_ENTITY} AS entity FROM {_QUESTIONS}"
_has = lambda n: "(" + " OR ".join(f"contains(lower(text), {q(w)})" for w in fv.INTENT_WORDS[n]) + ")"
A["L17_intent"] = f"""SELECT id, CASE WHEN {_has('peer_comparison')} THEN 'peer_comparison' WHEN {_has('graph')} AND contains(lower(text), 'ip') THEN 'analyze_shared_ip'
  WHEN {_has('graph')} THEN 'graph_relationship' WHEN {_has('analyze_temporal_sequence')} THEN 'analyze_temporal_sequence' WHEN {_has('data_quality_question')} THEN 'data_quality_question'
  WHEN {_has('find_high_risk_entities')} AND {_ENTITY} IS NULL THEN 'find_high_risk_entities' WHEN {_ENTITY} IS NOT NULL THEN 'investigate_entity' ELSE 'general_security_summary' END AS intent
FROM {_QUESTIONS}"""
_SIG = ["auth", "network", "endpoint", "operational"]
_TOP = f"greatest({', '.join(f'{s}_contribution' for s in _SIG)})"
_STR = f"SELECT entity_id, entity_type, CASE {_TOP} {' '.join(f'WHEN {s}_contribution THEN {q(s)}' for s in _SIG)} END AS strongest_signal, {_TOP} AS points FROM "
A["L18_strongest_signal"] = _STR + "urisk UNION ALL " + _STR + "hrisk"
A["L19_timelines"] = f"""SELECT user_id AS entity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, event_id, {text('ts')} AS event_timestamp, source_dataset, event_category, action
FROM events_c WHERE user_id IS NOT NULL AND ts IS NOT NULL QUALIFY rank <= 20"""
_day = lambda c: f"strftime({c}, '%Y-%m-%d') AS day"
A["L20_failed_logins_by_department"] = f"SELECT {_day('timestamp')}, coalesce(department, 'Unknown') AS department, count(*) AS failed_logins FROM iam WHERE event_type = 'login_failed' AND timestamp IS NOT NULL GROUP BY 1, 2"
A["L20_top_failed_users"] = "SELECT user_id, count(*) AS failed_logins FROM iam WHERE event_type = 'login_failed' AND user_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
A["L20_alerts_by_severity"] = "SELECT alert_name, coalesce(severity, 'Unknown') AS severity, count(*) AS alerts FROM endpoint GROUP BY 1, 2"
A["L20_deny_trend"] = f"SELECT {_day('timestamp')}, coalesce(protocol, 'Unknown') AS protocol, count(*) AS denies FROM firewall WHERE action = 'DENY' AND timestamp IS NOT NULL GROUP BY 1, 2"
A["L20_actions_by_protocol"] = "SELECT coalesce(protocol, 'Unknown') AS protocol, count(*) FILTER (action = 'ALLOW') AS allowed, count(*) FILTER (action = 'DENY') AS denied FROM firewall GROUP BY 1"
_CHRON = f"{rnd('(epoch_us(resolved_timestamp) - epoch_us(detected_timestamp)) / 3.6e9', 4)} AS duration_hours"
A["L20_impossible_resolution"] = f"SELECT alert_id, {_CHRON} FROM endpoint WHERE chronology_issue"
A["L20_threat_flag_hosts"] = "SELECT hostname, count(*) AS threat_flags FROM firewall WHERE threat_flag AND hostname IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
A["L20_mfa_failure_trend"] = f"SELECT {_day('timestamp')}, count(*) AS mfa_failures FROM iam WHERE NOT mfa_passed AND timestamp IS NOT NULL GROUP BY 1"
A["L20_failures_and_alerts"] = "SELECT user_id, failed_login_count, endpoint_alert_count FROM uf WHERE failed_login_count >= 2 AND endpoint_alert_count > 0"
A["L20_critical_alerts_by_day"] = f"SELECT {_day('detected_timestamp')}, count(*) AS critical_alerts FROM endpoint WHERE severity = 'Critical' AND detected_timestamp IS NOT NULL GROUP BY 1"

# --- Q
_prof = lambda t, ds, cols: " UNION ALL ".join(
    f"SELECT '{ds}' AS dataset, '{x}' AS column_name, count(*) AS row_count, 'string' AS dtype, count(*) - count({x}) AS missing_count, "
    f"{pct(f'(count(*) - count({x}))', 'count(*)')} AS missing_percentage, count(DISTINCT {x}) AS unique_count FROM {t}" for x in cols)
A["Q01_column_profile"] = over_raw(lambda t, cols, n: _prof(t, n, cols))
A["Q02_missing_report"] = f"SELECT dataset, column_name, missing_count, missing_percentage FROM ({A['Q01_column_profile']})"
A["Q03_top_values"] = over_raw(lambda t, cols, n: f"SELECT '{n}' AS dataset, column_name, coalesce(value, 'nan') AS value, n FROM (" + " UNION ALL ".join(
    f"(SELECT '{x}' AS column_name, {x} AS value, count(*) AS n FROM {t} GROUP BY 2 ORDER BY n DESC, value ASC NULLS FIRST LIMIT 50)" for x in cols) + ")")
_SPELLED = {"identity": ["department", "status"], "iam": ["department", "event_type", "auth_method"], "endpoint": ["severity", "status"], "firewall": ["protocol", "action"]}
A["Q04_variations"] = over_raw(lambda t, cols, n: _var(t, n, _SPELLED[n]))
A["Q05_timestamp_profile"] = " UNION ALL ".join(f"""SELECT '{n}' AS dataset, '{x}' AS column_name, count(*) AS total_rows, count(*) - count(t) AS raw_missing, count(t) AS non_missing, count(v) AS parseable_values,
  count(t) - count(v) AS parse_failures, count(DISTINCT t) AS unique_raw_values, {pct('count(v)', 'count(t)')} AS parse_success_rate_pct
FROM (SELECT {trim(x)} AS t, {when(trim(x), day_first=first)} AS v FROM {n}_raw)""" for n, x, first in RAW_TIMES)
A["Q06_parse_failures"] = " UNION ALL ".join(
    f"(SELECT DISTINCT {trim(x)} AS raw_value, '{n}' AS dataset, '{x}' AS column_name FROM {n}_raw WHERE {trim(x)} IS NOT NULL AND {when(trim(x), day_first=first)} IS NULL ORDER BY 1 LIMIT 100)"
    for n, x, first in RAW_TIMES)
A["Q07_chronology_issues"] = f"SELECT alert_id, {text('detected_timestamp')} AS detected, {text('resolved_timestamp')} AS resolved, user_id, hostname, severity, status, {_CHRON} FROM endpoint WHERE chronology_issue"
A["Q08_invalid_values"] = f"SELECT sha256 AS raw_value, {_status} AS status, count(*) AS n FROM endpoint_raw GROUP BY 1, 2 HAVING status NOT IN ('valid_sha256', 'missing')"


def _valid(kind: str, col: str, parsed: str) -> str:
    return f"""SELECT 'firewall' AS dataset, '{col}' AS field, '{kind}' AS field_type, count(*) FILTER ({trim(col)} IS NULL) AS missing, count(*) FILTER ({parsed} IS NOT NULL) AS valid,
  count(*) FILTER ({trim(col)} IS NOT NULL AND {parsed} IS NULL) AS invalid FROM firewall_raw"""


A["Q09_validity_profile"] = " UNION ALL ".join(
    [_valid("IP address", x, ip(x)) for x in ("src_ip", "dst_ip")] + [_valid("Port", x, port(x, 0)) for x in ("src_port", "dst_port")]
    + [_valid("Bytes", x, size(x, True)) for x in ("bytes_sent", "bytes_received")])
A["Q10_key_normalization"] = f"""SELECT 'iam' AS dataset, CASE WHEN user_id IS NULL THEN 'missing' WHEN {uid('user_id')} IS NULL THEN 'invalid' ELSE 'normalized' END AS normalization_status,
  CASE WHEN {uid('user_id')} IS NOT NULL THEN {uid('user_id')} IN (FROM known_users) END AS identity_match, count(*) AS rows FROM iam_raw GROUP BY 1, 2, 3"""
A["Q11_reconciliation"] = " UNION ALL ".join(
    f"""SELECT '{n}' AS dataset, r AS raw_rows, r - c AS exact_duplicates_removed, c AS cleaned_rows, {pct('c', 'r')} AS rows_retained_percent, {pct('(r - c)', 'r')} AS rows_removed_percent
FROM (SELECT (SELECT count(*) FROM {n}_raw) AS r, (SELECT count(*) FROM {n}) AS c)""" for n in ("identity", "iam", "endpoint", "firewall"))
A["Q12_cleaning_summary"] = " UNION ALL ".join(
    f"SELECT 'endpoint' AS dataset, 'unusable' AS measure, '{x}' AS field, CAST(count(*) - count({x}) AS DOUBLE) AS value FROM endpoint_parsed"
    for x in ("user_id", "severity", "detected_timestamp", "sha256")
) + f" UNION ALL SELECT 'endpoint', 'median', 'duration_hours', {rnd('median(duration_hours)', 2)} FROM endpoint_parsed" + "".join(
    f" UNION ALL SELECT 'firewall', 'unusable', '{x}', CAST(count(*) - count({x}) AS DOUBLE) FROM firewall_parsed"
    for x in ("timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "bytes_sent", "bytes_received")
) + "".join(
    f" UNION ALL SELECT 'firewall', 'median', '{x}', {rnd(f'median({x})', 2)} FROM firewall_parsed" for x in ("src_port", "dst_port", "bytes_sent", "bytes_received")
) + "".join(
    f" UNION ALL SELECT '{n}', 'rows', '{field}', CAST({value} AS DOUBLE) FROM (SELECT (SELECT count(*) FROM {n}_raw) AS r, (SELECT count(*) FROM {n}) AS c)"
    for n in ("endpoint", "firewall") for field, value in (("raw_rows", "r"), ("exact_duplicates_removed", "r - c"), ("cleaned_rows", "c")))


def _schema(name: str, have: list[str], expected: list[str]) -> str:
    lost, extra = [x for x in expected if x not in have], [x for x in have if x not in expected]
    ordered = [x for x in have if x in expected] == [x for x in expected if x in have]
    facts = [("missing columns", ", ".join(lost)), ("unexpected columns", ", ".join(extra)), ("column order", "" if ordered else "differs")]
    rows = " UNION ALL ".join(f"SELECT '{name}' AS table_name, '{n}' AS check_name, '{'FAIL' if d else 'PASS'}' AS status, '{d}' AS details" for n, d in facts)
    return f"{rows} UNION ALL SELECT '{name}', 'row count', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END, CAST(count(*) AS VARCHAR) FROM {name}"


_FINAL = {"identity": clean.IDENTITY_COLUMNS, "iam": clean.IAM_COLUMNS, "endpoint": clean.ENDPOINT_COLUMNS, "firewall": clean.FIREWALL_COLUMNS}
A["Q13_schema_report"] = " UNION ALL ".join(_schema(t, have, _FINAL[n]) for n, raw in RAW_COLS.items() for t, have in ((n, _FINAL[n]), (f"{n}_raw", raw)))


def checks(parts: list[tuple[str, str, str]]) -> str:
    """(table label, check, violation count query) rows to a report."""
    rows = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {q(n)} AS check_name, ({s}) AS violations" for t, n, s in parts)
    return f"SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({rows})"


def bad(table: str, rule: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE NOT coalesce({rule}, false)"


def rep(table: str, keys: str) -> str:
    return f"SELECT count(*) FROM (SELECT 1 FROM {table} GROUP BY {keys} HAVING count(*) > 1)"


A["Q14_key_checks"] = checks([
    ("iam", "duplicate rows", f"SELECT count(*) FROM (SELECT 1 FROM ({X_IAM}) GROUP BY ALL HAVING count(*) > 1)".replace("SELECT 1 FROM", "SELECT * FROM")
     .replace("GROUP BY ALL HAVING count(*) > 1", "GROUP BY ALL HAVING count(*) > 1")),
    ("iam", "unique event_id", rep("iam", "event_id")), ("identity", "unique user_id", rep("identity", "user_id")),
    ("endpoint", "unique alert_id", rep("endpoint", "alert_id")), ("firewall", "unique log_id", rep("firewall", "log_id"))])
_EX, _FX = f"({X_ENDPOINT})", f"({X_FIREWALL})"
_Q15 = [
    ("endpoint", "severity", bad(_EX, "severity IN ('Critical','High','Medium','Low','Unknown')")),
    ("endpoint", "user_id format", bad(_EX, "regexp_full_match(user_id, 'EMP[0-9]+') OR user_id = 'Unknown'")),
    ("endpoint", "sha256 format", bad(_EX, "regexp_full_match(sha256, '[0-9a-f]{64}') OR sha256 = 'Unknown'")),
    ("endpoint", "known severity", bad(_EX, "severity <> 'Unknown'")),
    ("firewall", "protocol", bad(_FX, "protocol IN ('TCP','UDP','ICMP','Unknown')")),
    ("firewall", "action", bad(_FX, "action IN ('ALLOW','DENY','Unknown')")),
    ("firewall", "hostname canonical", bad(_FX, "hostname = upper(hostname) OR hostname = 'Unknown'")),
]
_Q16 = [
    ("risk", "risk in 0..100", bad("risk_all", "risk_score BETWEEN 0 AND 100")),
    ("risk", "confidence in 0..1", bad("risk_all", "risk_confidence_score BETWEEN 0 AND 1")),
    ("risk", "risk under 30", bad("risk_all", "risk_score < 30")),
    ("user_features", "failure rate in 0..1", bad("uf", "authentication_failure_rate BETWEEN 0 AND 1")),
    ("user_features", "counts not negative", bad("uf", "failed_login_count >= 0")),
    ("firewall", "ports", bad("firewall", "dst_port BETWEEN 1 AND 65535")),
    ("firewall", "bytes", bad("firewall", "bytes_sent >= 0")),
]
A["Q15_domain_checks"] = checks(_Q15)
_DEPARTMENTS = words(["IT", "Human Resources", "Finance", "Operations", "Procurement", "Marketing", "Sales", "Legal", "R&D", "Customer Support",
                      "Support", "Call Center", "Brand", "Compliance", "Innovation", "Supply Chain", "IT Support", "Unknown"])
_EMPLOYED = "status NOT IN ('Active','On Leave','Disabled','Blocked')"


def filled(names: list[str]) -> str:
    return " AND ".join(f"{x} IS NOT NULL" for x in names)


def twice(table: str) -> str:
    return f"SELECT count(*) FROM (SELECT * FROM {table} GROUP BY ALL HAVING count(*) > 1)"


_IX, _MX = f"({X_IDENTITY})", f"({X_IAM})"
A["Q15_identity_suite"] = checks([("identity", n, s) for n, s in [
    ("no missing cell", bad(_IX, filled(clean.IDENTITY_COLUMNS))),
    ("user_id format", bad(_IX, "regexp_full_match(user_id, 'EMP[0-9]+')")),
    ("department", bad(_IX, f"department IN {_DEPARTMENTS}")),
    ("status", bad(_IX, "status IN ('Active','On Leave','Disabled','Blocked','Terminated','Unknown')")),
    ("hire date", bad(_IX, "hire_date = 'Unknown' OR try_cast(hire_date AS TIMESTAMP) IS NOT NULL")),
    ("termination date", bad(_IX, "termination_date IN ('Unknown','Not Terminated') OR try_cast(termination_date AS TIMESTAMP) IS NOT NULL")),
    ("terminated is not open", bad(_IX, "status <> 'Terminated' OR termination_date <> 'Not Terminated'")),
    ("terminated has a date", bad(_IX, "status <> 'Terminated' OR termination_date <> 'Unknown'")),
    ("employed end is known", bad(_IX, f"{_EMPLOYED} OR termination_date <> 'Unknown'")),
    ("employed has no end", bad(_IX, f"{_EMPLOYED} OR termination_date IN ('Unknown','Not Terminated')")),
    ("hired before the end", bad(_IX, "coalesce(try_cast(hire_date AS TIMESTAMP) <= try_cast(termination_date AS TIMESTAMP), true)")),
    ("duplicate rows", twice(_IX)), ("unique user_id", rep(_IX, "user_id"))]])
A["Q15_iam_suite"] = checks([("iam", n, s) for n, s in [
    ("no missing cell", bad(_MX, filled(clean.IAM_COLUMNS))),
    ("user_id format", bad(_MX, "regexp_full_match(user_id, 'EMP[0-9]+')")),
    ("department", bad(_MX, f"department IN {_DEPARTMENTS}")),
    ("event type", bad(_MX, "event_type IN ('login_success','login_failed','other')")),
    ("mfa", bad(_MX, "mfa_passed IN ('True','False','Unknown')")),
    ("source address", bad(_MX, "source_ip = 'Unknown' OR source_ip LIKE '%:%' OR regexp_full_match(source_ip, '([0-9]{1,3}[.]){3}[0-9]{1,3}')")),
    ("risk in 0..100", bad(_MX, "risk_score BETWEEN 0 AND 100")),
    ("timestamp", bad(_MX, "timestamp = 'Unknown' OR try_cast(timestamp AS TIMESTAMP) IS NOT NULL")),
    ("no failure, no reason", bad(_MX, "event_type = 'login_failed' OR failure_reason IN ('Not Applicable','Unknown')")),
    ("failed login has no n/a reason", bad(_MX, "event_type <> 'login_failed' OR failure_reason <> 'Not Applicable'")),
    ("duplicate rows", twice(_MX)), ("unique event_id", rep(_MX, "event_id"))]])
A["Q16_range_checks"] = checks(_Q16)
A["Q17_null_checks"] = checks(
    [("iam", f"{x} filled", bad(f"({X_IAM})", f"{x} IS NOT NULL")) for x in clean.IAM_COLUMNS]
    + [("iam_raw", f"{x} not blank", bad("iam_raw", f"coalesce({trim(x)}, '') <> ''")) for x in ("timestamp", "source_ip", "geo_location")])
A["Q18_cross_column_checks"] = checks([
    ("identity", "not terminated has no end", bad(f"({X_IDENTITY})", "status = 'Terminated' OR termination_date = 'Not Terminated'")),
    ("identity", "terminated is not open", bad(f"({X_IDENTITY})", "status <> 'Terminated' OR termination_date <> 'Not Terminated'")),
    ("iam", "failed login has no n/a reason", bad("iam", "event_type <> 'login_failed' OR coalesce(failure_reason, '?') <> 'Not Applicable'")),
    ("risk", "level fits score", bad("risk_all", f"risk_level = {_LEVEL}")),
    ("user_baselines", "counts add up", bad("ub", "observation_count = valid_timestamp_count + unknown_timestamp_count")),
])
_TYPES = words(["BELONGS_TO", "ASSOCIATED_WITH_HOST", "TRIGGERED_EVENT", "AUTHENTICATED_VIA", "CONNECTED_FROM_IP", "COMMUNICATED_WITH_IP",
                "HAS_RISK_ASSESSMENT", "SUPPORTED_BY_EVIDENCE", "INVOLVED_IN_SEQUENCE", "SEQUENCE_INCLUDES_EVENT"])
A["Q19_graph_checks"] = checks([
    ("edges", "provenance", bad("edges", "source_dataset IS NOT NULL AND source_record_id IS NOT NULL AND source_dataset <> 'Unknown'")),
    ("edges", "no self-loop", bad("edges", "source_id <> target_id")),
    ("edges", "known type", bad("edges", f"relationship_type IN {_TYPES}")),
    ("edges", "known confidence", bad("edges", "relationship_confidence IN ('EXACT','PROBABLE','UNMATCHED')")),
    ("nodes", "unique node", rep("nodes", "node_id")),
    ("edges", "unique edge", rep("edges", "source_id, target_id, relationship_type")),
    ("edges", "source exists", "SELECT count(DISTINCT source_id) FROM edges WHERE source_id NOT IN (SELECT node_id FROM nodes)"),
    ("edges", "target exists", "SELECT count(DISTINCT target_id) FROM edges WHERE target_id NOT IN (SELECT node_id FROM nodes)"),
])
A["Q20_temporal_checks"] = checks([
    ("sequences", "start before end", bad("seqs", "start_time <= end_time")),
    ("sequences", "within window", bad("seqs", "duration_seconds BETWEEN 0 AND 3600")),
    ("sequences", "two or more events", bad("seqs", "event_count >= 2")),
    ("sequence_evidence", "known time", bad("seq_ev", "event_timestamp IS NOT NULL")),
    ("sequence_evidence", "events exist", "SELECT count(DISTINCT event_id) FROM seq_ev WHERE event_id NOT IN (SELECT event_id FROM events_c)"),
    ("sequences", "unique sequence", rep("seqs", "sequence_id")),
])
A["Q21_report_totals"] = f"""SELECT table_name, count(*) AS checks, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed
FROM ({checks(_Q15 + _Q16)}) GROUP BY 1"""
A["Q22_finite_numbers"] = checks([
    ("user_risk", f"{x} is a finite number", bad("urisk", f"isfinite({x})")) for x in ("failed_login_zscore", "off_hours_zscore", "behavior_deviation_score", "source_risk_max")])


def all_sql() -> dict[str, str]:
    return {name: assemble(sql) for name, sql in A.items()}
