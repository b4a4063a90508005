"""Named SQL steps; :func:`assemble` adds the ones a query needs."""

from __future__ import annotations

import re

from vantry.functions import fixed_values as fv
from vantry.sources.fixtures import RAW_SQL, render

US_HOUR = 3_600_000_000


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "(" + ", ".join(q(w) for w in items) + ")"


def mapped(key: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {key} IN {words(a)} THEN {q(label)}" for label, a in table.items())
    return f"CASE {arms} ELSE {default} END"


def trim(c: str) -> str:
    return f"nullif(trim(CAST({c} AS VARCHAR)), '')"


def na(c: str) -> str:
    return f"CASE WHEN upper(trim({c})) NOT IN {words(fv.NA_TOKENS)} THEN trim({c}) END"


def rnd(x: str, n: int) -> str:
    return f"(floor(({x}) * 1e{n} + 0.5e0) / 1e{n})"


def squeeze(c: str) -> str:
    return f"regexp_replace({trim(c)}, '\\s+', ' ', 'g')"


def cat_key(c: str) -> str:
    return f"trim(regexp_replace(upper({trim(c)}), '[\\s_-]+', ' ', 'g'))"


def bare(c: str) -> str:
    return f"regexp_replace(upper({c}), '[\\s_-]+', '', 'g')"


def uid(c: str) -> str:
    b = bare(trim(c))
    return f"CASE WHEN regexp_full_match({b}, '(EMP)?[0-9]+') THEN 'EMP' || regexp_extract({b}, '[0-9]+$') END"


def host(c: str) -> str:
    return f"regexp_replace(replace(upper({trim(c)}), '_', '-'), '\\.CORP\\.LOCAL$', '')"


NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
V4 = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}"


def num(t: str) -> str:
    return f"CASE WHEN regexp_full_match({t}, {q(NUM)}) THEN TRY_CAST({t} AS DOUBLE) END"


def port(c: str, low: int = 1) -> str:
    n = f"({num(trim(c))})"
    return f"CASE WHEN {n} = floor({n}) AND {n} BETWEEN {low} AND 65535 THEN CAST({n} AS INTEGER) END"


def size(c: str, negative: bool = False) -> str:
    t = f"upper({trim(c)})"
    plain = f"({num(t)})"
    if not negative:
        plain = f"CASE WHEN {plain} >= 0 THEN {plain} END"
    unit = rf"^[0-9]+(\.[0-9]+)?\s*(B|KB|MB|GB)$"
    amount = f"CAST(regexp_extract({t}, '^[0-9]+(\\.[0-9]+)?') AS DOUBLE)"
    mult = f"CASE regexp_extract({t}, '[A-Z]+$') WHEN 'B' THEN 1 WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 ELSE 1073741824 END"
    return f"coalesce({plain}, CASE WHEN regexp_matches({t}, {q(unit)}) THEN {amount} * {mult} END)"


def ip(c: str) -> str:
    return f"CASE WHEN regexp_full_match({trim(c)}, {q(V4)}) THEN {trim(c)} END"


_ISO = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y/%m/%d %H:%M:%S",
        "%Y/%m/%d %H:%M", "%Y-%m-%d", "%Y/%m/%d", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S.%f", "%Y%m%d", "%b %d %Y %H:%M", "%d %B %Y %H:%M"]
_DMY = ["%d-%m-%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%d-%m-%Y", "%d/%m/%Y"]
_MDY = ["%m-%d-%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%m-%d-%Y", "%m/%d/%Y"]
_MON = ["%d-%b-%Y", "%d-%b-%Y %H:%M:%S"]


_ZONED = r"^([0-9]{4}-[0-9]+-[0-9]+[T ][0-9]+:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?) ?([+-])([0-9]{2}):?([0-9]{2})$"


def when(t: str, day_first: bool = True, epoch: bool = True, to_utc: bool = False) -> str:
    formats = _ISO + (_DMY + _MDY if day_first else _MDY + _DMY) + _MON
    bare = f"regexp_replace(regexp_replace({t}, {q(_ZONED)}, '\\1'), '([.][0-9]{{6}})[0-9]+', '\\1')"
    parsed = f"try_strptime({bare}, [{', '.join(q(f) for f in formats)}])"
    if to_utc:
        east = f"(CASE WHEN regexp_extract({t}, {q(_ZONED)}, 4) = '-' THEN -1 ELSE 1 END * (60 * CAST(regexp_extract({t}, {q(_ZONED)}, 5) AS INTEGER) + CAST(regexp_extract({t}, {q(_ZONED)}, 6) AS INTEGER)))"
        parsed = f"CASE WHEN regexp_matches({t}, {q(_ZONED)}) THEN {parsed} - to_minutes({east}) ELSE {parsed} END"
    if not epoch:
        return parsed
    return f"CASE WHEN regexp_full_match({t}, '[0-9]{{10}}') THEN make_timestamp(CAST({t} AS BIGINT) * 1000000) ELSE {parsed} END"


def id_date(c: str) -> str:
    t = trim(c)
    return (
        f"CASE WHEN lower({t}) IN {words(fv.DATE_MISSING_TOKENS)} THEN NULL "
        f"WHEN regexp_full_match({t}, '[0-9]{{5}}') THEN CASE WHEN CAST({t} AS INTEGER) BETWEEN 20000 AND 60000 "
        f"THEN CAST(DATE '1899-12-30' + CAST({t} AS INTEGER) AS TIMESTAMP) END ELSE {when(t)} END"
    )


def text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def off(ts: str) -> str:
    return f"(hour({ts}) >= 18 OR hour({ts}) < 6)"


def band(x: str, edges: list, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {e} THEN {q(n)}" for e, n in edges) + f" ELSE {q(last)} END"


def dev_status(x: str) -> str:
    return band(x, [(1.5, "NORMAL"), (2.5, "UNUSUAL"), (4.0, "ELEVATED")], "OUTLIER")


def zscore(v: str, med: str, mad: str) -> str:
    s = f"({mad} * 1.4826e0)"
    return (
        f"coalesce(CASE WHEN {s} < 1e-6 THEN greatest(-10e0, least(10e0, {v} - {med})) "
        f"ELSE greatest(-20e0, least(20e0, ({v} - {med}) / {s})) END, 0e0)"
    )


def flags(pairs: list[tuple[str, str]], sep: str = "; ", default: str = "NONE_OBSERVED") -> str:
    arms = ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for c, n in pairs)
    return f"coalesce(nullif(concat_ws({q(sep)}, {arms}), ''), {q(default)})"


C: dict[str, str] = {name: render(sql, "duckdb") for name, sql in RAW_SQL.items()}

C["identity"] = f"""
SELECT {uid('user_id')} AS user_id, lower({trim('username')}) AS username,
  {mapped(f"lower({squeeze('department')})", fv.DEPARTMENTS)} AS department,
  {mapped(f"upper({squeeze('status')})", fv.EMPLOYMENT_STATUS)} AS status,
  {id_date('hire_date')} AS hire_date, {id_date('termination_date')} AS termination_date,
  lower({trim('manager_username')}) AS manager_username, upper({trim('device_id')}) AS device_id,
  {squeeze('location')} AS location, {host('hostname')} AS hostname, full_name, role
FROM (SELECT DISTINCT * FROM identity_raw)"""

C["iam_t"] = f"""
SELECT event_id, {", ".join(f"{na(c)} AS {c}" for c in ("timestamp user_id username department event_type auth_method "
  "source_ip hostname device_id session_id mfa_passed failure_reason risk_score geo_location").split())}
FROM (SELECT DISTINCT * FROM iam_raw)"""

_PCT = r"[0-9]+(\.[0-9]+)?\s*/\s*100"
C["iam_v"] = f"""
SELECT *, CASE WHEN regexp_full_match(risk_score, {q(_PCT)}) THEN CAST(regexp_extract(risk_score, '^[0-9.]+') AS DOUBLE)
               ELSE {num('risk_score')} END AS v FROM iam_t"""

C["iam_parsed"] = f"""
SELECT event_id, {when('timestamp', day_first=False)} AS timestamp,
  coalesce({uid('user_id')}, {bare('user_id')}) AS user_id, username,
  {mapped("lower(department)", fv.DEPARTMENTS, "department")} AS department,
  {mapped("replace(replace(lower(event_type), '-', '_'), ' ', '_')", fv.LOGIN_EVENTS, "'other'")} AS event_type,
  {mapped("lower(auth_method)", fv.AUTH_METHODS, "lower(auth_method)")} AS auth_method,
  {ip('source_ip')} AS source_ip, {host('hostname')} AS hostname, device_id, session_id,
  CASE WHEN lower(mfa_passed) IN {words(fv.TRUE_WORDS_AUTH)} THEN true
       WHEN lower(mfa_passed) IN {words(fv.FALSE_WORDS_AUTH)} THEN false END AS mfa_passed,
  {mapped("lower(failure_reason)", fv.FAILURE_REASONS, "failure_reason")} AS failure_reason,
  coalesce(risk_score, 'Missing') AS risk_raw,
  CASE WHEN v BETWEEN 0 AND 100 THEN v END AS risk_numeric,
  coalesce(v BETWEEN 0 AND 100, false) OR coalesce(lower(risk_score) IN ('high','medium','low'), false) AS risk_valid,
  CASE WHEN risk_score IS NULL THEN 'Missing'
       WHEN v BETWEEN 71 AND 100 THEN 'High' WHEN v >= 31 AND v < 71 THEN 'Medium' WHEN v >= 0 AND v < 31 THEN 'Low'
       WHEN v IS NOT NULL THEN 'Invalid'
       WHEN lower(risk_score) IN ('high','medium','low') THEN upper(risk_score[1]) || lower(risk_score[2:]) ELSE 'Unmapped' END AS risk_label,
  CASE WHEN risk_score IS NULL THEN 'MISSING'
       WHEN v NOT BETWEEN 0 AND 100 THEN 'OUT_OF_RANGE'
       WHEN regexp_full_match(risk_score, {q(_PCT)}) THEN 'PARSED_PERCENTAGE'
       WHEN v IS NOT NULL THEN 'VALID_NUMERIC'
       WHEN lower(risk_score) IN ('high','medium','low') THEN 'CATEGORICAL_PRESERVED' ELSE 'UNMAPPED_CATEGORICAL' END AS risk_flag,
  coalesce(v NOT BETWEEN 0 AND 100, true) AS risk_imputed, geo_location,
  (user_id IS NULL OR user_id <> coalesce({uid('user_id')}, {bare('user_id')})
   OR hostname IS NULL OR hostname <> {host('hostname')}) AS is_repaired
FROM iam_v"""

C["iam"] = """
SELECT * EXCLUDE (failure_reason),
  CASE WHEN failure_reason IS NOT NULL THEN failure_reason WHEN event_type <> 'login_failed' THEN 'Not Applicable' END AS failure_reason,
  coalesce(risk_numeric, (SELECT median(risk_numeric) FROM iam_parsed), 50) AS risk_score,
  CASE WHEN timestamp IS NULL OR source_ip IS NULL THEN 'UNKNOWN' WHEN is_repaired THEN 'REPAIRED'
       WHEN risk_imputed THEN 'IMPUTED' ELSE 'VALID' END AS data_quality_status
FROM iam_parsed"""

C["endpoint_parsed"] = f"""
SELECT alert_id, d AS detected_timestamp, r AS resolved_timestamp, {host('hostname')} AS hostname, {uid('user_id')} AS user_id,
  endpoint_product, alert_name, sev AS severity, {mapped(cat_key('status'), fv.ALERT_STATUS)} AS status,
  description, file_path, process_name,
  CASE WHEN regexp_full_match({trim('sha256')}, '[0-9a-fA-F]{{64}}') THEN lower({trim('sha256')}) END AS sha256,
  assigned_to, {mapped(cat_key('device_criticality'), fv.CRITICALITY)} AS device_criticality,
  CASE sev WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END AS severity_rank,
  CASE WHEN r >= d THEN (epoch_us(r) - epoch_us(d)) / 3.6e9 END AS duration_hours,
  coalesce(r < d, false) AS chronology_issue
FROM (SELECT *, {when(trim('detected_timestamp'))} AS d, {when(trim('resolved_timestamp'))} AS r,
             {mapped(cat_key('severity'), fv.SEVERITIES)} AS sev
      FROM (SELECT DISTINCT * FROM endpoint_raw))"""

C["endpoint"] = f"""
SELECT *, {rnd("coalesce(duration_hours, (SELECT median(duration_hours) FROM endpoint_parsed))", 2)} AS resolution_duration_hours
FROM endpoint_parsed"""

C["firewall_parsed"] = f"""
SELECT log_id, {when(trim('timestamp'), day_first=False, epoch=False, to_utc=True)} AS timestamp, {host('hostname')} AS hostname,
  {ip('src_ip')} AS src_ip, {ip('dst_ip')} AS dst_ip, {port('src_port')} AS src_port, {port('dst_port')} AS dst_port,
  {mapped(f"upper({trim('protocol')})", fv.PROTOCOLS)} AS protocol,
  {mapped(f"upper({trim('action')})", fv.FIREWALL_ACTIONS)} AS action,
  {size('bytes_sent')} AS bytes_sent, {size('bytes_received')} AS bytes_received, session_id,
  CASE WHEN lower(trim(threat_flag)) IN {words(fv.TRUE_WORDS)} THEN true
       WHEN lower(trim(threat_flag)) IN {words(fv.FALSE_WORDS)} THEN false END AS threat_flag,
  rule_name, geo_country
FROM (SELECT DISTINCT * FROM firewall_raw)"""

C["firewall_med"] = """
SELECT CAST(round_even(median(src_port), 0) AS INTEGER) AS sp, CAST(round_even(median(dst_port), 0) AS INTEGER) AS dp,
       median(bytes_sent) AS bs, median(bytes_received) AS br FROM firewall_parsed"""

C["firewall"] = f"""
SELECT * EXCLUDE (src_port, dst_port, bytes_sent, bytes_received, sp, dp, bs, br),
  coalesce(src_port, sp) AS src_port, coalesce(dst_port, dp) AS dst_port,
  {rnd('coalesce(bytes_sent, bs)', 2)} AS bytes_sent, {rnd('coalesce(bytes_received, br)', 2)} AS bytes_received
FROM firewall_parsed, firewall_med"""

# --- canonical model ----------------------------------------------------------------

C["known_users"] = "SELECT DISTINCT user_id FROM identity WHERE user_id IS NOT NULL"
C["known_hosts"] = "SELECT DISTINCT hostname FROM identity WHERE hostname IS NOT NULL"

C["events_c"] = """
SELECT event_id, timestamp AS ts, event_type, 'AUTHENTICATION' AS event_category, user_id, hostname, device_id, session_id,
  source_ip, CAST(NULL AS VARCHAR) AS destination_ip, department,
  CASE WHEN risk_label IN ('Missing','Invalid') THEN 'Info' ELSE risk_label END AS severity, upper(event_type) AS action,
  'IAM' AS source_dataset, event_id AS source_record_id, data_quality_status,
  CASE WHEN user_id IN (FROM known_users) THEN 'EXACT' ELSE 'UNMATCHED' END AS resolution_confidence
FROM iam
UNION ALL
SELECT alert_id, detected_timestamp, coalesce(alert_name, 'Unknown'), 'ENDPOINT_ALERT', user_id, hostname, NULL, NULL, NULL, NULL, NULL,
  coalesce(severity, 'Unknown'), 'ALERT_TRIGGERED', 'Endpoint', alert_id,
  CASE WHEN resolved_timestamp IS NULL THEN 'UNKNOWN' ELSE 'VALID' END,
  CASE WHEN user_id IN (FROM known_users) AND hostname IN (FROM known_hosts) THEN 'EXACT' ELSE 'PROBABLE' END
FROM endpoint
UNION ALL
SELECT log_id, timestamp, coalesce(protocol, 'Unknown') || '_' || coalesce(action, 'Unknown'), 'NETWORK_FLOW', NULL, hostname, NULL,
  session_id, src_ip, dst_ip, NULL, CASE WHEN threat_flag THEN 'High' ELSE 'Low' END, coalesce(action, 'Unknown'), 'Firewall', log_id,
  CASE WHEN timestamp IS NULL THEN 'UNKNOWN' ELSE 'VALID' END,
  CASE WHEN hostname IN (FROM known_hosts) THEN 'PROBABLE' ELSE 'UNMATCHED' END
FROM firewall"""

C["all_hosts"] = """
SELECT hostname, hostname IN (FROM known_hosts) AS is_managed FROM (
  SELECT hostname FROM identity UNION SELECT hostname FROM firewall UNION SELECT hostname FROM endpoint)
WHERE hostname IS NOT NULL"""

C["sessions_c"] = """
SELECT session_id, bool_or(i) AS present_in_iam, bool_or(f) AS present_in_firewall,
  CASE WHEN bool_or(i) AND bool_or(f) THEN 'EXACT' ELSE 'UNMATCHED' END AS match_status
FROM (SELECT session_id, true AS i, false AS f FROM iam UNION ALL SELECT session_id, false, true FROM firewall)
WHERE session_id IS NOT NULL GROUP BY 1"""

C["relations"] = """
SELECT user_id AS source_node, 'USER' AS source_type, 'OWN_DEVICE' AS relationship, hostname AS target_node, 'HOST' AS target_type,
  'EXACT' AS confidence, 'Identity_Master' AS provenance FROM identity WHERE user_id IS NOT NULL AND hostname IS NOT NULL
UNION ALL
SELECT user_id, 'USER', 'TRIGGERED_ALERT', alert_id, 'ALERT', 'EXACT', 'Endpoint_Alerts' FROM endpoint WHERE user_id IS NOT NULL
UNION ALL
SELECT hostname, 'HOST', 'COMMUNICATED_WITH', dst_ip, 'IP', 'PROBABLE', 'Firewall_Logs' FROM firewall
WHERE hostname IS NOT NULL AND dst_ip IS NOT NULL"""

# --- features --------------------------------------------------------------------------

C["uf0"] = f"""
SELECT i.user_id, coalesce(i.username, 'Unknown') AS username, coalesce(i.department, 'Unknown') AS department,
  coalesce(i.status, 'Unknown') AS status, coalesce(i.hostname, 'Unknown') AS hostname,
  {", ".join(f"coalesce(a.{c}, 0) AS {c}" for c in ("authentication_event_count failed_login_count successful_login_count "
   "mfa_failure_count unique_source_ip_count session_count unknown_evidence_count off_hours_activity_count").split())},
  {", ".join(f"coalesce(e.{c}, 0) AS {c}" for c in ("endpoint_alert_count critical_endpoint_alert_count high_endpoint_alert_count "
   "medium_endpoint_alert_count low_endpoint_alert_count unique_host_count").split())},
  a.source_risk_max
FROM identity i
LEFT JOIN (SELECT user_id, count(*) AS authentication_event_count,
    count(*) FILTER (event_type = 'login_failed') AS failed_login_count,
    count(*) FILTER (event_type = 'login_success') AS successful_login_count,
    count(*) FILTER (mfa_passed = false) AS mfa_failure_count, count(DISTINCT source_ip) AS unique_source_ip_count,
    count(DISTINCT session_id) AS session_count, count(*) FILTER (data_quality_status = 'UNKNOWN') AS unknown_evidence_count,
    count(*) FILTER ({off('timestamp')}) AS off_hours_activity_count, max(risk_numeric) AS source_risk_max
  FROM iam GROUP BY 1) a ON a.user_id = i.user_id
LEFT JOIN (SELECT user_id, count(*) AS endpoint_alert_count,
    count(*) FILTER (severity = 'Critical') AS critical_endpoint_alert_count,
    count(*) FILTER (severity = 'High') AS high_endpoint_alert_count,
    count(*) FILTER (severity = 'Medium') AS medium_endpoint_alert_count,
    count(*) FILTER (severity = 'Low') AS low_endpoint_alert_count, count(DISTINCT hostname) AS unique_host_count
  FROM endpoint GROUP BY 1) e ON e.user_id = i.user_id"""

C["uf"] = """
SELECT *,
  CASE WHEN authentication_event_count > 0 THEN failed_login_count / authentication_event_count ELSE 0e0 END AS authentication_failure_rate,
  CASE WHEN failed_login_count > 0 THEN mfa_failure_count / failed_login_count ELSE 0e0 END AS mfa_failure_rate,
  authentication_event_count + endpoint_alert_count AS evidence_count,
  authentication_event_count + endpoint_alert_count - unknown_evidence_count AS valid_evidence_count,
  CASE WHEN authentication_event_count + endpoint_alert_count > 0 THEN 'EXACT' ELSE 'UNMATCHED' END AS feature_confidence,
  (rank() OVER (PARTITION BY department ORDER BY failed_login_count)
   + (count(*) OVER (PARTITION BY department, failed_login_count) - 1) / 2) / count(*) OVER (PARTITION BY department) * 100e0
    AS department_failed_login_percentile
FROM uf0"""

C["hf"] = """
SELECT h.hostname, h.is_managed, coalesce(firewall_event_count, 0) AS firewall_event_count,
  coalesce(firewall_deny_count, 0) AS firewall_deny_count, coalesce(threat_flag_count, 0) AS threat_flag_count,
  coalesce(unique_source_ip_count, 0) AS unique_source_ip_count, coalesce(unique_destination_ip_count, 0) AS unique_destination_ip_count,
  coalesce(bytes_sent, 0) AS bytes_sent, coalesce(bytes_received, 0) AS bytes_received, coalesce(session_count, 0) AS session_count,
  coalesce(endpoint_alert_count, 0) AS endpoint_alert_count, coalesce(critical_endpoint_alert_count, 0) AS critical_endpoint_alert_count,
  CASE WHEN firewall_event_count > 0 THEN firewall_deny_count / firewall_event_count ELSE 0e0 END AS firewall_deny_ratio,
  coalesce(firewall_event_count, 0) + coalesce(endpoint_alert_count, 0) AS evidence_count,
  CASE WHEN h.is_managed THEN 'EXACT' ELSE 'PROBABLE' END AS feature_confidence
FROM all_hosts h
LEFT JOIN (SELECT hostname, count(*) AS firewall_event_count, count(*) FILTER (action = 'DENY') AS firewall_deny_count,
    count(*) FILTER (threat_flag) AS threat_flag_count, count(DISTINCT src_ip) AS unique_source_ip_count,
    count(DISTINCT dst_ip) AS unique_destination_ip_count, sum(bytes_sent) AS bytes_sent, sum(bytes_received) AS bytes_received,
    count(DISTINCT session_id) AS session_count FROM firewall GROUP BY 1) f ON f.hostname = h.hostname
LEFT JOIN (SELECT hostname, count(*) AS endpoint_alert_count, count(*) FILTER (severity = 'Critical') AS critical_endpoint_alert_count
  FROM endpoint GROUP BY 1) e ON e.hostname = h.hostname"""

C["sf"] = """
SELECT session_id, coalesce(iam_event_count, 0) AS iam_event_count, coalesce(has_failed_login, false) AS has_failed_login,
  coalesce(firewall_log_count, 0) AS firewall_log_count, coalesce(has_firewall_deny, false) AS has_firewall_deny,
  coalesce(has_threat_flag, false) AS has_threat_flag, iam_event_count IS NOT NULL AS present_in_iam,
  firewall_log_count IS NOT NULL AS present_in_firewall,
  CASE WHEN iam_event_count IS NOT NULL AND firewall_log_count IS NOT NULL THEN 'EXACT' ELSE 'UNMATCHED' END AS match_status,
  coalesce(iam_event_count, 0) + coalesce(firewall_log_count, 0) AS session_event_count,
  CASE WHEN iam_event_count IS NOT NULL AND firewall_log_count IS NOT NULL THEN 'EXACT' ELSE 'UNMATCHED' END AS feature_confidence
FROM (SELECT session_id, count(*) AS iam_event_count, bool_or(event_type = 'login_failed') AS has_failed_login
      FROM iam WHERE session_id IS NOT NULL GROUP BY 1)
FULL JOIN (SELECT session_id, count(*) AS firewall_log_count, bool_or(coalesce(action = 'DENY', false)) AS has_firewall_deny,
      bool_or(coalesce(threat_flag, false)) AS has_threat_flag FROM firewall WHERE session_id IS NOT NULL GROUP BY 1)
USING (session_id)"""

# --- baselines ---------------------------------------------------------------------------


def _obs(key: str) -> str:
    return f"""
SELECT {key}, count(*) AS observation_count, count(ts) AS valid_timestamp_count, count(DISTINCT CAST(ts AS DATE)) AS distinct_active_days,
  count(DISTINCT hour(ts)) AS distinct_active_hours, count(*) - count(ts) AS unknown_timestamp_count,
  coalesce({rnd('(epoch_us(max(ts)) - epoch_us(min(ts))) / 86.4e9', 2)}, 0) AS historical_span_days,
  {rnd('count(ts) / count(*)', 4)} AS timestamp_quality_score
FROM events_c WHERE {key} IS NOT NULL GROUP BY 1"""


C["uobs"], C["hobs"] = _obs("user_id"), _obs("hostname")
_OBS = ["observation_count", "valid_timestamp_count", "distinct_active_days", "distinct_active_hours", "unknown_timestamp_count",
        "historical_span_days", "timestamp_quality_score"]
_ELIG = """CASE WHEN observation_count < 5 OR distinct_active_days < 2 THEN 'INSUFFICIENT_HISTORY'
  WHEN timestamp_quality_score < 0.5 THEN 'INSUFFICIENT_TIMESTAMP_QUALITY' ELSE 'SUFFICIENT_HISTORY' END"""
_CONF = """CASE WHEN observation_count < 5 OR distinct_active_days < 2 THEN 'UNTRUSTED' WHEN timestamp_quality_score < 0.5 THEN 'LOW'
  WHEN observation_count >= 10 AND timestamp_quality_score >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END"""


def _with_obs(features: str, obs: str, key: str) -> str:
    cols = ", ".join(f"coalesce(o.{c}, 0) AS {c}" for c in _OBS)
    return f"""SELECT *, {_ELIG} AS eligibility_status, {_CONF} AS baseline_confidence
FROM (SELECT f.*, {cols} FROM {features} f LEFT JOIN {obs} o ON o.{key} = f.{key})"""


_UM = {"failed_login_count": "failed_login", "authentication_failure_rate": "auth_failure_rate",
       "off_hours_activity_count": "off_hours", "endpoint_alert_count": "endpoint_alert"}
C["peer_med"] = f"""
SELECT department, count(*) AS peer_group_size, {", ".join(f"median({m}) AS peer_{s}_median" for m, s in _UM.items())}
FROM uf GROUP BY 1"""
C["peer"] = f"""
SELECT p.department, any_value(peer_group_size) AS peer_group_size,
  {", ".join(f"any_value(peer_{s}_median) AS peer_{s}_median, median(abs({m} - peer_{s}_median)) AS peer_{s}_mad" for m, s in _UM.items())}
FROM uf JOIN peer_med p ON p.department = uf.department GROUP BY 1"""
C["ub"] = f"SELECT * FROM ({_with_obs('uf', 'uobs', 'user_id')}) b JOIN peer USING (department)"


def _pop(table: str, metrics: list[str]) -> str:
    meds = ", ".join(f"(SELECT median({m}) FROM {table}) AS {m}_med" for m in metrics)
    return f"SELECT {', '.join(f'any_value({m}_med) AS {m}_med, median(abs({m} - {m}_med)) AS {m}_mad' for m in metrics)} " \
           f"FROM (SELECT *, {meds} FROM {table})"


_HM = {"firewall_deny_count": "firewall_deny", "firewall_deny_ratio": "firewall_deny_ratio", "bytes_sent": "bytes_sent",
       "bytes_received": "bytes_received", "unique_source_ip_count": "unique_source_ip",
       "unique_destination_ip_count": "unique_destination_ip", "endpoint_alert_count": "endpoint_alert"}
C["upop"] = _pop("uf", ["unique_source_ip_count", "unique_host_count"])
C["hpop"] = _pop("hf", list(_HM))
C["hb"] = f"""
SELECT *, (SELECT firewall_deny_ratio_med FROM hpop) AS population_deny_ratio_median,
  (SELECT firewall_deny_ratio_mad FROM hpop) AS population_deny_ratio_mad,
  (SELECT endpoint_alert_count_med FROM hpop) AS population_endpoint_alert_median,
  (SELECT endpoint_alert_count_mad FROM hpop) AS population_endpoint_alert_mad
FROM ({_with_obs('hf', 'hobs', 'hostname')})"""


def _reldev(v: str, med: str) -> str:
    return rnd(f"greatest({v} - {med}, 0e0) / ({med} + 1e0)", 4)


C["uz"] = f"""
SELECT ub.*,
  {", ".join(f"greatest({m} - peer_{s}_median, 0e0) AS {s}_abs_dev, {_reldev(m, f'peer_{s}_median')} AS {s}_rel_dev, "
             f"{rnd(zscore(m, f'peer_{s}_median', f'peer_{s}_mad'), 4)} AS {s}_zscore" for m, s in _UM.items())},
  {rnd(zscore('unique_source_ip_count', 'unique_source_ip_count_med', 'unique_source_ip_count_mad'), 4)} AS unique_source_ip_zscore,
  {rnd(zscore('unique_host_count', 'unique_host_count_med', 'unique_host_count_mad'), 4)} AS unique_host_zscore
FROM ub, upop"""
C["ud"] = """
SELECT *, greatest(failed_login_zscore, auth_failure_rate_zscore, 0e0) AS authentication_deviation,
  greatest(unique_source_ip_zscore, unique_host_zscore, 0e0) AS network_deviation,
  greatest(endpoint_alert_zscore, 0e0) AS endpoint_deviation, greatest(off_hours_zscore, 0e0) AS off_hours_deviation FROM uz"""


def _final_dev(table: str, dims: list[str]) -> str:
    mean = "(" + " + ".join(f"{d}_deviation" for d in dims) + f") / {len(dims)}e0"
    stat = ", ".join(f"{dev_status(f'{d}_deviation')} AS {d}_deviation_status" for d in dims)
    sig = " + ".join(f"CASE WHEN {d}_deviation >= 2.5 THEN 1 ELSE 0 END" for d in dims)
    return f"""SELECT *, {stat}, {dev_status('behavior_deviation_score')} AS overall_deviation_status,
  CAST({sig} AS BIGINT) AS multi_signal_deviation_count
FROM (SELECT *, {rnd(mean, 4)} AS behavior_deviation_score FROM {table})"""


C["udev"] = _final_dev("ud", ["authentication", "network", "endpoint", "off_hours"])
C["hz"] = f"""
SELECT hb.*, {", ".join(f"{rnd(zscore(f'hb.{m}', f'{m}_med', f'{m}_mad'), 4)} AS {s}_zscore" for m, s in _HM.items())},
  greatest(firewall_deny_count - firewall_deny_count_med, 0e0) AS firewall_deny_abs_dev,
  {_reldev('firewall_deny_count', 'firewall_deny_count_med')} AS firewall_deny_rel_dev
FROM hb, hpop"""
C["hd"] = """
SELECT *, greatest(firewall_deny_zscore, firewall_deny_ratio_zscore, unique_destination_ip_zscore, 0e0) AS network_deviation,
  greatest(endpoint_alert_zscore, 0e0) AS endpoint_deviation, greatest(bytes_sent_zscore, bytes_received_zscore, 0e0) AS volume_deviation
FROM hz"""
C["hdev"] = _final_dev("hd", ["network", "endpoint", "volume"])

# --- risk ------------------------------------------------------------------------------------


def scored(table: str, weights: dict[str, float], factor: float = 1.0) -> str:
    z = {d: f"{d}_deviation * {factor}e0" for d in weights}
    s = ", ".join(f"{z[d]} AS z_{d}, least({w}e0, {z[d]} / 4e0 * {w}e0) AS s_{d}" for d, w in weights.items())
    act = " + ".join(f"CASE WHEN z_{d} >= 2.5 THEN 1 ELSE 0 END" for d in weights)
    return f"""SELECT *, greatest(0e0, least(100e0, base * mult)) AS raw_score FROM (
  SELECT *, CASE active WHEN 2 THEN 1.25e0 WHEN 3 THEN 1.5e0 WHEN 4 THEN 1.75e0 ELSE 1e0 END AS mult FROM (
    SELECT *, {" + ".join(f"s_{d}" for d in weights)} AS base, CAST({act} AS BIGINT) AS active FROM (
      SELECT *, {s} FROM {table})))"""


_UW = {"authentication": 25.0, "network": 25.0, "endpoint": 25.0, "off_hours": 25.0}
_HW = {"network": 33.33, "endpoint": 33.33, "volume": 33.34}
_EVCONF = rnd(
    "greatest(0e0, least(1e0, timestamp_quality_score * 0.4e0 + least(1e0, observation_count / 10e0) * 0.3e0 + "
    "CASE baseline_confidence WHEN 'HIGH' THEN 1e0 WHEN 'MEDIUM' THEN 0.75e0 WHEN 'LOW' THEN 0.4e0 ELSE 0.1e0 END * 0.3e0))", 4)


def _assess(inner: str, parts: dict[str, str], counter: list, hyp: list, head: str) -> str:
    p = ", ".join(f"{rnd(f's_{d} * mult', 2) if d else '0e0'} AS {n}_contribution" for n, d in parts.items())
    return f"""SELECT *, {head}, {flags(counter)} AS counter_evidence,
  CASE WHEN risk_score >= 50 THEN {flags(hyp, default='NO_ACTIONABLE_HYPOTHESIS')} ELSE 'NO_ACTIONABLE_HYPOTHESIS' END AS primary_hypothesis
FROM (SELECT *, {band('risk_score', [(30, 'LOW'), (60, 'MODERATE'), (80, 'HIGH')], 'CRITICAL')} AS risk_level,
    {band('risk_confidence_score', [(0.2, 'UNTRUSTED'), (0.5, 'LOW'), (0.8, 'MEDIUM')], 'HIGH')} AS risk_confidence_level
  FROM (SELECT *, active AS independent_signal_count, mult AS multi_signal_multiplier, {rnd('raw_score', 2)} AS risk_score, {p},
      {rnd('base * (mult - 1e0)', 2)} AS multi_signal_boost, {_EVCONF} AS risk_confidence_score FROM ({inner})))"""


_CEV = [("timestamp_quality_score < 0.5", "LOW_TIMESTAMP_QUALITY"),
        ("eligibility_status = 'INSUFFICIENT_HISTORY'", "INSUFFICIENT_BASELINE_HISTORY")]
_SINGLE = ("risk_score >= 30 AND active <= 1", "UNCORROBORATED_SINGLE_DIMENSION")
_SUSP = ("endpoint_contribution >= 15 AND (network_contribution >= 10 OR critical_endpoint_alert_count > 0)",
         "POSSIBLE_SUSPICIOUS_ENDPOINT_ACTIVITY")
C["urisk"] = _assess(
    scored("udev", _UW), {"auth": "authentication", "network": "network", "endpoint": "endpoint", "operational": "off_hours"},
    _CEV + [_SINGLE, ("mfa_failure_count = 0", "ZERO_MFA_FAILURES_OBSERVED")],
    [("auth_contribution >= 15 AND network_contribution >= 10", "POSSIBLE_CREDENTIAL_COMPROMISE"),
     ("auth_contribution >= 15 AND (operational_contribution >= 10 OR active >= 3)", "POSSIBLE_ACCOUNT_TAKEOVER"),
     _SUSP, ("network_contribution >= 15 AND operational_contribution >= 10", "POSSIBLE_ANOMALOUS_DATA_EXFILTRATION")],
    "user_id AS entity_id, 'USER' AS entity_type, coalesce(CAST(source_risk_max AS VARCHAR), 'Unknown') AS source_iam_risk_indicator, "
    "CASE WHEN source_risk_max IS NULL THEN 'UNKNOWN' ELSE 'VALID_NUMERIC' END AS source_iam_risk_quality")
C["hrisk"] = _assess(
    scored("hdev", _HW), {"auth": "", "network": "network", "endpoint": "endpoint", "operational": "volume"},
    _CEV + [("NOT is_managed", "UNMANAGED_HOST_CONTEXT"), _SINGLE],
    [_SUSP, ("network_contribution >= 15 AND operational_contribution >= 10", "POSSIBLE_ANOMALOUS_NETWORK_TRAFFIC")],
    "hostname AS entity_id, 'HOST' AS entity_type, 'Unknown' AS username, 'Unknown' AS department, "
    "'Not Applicable' AS source_iam_risk_indicator, 'NOT_APPLICABLE' AS source_iam_risk_quality")

SCORES = ("entity_id, entity_type, username, department, risk_score, risk_level, risk_confidence_score, risk_confidence_level, "
          "independent_signal_count, multi_signal_multiplier, source_iam_risk_indicator, source_iam_risk_quality, eligibility_status, "
          "counter_evidence, primary_hypothesis")
CONTRIB = ("entity_id, entity_type, risk_score, auth_contribution, network_contribution, endpoint_contribution, "
           "operational_contribution, multi_signal_boost")
C["risk_all"] = f"SELECT {SCORES} FROM urisk UNION ALL SELECT {SCORES} FROM hrisk"
C["hyps"] = """
SELECT entity_id, entity_type, primary_hypothesis AS hypothesis, risk_score, risk_confidence_score AS confidence_score,
  'Auth:' || auth_contribution || ', Net:' || network_contribution || ', Ep:' || endpoint_contribution || ', Ops:' || operational_contribution AS supporting_signals,
  counter_evidence, 'Observed events: ' || observation_count || ', TS Quality: ' || timestamp_quality_score AS limitations FROM urisk
UNION ALL
SELECT entity_id, entity_type, primary_hypothesis, risk_score, risk_confidence_score,
  'Net:' || network_contribution || ', Ep:' || endpoint_contribution || ', Vol:' || operational_contribution, counter_evidence,
  'Observed events: ' || observation_count || ', Managed: ' || CASE WHEN is_managed THEN 'True' ELSE 'False' END FROM hrisk"""
C["revid"] = """
SELECT CASE WHEN u THEN user_id ELSE hostname END AS entity_id, CASE WHEN u THEN 'USER' ELSE 'HOST' END AS entity_type, event_id,
  source_dataset, source_record_id, event_category, ts AS event_timestamp, severity, action, data_quality_status, resolution_confidence
FROM (SELECT *, coalesce(user_id IN (SELECT entity_id FROM urisk WHERE risk_score >= 30), false) AS u,
        coalesce(hostname IN (SELECT entity_id FROM hrisk WHERE risk_score >= 30), false) AS h FROM events_c)
WHERE u OR h"""

# --- temporal -----------------------------------------------------------------------------------


def _chain(name: str, key: str, width: int, least: int | None = None) -> None:
    """Steps <name>_t (ticks), <name>_next and <name> (anchors)."""
    cap = ""
    if least:
        cap = f"QUALIFY sum(n) OVER (PARTITION BY entity_id ORDER BY us RANGE BETWEEN CURRENT ROW AND {width} FOLLOWING) >= {least}"
    C[f"{name}_t"] = f"""SELECT entity_id, us FROM (SELECT {key} AS entity_id, epoch_us(ts) AS us, count(*) AS n FROM events_c
  WHERE {key} IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2) {cap}"""
    C[f"{name}_next"] = f"""SELECT a.entity_id, a.us, b.us AS nxt FROM {name}_t a ASOF JOIN {name}_t b
  ON a.entity_id = b.entity_id AND a.us + {width} < b.us"""
    C[name] = f"""SELECT entity_id, min(us) AS anchor FROM {name}_t GROUP BY 1
UNION ALL SELECT n.entity_id, n.nxt FROM {name} JOIN {name}_next n ON n.entity_id = {name}.entity_id AND n.us = {name}.anchor"""
    C[f"{name}_m"] = f"""SELECT e.*, epoch_us(e.ts) AS us, a.anchor, e.{key} AS entity_id
FROM (SELECT * FROM events_c WHERE {key} IS NOT NULL AND ts IS NOT NULL) e
ASOF JOIN {name} a ON e.{key} = a.entity_id AND epoch_us(e.ts) >= a.anchor WHERE epoch_us(e.ts) <= a.anchor + {width}"""


_chain("useq", "user_id", US_HOUR)
_chain("hseq", "hostname", US_HOUR)
_chain("ubur", "user_id", US_HOUR // 2, 3)
_chain("hbur", "hostname", US_HOUR // 2, 3)


def _seq(name: str, prefix: str, kind: str, rules: str) -> None:
    C[f"{name}_ev"] = f"""SELECT '{prefix}' || entity_id || '-' || anchor AS sequence_id, entity_id, '{kind}' AS entity_type, event_id,
  source_dataset, source_record_id, {text('ts')} AS event_timestamp, event_category, action, us, anchor,
  row_number() OVER (PARTITION BY entity_id, anchor ORDER BY us, event_id) AS step
FROM {name}_m QUALIFY count(*) OVER (PARTITION BY entity_id, anchor) >= 2"""
    C[f"{name}_s"] = f"""SELECT sequence_id, entity_id, entity_type, {rules} AS sequence_type,
  {text('make_timestamp(anchor)')} AS start_time, {text('make_timestamp(last_us)')} AS end_time,
  CAST(floor((last_us - anchor) / 1e6) AS BIGINT) AS duration_seconds, event_count, event_ids, source_datasets,
  CAST(60 AS BIGINT) AS temporal_window_minutes,
  {rnd("0.5e0 + CASE WHEN src >= 2 THEN 1e0 ELSE 0.5e0 END * 0.3e0 + least(1e0, event_count / 5e0) * 0.2e0", 4)} AS sequence_confidence,
  {rnd("greatest(0e0, least(100e0, src * 25e0 + cats * 20e0 + least(5, event_count) * 15e0 + CASE WHEN src >= 2 THEN 20e0 ELSE 0e0 END))", 2)} AS sequence_strength,
  {flags([("src < 2", "SINGLE_SOURCE_ONLY"), ("floor((last_us - anchor) / 1e6) = 0", "IDENTICAL_TIMESTAMP_WINDOW")])} AS counter_evidence
FROM (SELECT sequence_id, entity_id, entity_type, anchor, max(us) AS last_us, count(*) AS event_count,
  string_agg(event_id, '; ' ORDER BY step) AS event_ids, string_agg(DISTINCT source_dataset, '; ' ORDER BY source_dataset) AS source_datasets,
  count(DISTINCT source_dataset) AS src, count(DISTINCT event_category) AS cats,
  count(*) FILTER (event_category = 'AUTHENTICATION') AS au, count(*) FILTER (event_category = 'ENDPOINT_ALERT') AS al,
  count(*) FILTER (event_category = 'NETWORK_FLOW') AS fl, count(*) FILTER (action = 'LOGIN_FAILED') AS nf,
  count(*) FILTER (action = 'LOGIN_SUCCESS') AS ns, count(*) FILTER (action = 'DENY') AS nd
  FROM {name}_ev GROUP BY 1, 2, 3, 4)"""


_seq("useq", "SEQ-USR-", "USER", """CASE WHEN nf > 0 AND ns > 0 THEN 'FAILED_AUTH_TO_SUCCESS' WHEN nf >= 2 THEN 'FAILED_LOGIN_SERIES'
  WHEN au > 0 AND al > 0 THEN 'AUTH_TO_ENDPOINT_ALERT' WHEN au > 0 AND fl > 0 THEN 'AUTH_TO_FIREWALL_DENY'
  WHEN src >= 2 THEN 'CROSS_SOURCE_SESSION_CHAIN' ELSE 'GENERAL_ACTIVITY_SEQUENCE' END""")
_seq("hseq", "SEQ-HST-", "HOST", """CASE WHEN nd >= 3 THEN 'FIREWALL_DENY_SPIKE' WHEN al >= 2 THEN 'ENDPOINT_ALERT_BURST'
  WHEN fl > 0 AND al > 0 THEN 'FIREWALL_DENY_TO_ENDPOINT_ALERT' WHEN src >= 2 THEN 'CROSS_SOURCE_HOST_CHAIN'
  ELSE 'HOST_ACTIVITY_SEQUENCE' END""")
C["seqs"] = "SELECT * FROM useq_s UNION ALL SELECT * FROM hseq_s"
C["seq_ev"] = "SELECT * FROM useq_ev UNION ALL SELECT * FROM hseq_ev"


def _bursts(name: str, kind: str) -> str:
    return f"""SELECT 'BURST-{kind}-' || entity_id || '-' || anchor AS burst_id, entity_id, '{kind}' AS entity_type,
  {text('make_timestamp(anchor)')} AS burst_start, {text('make_timestamp(last_us)')} AS burst_end,
  {rnd('secs', 1)} AS burst_duration_sec, n AS event_count, {rnd('n / (secs / 60e0)', 2)} AS event_density_per_min,
  src AS source_diversity_count,
  CASE WHEN src > 1 THEN 'MULTI_SOURCE_BURST' WHEN ds = 'IAM' THEN 'AUTHENTICATION_BURST' WHEN ds = 'Endpoint' THEN 'ENDPOINT_BURST'
       ELSE 'FIREWALL_BURST' END AS burst_category,
  CASE WHEN n >= 10 THEN 'CRITICAL' WHEN n >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity_level
FROM (SELECT entity_id, anchor, max(us) AS last_us, greatest(1e0, (max(us) - anchor) / 1e6) AS secs, count(*) AS n,
  count(DISTINCT source_dataset) AS src, min(source_dataset) AS ds FROM {name}_m GROUP BY 1, 2)"""


C["bursts_all"] = _bursts("ubur", "USER") + "\nUNION ALL\n" + _bursts("hbur", "HOST")

# --- graph ------------------------------------------------------------------------------------------

_U = "coalesce({0}, 'Unknown')"
C["dept_of"] = "SELECT DISTINCT coalesce(department, 'Unknown') AS d FROM identity"
C["nodes_all"] = f"""
SELECT 0 AS rk, user_id AS node_id, 'USER' AS node_type, {_U.format('username')} AS label, {_U.format('department')} AS department,
  {_U.format('status')} AS status, 'canonical_users' AS source_dataset, user_id AS source_record_id FROM identity
UNION ALL SELECT 1, 'DEPT-' || replace(upper(d), ' ', '_'), 'DEPARTMENT', d, d, 'Active', 'canonical_users', 'DEPT-' || d FROM dept_of
UNION ALL SELECT 2, hostname, 'HOST', hostname, 'Unknown', CASE WHEN is_managed THEN 'Managed' ELSE 'Unmanaged' END, 'canonical_hosts', hostname FROM all_hosts
UNION ALL SELECT 3, 'IP-' || ip, 'IP', ip, 'Unknown', 'Active', 'canonical_events', 'IP-' || ip
  FROM (SELECT source_ip AS ip FROM events_c UNION SELECT destination_ip FROM events_c) WHERE ip IS NOT NULL
UNION ALL SELECT 4, session_id, 'SESSION', session_id, 'Unknown', 'Active', 'canonical_sessions', session_id FROM sessions_c
UNION ALL SELECT 5, 'RISK-' || entity_id, 'RISK_ASSESSMENT', 'Risk: ' || risk_score || ' (' || risk_level || ')', department, risk_level, 'risk_scores', entity_id FROM risk_all
UNION ALL SELECT 6, sequence_id, 'TEMPORAL_SEQUENCE', sequence_type || ' (Strength: ' || sequence_strength || ')', 'Unknown', 'Detected', 'temporal_sequences', sequence_id FROM seqs
UNION ALL SELECT 7, event_id, 'EVENT', event_category || ': ' || action, {_U.format('department')}, {_U.format('severity')}, source_dataset, source_record_id
  FROM events_c WHERE event_id IN (SELECT event_id FROM revid UNION SELECT event_id FROM seq_ev)"""
C["nodes"] = """
SELECT node_id, node_type, label, department, status, source_dataset, source_record_id FROM nodes_all WHERE node_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY rk, node_type, label, department, status, source_dataset, source_record_id) = 1"""
C["edges_all"] = """
SELECT user_id AS source_id, 'DEPT-' || replace(upper(coalesce(department, 'Unknown')), ' ', '_') AS target_id, 'BELONGS_TO' AS relationship_type,
  'EXACT' AS relationship_confidence, 'canonical_users' AS source_dataset, user_id AS source_record_id, 'ORGANIZATIONAL_ASSIGNMENT' AS evidence_type FROM identity
UNION ALL SELECT source_node, target_node, 'ASSOCIATED_WITH_HOST', confidence, provenance, source_node, 'TELEMETRY_ASSOCIATION' FROM relations WHERE target_type = 'HOST'
UNION ALL SELECT source_node, target_node, 'TRIGGERED_EVENT', confidence, provenance, target_node, 'TELEMETRY_ASSOCIATION' FROM relations WHERE target_type = 'ALERT'
UNION ALL SELECT user_id, session_id, 'AUTHENTICATED_VIA', 'EXACT', 'canonical_events', source_record_id, 'IAM_SESSION_ESTABLISHMENT'
  FROM events_c WHERE source_dataset = 'IAM' AND session_id IS NOT NULL AND user_id IS NOT NULL
UNION ALL SELECT session_id, 'IP-' || source_ip, 'CONNECTED_FROM_IP', 'EXACT', 'canonical_events', source_record_id, 'NETWORK_ORIGIN_IP'
  FROM events_c WHERE source_dataset = 'IAM' AND session_id IS NOT NULL AND source_ip IS NOT NULL
UNION ALL SELECT hostname, 'IP-' || destination_ip, 'COMMUNICATED_WITH_IP', 'EXACT', 'canonical_events', source_record_id, 'FIREWALL_NETWORK_FLOW'
  FROM events_c WHERE event_category = 'NETWORK_FLOW' AND hostname IS NOT NULL AND destination_ip IS NOT NULL
UNION ALL SELECT entity_id, 'RISK-' || entity_id, 'HAS_RISK_ASSESSMENT', 'EXACT', 'risk_scores', entity_id, 'EXPLAINABLE_RISK_EVALUATION' FROM risk_all
UNION ALL SELECT 'RISK-' || entity_id, event_id, 'SUPPORTED_BY_EVIDENCE', 'EXACT', source_dataset, source_record_id, 'FLAGGED_ANOMALY_EVIDENCE' FROM revid
UNION ALL SELECT entity_id, sequence_id, 'INVOLVED_IN_SEQUENCE', 'EXACT', 'temporal_sequences', sequence_id, 'CHRONOLOGICAL_SEQUENCE_MEMBER' FROM seqs
UNION ALL SELECT sequence_id, event_id, 'SEQUENCE_INCLUDES_EVENT', 'EXACT', source_dataset, source_record_id, 'SEQUENCE_EVENT_STEP' FROM seq_ev"""
C["edges"] = """
SELECT 'EDG-' || substr(sha256(source_id || '|' || target_id || '|' || relationship_type), 1, 16) AS edge_id, * FROM edges_all
WHERE source_id IN (SELECT node_id FROM nodes) AND target_id IN (SELECT node_id FROM nodes)
QUALIFY row_number() OVER (PARTITION BY source_id, target_id, relationship_type
  ORDER BY relationship_confidence, source_dataset, source_record_id, evidence_type) = 1"""
C["links"] = "SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges"

# --- insights ------------------------------------------------------------------------------------------

FEATURES = ["failed_login_zscore", "auth_failure_rate_zscore", "off_hours_zscore", "endpoint_alert_zscore",
            "unique_source_ip_zscore", "unique_host_zscore"]
C["points"] = f"""SELECT user_id AS entity_id, behavior_deviation_score, {', '.join(FEATURES)},
  row_number() OVER (ORDER BY user_id) - 1 AS rn, count(*) OVER () AS total FROM urisk"""
K = 4


TOL = 1e-5
_UNIT = 10_000


def _to(alias: str) -> str:
    """Squared distance of point ``p`` to the centroid ``alias`` (a list)."""
    return " + ".join(f"(p.{f} - {alias}[{i}]) * (p.{f} - {alias}[{i}])" for i, f in enumerate(FEATURES, 1))


def _fit(k: int) -> tuple[str, str, str]:
    """Lloyd loops to the tolerance, the chosen centroids, and all points with their label and distances."""
    loop, labels, out = f"kloop{k}", f"klabels{k}", "assigned" if k == K else f"assigned{k}"
    means = ", ".join(f"CAST(sum(CAST(round({f} * {_UNIT}) AS BIGINT)) AS DOUBLE) / count(*) / {_UNIT}e0" for f in FEATURES)
    label = f"list_position(list_transform(s.c, lambda x: {_to('x')}), list_min(list_transform(s.c, lambda x: {_to('x')})))"
    C[loop] = f"""
SELECT CAST(0 AS BIGINT) AS i, (SELECT list([{', '.join(FEATURES)}] ORDER BY rn) FROM points WHERE rn % (total // {k}) = 0 AND rn // (total // {k}) < {k}) AS c, false AS done
UNION ALL
SELECT i + 1, CASE WHEN near THEN c ELSE moved END, near FROM (
  SELECT i, c, moved, list_bool_and(list_transform(flatten(list_transform(range(1, {k + 1}),
    lambda j: list_transform(range(1, {len(FEATURES) + 1}), lambda f: abs(c[j][f] - moved[j][f]) <= {TOL} + {TOL} * abs(moved[j][f])))), lambda t: t)) AS near
  FROM (
    SELECT any_value(i) AS i, any_value(c) AS c,
      list_transform(range(1, {k + 1}), lambda j: coalesce(map_extract_value(map(list(l), list(m)), j), any_value(c)[j])) AS moved
    FROM (SELECT s.i, s.c, {label} AS l, [{means}] AS m FROM {loop} s, points p WHERE NOT s.done GROUP BY s.i, s.c, l)
    HAVING count(*) > 0))"""
    C[labels] = f"SELECT p.entity_id, {label} - 1 AS label, s.c, s.i AS loops, list_transform(s.c, lambda x: {_to('x')}) AS d FROM points p, {loop} s WHERE s.done"
    C[out] = f"""
SELECT p.*, x.label, x.loops, x.min_sq, x.label AS nearest_label, x.own_sq, sqrt(x.own_sq) AS own_distance,
  CASE WHEN greatest(a, b) = 0 THEN 0e0 ELSE (b - a) / greatest(a, b) END AS silhouette_raw
FROM points p JOIN (
  SELECT entity_id, label, loops, list_min(d) AS min_sq, d[label + 1] AS own_sq,
    CASE WHEN count(*) OVER (PARTITION BY label) <= 1 THEN 0e0 ELSE sqrt(d[label + 1]) END AS a,
    sqrt(list_min(list_concat(d[:label], d[label + 2:]))) AS b FROM {labels}) x USING (entity_id)"""
    return loop, labels, out


_FITS = {k: _fit(k) for k in range(2, 7)}
C["profile_m"] = f"""
SELECT label, count(*) AS n, any_value(total) AS total,
  {', '.join(f"CAST(sum(CAST(round({f} * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 1e4 AS m{i}" for i, f in enumerate(FEATURES))},
  sum(CAST(round(coalesce(risk_score, 0) * 100) AS BIGINT)) / count(*) / 100 AS r,
  count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) AS high_risk_count
FROM assigned a LEFT JOIN (SELECT entity_id, risk_score, risk_level FROM urisk) USING (entity_id) GROUP BY 1"""
_S = ["failed_login", "auth_fail_rate", "off_hours", "endpoint_alert", "source_ip", "host"]
_RULES = [("m0 > 5 OR m1 > 2 OR m2 > 5 OR m4 > 5", "SECURITY_SENSITIVE_OUTLIERS", "Extremely High Auth Failures, Off-Hours & IP Diversity"),
          ("m3 > 1.5", "HIGH_ENDPOINT_ALERT_PROFILE", "Elevated Endpoint Alerts"),
          ("m0 > 1 OR m1 > 0.5 OR m2 > 0.5", "IRREGULAR_AUTHENTICATION_BEHAVIOR", "Moderate Auth Failure & Off-Hours Deviations")]
C["profiles"] = f"""
SELECT 'CLUSTER_' || label AS cluster_id,
  CASE {' '.join(f'WHEN {c} THEN {q(n)}' for c, n, _ in _RULES)} ELSE 'NORMAL_BUSINESS_ACTIVITY' END AS cluster_label,
  n AS population_count, {rnd('n * 100e0 / total', 2)} AS population_percent,
  {', '.join(f"{rnd(f'm{i}', 4)} AS avg_{s}_z" for i, s in enumerate(_S))}, {rnd('r', 2)} AS avg_risk_score, high_risk_count,
  CASE {' '.join(f'WHEN {c} THEN {q(w)}' for c, _, w in _RULES)} ELSE 'Standard Baseline Activity across all features' END AS dominant_features
FROM profile_m"""
C["clusters"] = f"""
SELECT a.entity_id AS user_id, coalesce(i.username, 'Unknown') AS username, coalesce(i.department, 'Unknown') AS department,
  'CLUSTER_' || a.label AS cluster_id, {rnd('sqrt(a.min_sq)', 4)} AS distance_to_centroid, {rnd('a.silhouette_raw', 4)} AS silhouette_width,
  a.behavior_deviation_score, coalesce(r.risk_score, 0) AS risk_score, coalesce(r.risk_level, 'LOW') AS risk_level, p.cluster_label
FROM assigned a LEFT JOIN identity i ON i.user_id = a.entity_id LEFT JOIN urisk r ON r.entity_id = a.entity_id
LEFT JOIN profiles p ON p.cluster_id = 'CLUSTER_' || a.label"""


def _outlier(table: str, key: str, kind: str, dims: list[tuple[str, str, float]], shown: str) -> str:
    z = ", ".join(f"{rnd(e, 2)} AS z{i}" for i, (_, e, _) in enumerate(dims))
    n = " + ".join(f"CASE WHEN z{i} > 2 THEN 1 ELSE 0 END" for i in range(len(dims)))
    act = flags([(f"z{i} > 2", d) for i, (d, _, _) in enumerate(dims)], "|", "NONE")
    score = " + ".join(f"z{i} * {w}e0" for i, (_, _, w) in enumerate(dims))
    return f"""SELECT entity_id, '{kind}' AS entity_type, n AS outlier_dimension_count, active_dimensions, {shown},
  {rnd(score, 2)} AS multi_dimension_outlier_score, {rnd('least(1e0, n * 0.15e0 + 0.5e0)', 2)} AS outlier_confidence,
  n >= 2 AS is_multi_dimensional_outlier
FROM (SELECT *, CAST({n} AS BIGINT) AS n, {act} AS active_dimensions FROM (SELECT {key} AS entity_id, {z} FROM {table}))"""


C["uout"] = _outlier("udev", "user_id", "USER", [
    ("AUTHENTICATION", "failed_login_zscore", 0.3), ("NETWORK_IP", "unique_source_ip_zscore", 0.25),
    ("ENDPOINT", "endpoint_alert_zscore", 0.25), ("OFF_HOURS", "off_hours_zscore", 0.2)],
    "z0 AS auth_zscore, z1 AS network_zscore, z2 AS endpoint_zscore, z3 AS off_hours_zscore")
C["hout"] = _outlier("hdev", "hostname", "HOST", [
    ("FIREWALL_DENY", "firewall_deny_zscore", 0.4), ("NETWORK_VOLUME", "greatest(bytes_sent_zscore, bytes_received_zscore)", 0.3),
    ("ENDPOINT", "endpoint_deviation", 0.3)],
    "0e0 AS auth_zscore, greatest(z0, z1) AS network_zscore, z2 AS endpoint_zscore, 0e0 AS off_hours_zscore")
C["outliers"] = "SELECT * FROM uout UNION ALL SELECT * FROM hout"
C["peer_stat0"] = "SELECT department, median(behavior_deviation_score) AS med FROM udev GROUP BY 1"
C["peer_stat"] = """SELECT p.department, any_value(med) AS med, median(abs(behavior_deviation_score - med)) AS mad
FROM udev JOIN peer_stat0 p ON p.department = udev.department GROUP BY 1"""
C["peers"] = f"""
SELECT *, CASE WHEN global_behavior_score > 2 THEN 'ANOMALOUS' ELSE 'NORMAL' END || '_GLOBALLY_' ||
  CASE WHEN dept_peer_behavior_score > 2.5 THEN 'ANOMALOUS' ELSE 'NORMAL' END || '_PEER' AS global_vs_peer_behavior,
  dept_peer_behavior_score > 2.5 AS peer_outlier_flag
FROM (SELECT user_id, username, u.department, behavior_deviation_score AS global_behavior_score,
  {rnd('(behavior_deviation_score - med) / (CASE WHEN mad > 1e-4 THEN mad ELSE 1e0 END * 1.4826e0)', 4)} AS dept_peer_behavior_score,
  {rnd('behavior_deviation_score - med', 4)} AS peer_deviation_delta
  FROM udev u JOIN peer_stat p ON p.department = u.department)"""

# steps evaluated once: the inputs of the recursive steps and what follows them
_KEPT = {"events_c", "seqs", "seq_ev", "nodes", "edges", "links", "nodes_all", "edges_all", "revid", "points", "path_levels"} | {n for fit in _FITS.values() for n in fit} | {
    f"{n}_{part}" for n in ("useq", "hseq", "ubur", "hbur") for part in ("t", "next", "m", "ev", "s")}
_TOKEN = re.compile(r"\b[a-z_][a-z0-9_]*\b", re.I)
_DEPS = {name: {t for t in _TOKEN.findall(re.sub(r"'[^']*'", "", sql))} & set(C) - {name} for name, sql in C.items()}


def assemble(sql: str) -> str:
    """The query with every step it needs as a common table expression."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for dep in sorted(_DEPS[name]):
            add(dep)
        ordered.append(name)

    for token in _TOKEN.findall(re.sub(r"'[^']*'", "", sql)):
        if token in C:
            add(token)
    if not ordered:
        return sql
    steps = [f"{n} AS {'MATERIALIZED ' if n in _KEPT else ''}({C[n]})" for n in ordered]
    return "WITH RECURSIVE " + ",\n".join(steps) + "\n" + sql
