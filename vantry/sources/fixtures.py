"""Four raw telemetry tables derived from the driver's star-schema parquet.

The text is plain SQL that Spark and DuckDB both run; the few dialect
differences are tokens replaced by :func:`render`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

IDENTITY_RAW = """
WITH b AS (
  SELECT c_custkey AS k, c_name, c_mktsegment AS seg, n_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
, r AS (
  SELECT
    CASE WHEN k % 5 = 0 THEN concat('EMP', CAST(k AS STRING))
         WHEN k % 5 = 1 THEN concat('emp', CAST(k AS STRING))
         WHEN k % 5 = 2 THEN concat('EMP-', CAST(k AS STRING))
         WHEN k % 5 = 3 THEN concat(' EMP ', CAST(k AS STRING))
         ELSE CAST(k AS STRING) END AS user_id,
    CASE WHEN k % 41 = 0 THEN CAST(NULL AS STRING)
         WHEN k % 2 = 0 THEN upper(replace(c_name, '#', '.')) ELSE concat(' ', replace(c_name, '#', '.')) END AS username,
    CASE WHEN k % 43 = 0 THEN '' WHEN k % 47 = 0 THEN 'Moon Base'
         WHEN seg = 'AUTOMOBILE' THEN CASE WHEN k % 3 = 0 THEN 'it' WHEN k % 3 = 1 THEN 'IT  Dept' ELSE 'Information Technology' END
         WHEN seg = 'BUILDING' THEN CASE WHEN k % 3 = 0 THEN 'hr' WHEN k % 3 = 1 THEN 'People Team' ELSE 'Human Resources' END
         WHEN seg = 'FURNITURE' THEN CASE WHEN k % 3 = 0 THEN 'ops' WHEN k % 3 = 1 THEN 'Operations Dept' ELSE 'OPERATIONS' END
         WHEN seg = 'HOUSEHOLD' THEN CASE WHEN k % 3 = 0 THEN 'fin' WHEN k % 3 = 1 THEN 'Accounts' ELSE ' Finance ' END
         ELSE CASE WHEN k % 3 = 0 THEN 'sales team' WHEN k % 3 = 1 THEN 'Business Sales' ELSE 'SALES' END END AS department,
    CASE WHEN k % 6 = 0 THEN 'LIVE' WHEN k % 6 = 1 THEN 'active' WHEN k % 6 = 2 THEN 'Resigned'
         WHEN k % 6 = 3 THEN 'on  leave' WHEN k % 6 = 4 THEN 'D' ELSE 'zzz' END AS status,
    CASE WHEN k % 8 = 0 THEN CAST(NULL AS STRING)
         WHEN k % 8 = 1 THEN '2023/02/15' WHEN k % 8 = 2 THEN '15-02-2023'
         WHEN k % 8 = 3 THEN '1676419200' WHEN k % 8 = 4 THEN '44972'
         WHEN k % 8 = 5 THEN 'not available' WHEN k % 8 = 6 THEN '15-Feb-2023' ELSE '2023-02-15 10:30:00' END AS hire_date,
    CASE WHEN k % 6 = 2 AND k % 4 <> 0 THEN '2024-01-20' WHEN k % 53 = 0 THEN '2022-01-01'
         ELSE CAST(NULL AS STRING) END AS termination_date,
    CASE WHEN k % 11 = 0 THEN '' ELSE concat('Mgr.', CAST(k % 17 AS STRING)) END AS manager_username,
    CASE WHEN k % 13 = 0 THEN CAST(NULL AS STRING) ELSE concat('dev-', CAST(k AS STRING)) END AS device_id,
    concat(' ', n_name, '  site ') AS location,
    CASE WHEN k % 59 = 0 THEN CAST(NULL AS STRING)
         WHEN k % 3 = 0 THEN concat('ws_', CAST(k % 200 AS STRING), '.corp.local')
         ELSE concat('WS-', CAST(k % 200 AS STRING)) END AS hostname,
    CASE WHEN k % 61 = 0 THEN CAST(NULL AS STRING) ELSE concat('Person ', CAST(k AS STRING)) END AS full_name,
    CASE WHEN k % 4 = 0 THEN 'Engineer' WHEN k % 4 = 1 THEN 'Analyst' WHEN k % 4 = 2 THEN 'Manager'
         ELSE CAST(NULL AS STRING) END AS role,
    k AS dup_key
  FROM b)
, d AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE dup_key % 33 = 0)
SELECT user_id, username, department, status, hire_date, termination_date, manager_username,
       device_id, location, hostname, full_name, role
FROM d
"""

IAM_RAW = """
WITH r AS (
  SELECT event_id AS n,
    concat('EVT-', CAST(event_id AS STRING)) AS event_id,
    CASE WHEN event_id % 6 = 0 THEN CAST(NULL AS STRING)
         WHEN event_id % 91 = 1 THEN concat(replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T'), '+05:30')
         WHEN event_id % 91 = 7 THEN replace(substr(CAST(ts AS STRING), 1, 16), ' ', 'T')
         WHEN event_id % 91 = 13 THEN concat(substr(CAST(ts AS STRING), 1, 19), '.123456789')
         WHEN event_id % 91 = 19 THEN replace(substr(CAST(ts AS STRING), 1, 10), '-', '')
         WHEN event_id % 91 = 25 THEN concat('Jan ', substr(CAST(ts AS STRING), 9, 2), ' ', substr(CAST(ts AS STRING), 1, 4), substr(CAST(ts AS STRING), 11, 6))
         WHEN event_id % 91 = 31 THEN concat(substr(CAST(ts AS STRING), 9, 2), ' January ', substr(CAST(ts AS STRING), 1, 4), substr(CAST(ts AS STRING), 11, 6))
         WHEN event_id % 6 = 1 THEN substr(CAST(ts AS STRING), 1, 19)
         WHEN event_id % 6 = 2 THEN replace(substr(CAST(ts AS STRING), 1, 19), '-', '/')
         WHEN event_id % 6 = 3 THEN replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T')
         WHEN event_id % 6 = 4 THEN CAST(CAST(__EPOCH__(date_trunc('second', ts)) AS BIGINT) AS STRING)
         WHEN event_id % 101 = 0 THEN 'yesterday'
         ELSE concat(substr(CAST(ts AS STRING), 6, 2), '/', substr(CAST(ts AS STRING), 9, 2), '/',
                     substr(CAST(ts AS STRING), 1, 4), substr(CAST(ts AS STRING), 11, 9)) END AS timestamp,
    CASE WHEN event_id % 211 = 0 THEN 'svc account' WHEN event_id % 3 = 0 THEN concat('emp-', CAST(user_id AS STRING))
         WHEN event_id % 3 = 1 THEN CAST(user_id AS STRING)
         ELSE concat('EMP', CAST(user_id AS STRING)) END AS user_id,
    CASE WHEN user_id % 41 = 0 THEN 'null' ELSE concat('customer.', CAST(user_id AS STRING)) END AS username,
    CASE WHEN user_id % 5 = 0 THEN 'IT Dept' WHEN user_id % 5 = 1 THEN 'hr' WHEN user_id % 5 = 2 THEN 'Ops'
         WHEN user_id % 5 = 3 THEN 'Moon Base' ELSE 'N/A' END AS department,
    CASE WHEN event_type = 'error' THEN 'MFA Failed' WHEN event_type = 'signup' THEN 'sso-success'
         WHEN event_type = 'purchase' THEN 'successful login' ELSE event_type END AS event_type,
    CASE WHEN event_id % 5 = 0 THEN 'pwd' WHEN event_id % 5 = 1 THEN 'SSO' WHEN event_id % 5 = 2 THEN 'multi-factor'
         WHEN event_id % 5 = 3 THEN 'Smart Card' ELSE 'none' END AS auth_method,
    CASE WHEN event_id % 8 = 0 THEN '300.1.1.1' WHEN event_id % 97 = 0 THEN ''
         ELSE concat('10.0.', CAST(event_id % 6 AS STRING), '.', CAST((event_id * 7 + user_id) % 40 AS STRING)) END AS source_ip,
    CASE WHEN event_id % 2 = 0 THEN concat('WS-', CAST(user_id % 200 AS STRING))
         ELSE concat('ws_', CAST(user_id % 200 AS STRING), '.corp.local') END AS hostname,
    concat('dev-', CAST(user_id AS STRING)) AS device_id,
    CASE WHEN event_id % 4 = 0 THEN 'NA' ELSE concat('S', CAST(event_id % 4000 AS STRING)) END AS session_id,
    CASE WHEN event_id % 6 = 0 THEN '1' WHEN event_id % 6 = 1 THEN 'N' WHEN event_id % 6 = 2 THEN 'yes'
         WHEN event_id % 6 = 3 THEN 'False' WHEN event_id % 6 = 4 THEN 'passed' ELSE 'maybe' END AS mfa_passed,
    CASE WHEN event_id % 5 = 0 THEN 'N/A' WHEN event_id % 5 = 1 THEN 'otp_expired'
         WHEN event_id % 5 = 2 THEN 'Odd Reason' ELSE 'Wrong Password' END AS failure_reason,
    CASE WHEN event_id % 7 = 0 THEN 'High' WHEN event_id % 7 = 1 THEN '-2' WHEN event_id % 7 = 2 THEN CAST(NULL AS STRING)
         WHEN event_id % 7 = 3 THEN concat(CAST(event_id % 131 AS STRING), '/100') WHEN event_id % 7 = 4 THEN 'weird'
         ELSE CAST(event_id % 120 AS STRING) END AS risk_score,
    CASE WHEN event_id % 3 = 0 THEN 'IN' WHEN event_id % 3 = 1 THEN 'US' ELSE '' END AS geo_location
  FROM events)
, d AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE n % 40 = 0)
SELECT event_id, timestamp, user_id, username, department, event_type, auth_method, source_ip, hostname,
       device_id, session_id, mfa_passed, failure_reason, risk_score, geo_location
FROM d
"""

ENDPOINT_RAW = """
WITH b AS (
  SELECT o_orderkey AS n, o_custkey AS k, o_orderpriority AS pri, o_orderstatus AS st,
    {TS} '2024-01-01 00:00:00' + CAST((o_orderkey * 7919) % 2592000 AS INT) * INTERVAL '1' SECOND AS det,
    {TS} '2024-01-01 00:00:00' + CAST((o_orderkey * 7919) % 2592000 + (o_orderkey % 400) * 60 - 600 AS INT) * INTERVAL '1' SECOND AS res
  FROM orders)
, r AS (
  SELECT n, concat('ALT-', CAST(n AS STRING)) AS alert_id,
    CASE WHEN n % 19 = 0 THEN CAST(NULL AS STRING) WHEN n % 23 = 0 THEN 'soon'
         WHEN n % 47 = 0 THEN concat(substr(CAST(det AS STRING), 1, 19), '+02:00')
         WHEN n % 4 = 0 THEN substr(CAST(det AS STRING), 1, 19)
         WHEN n % 4 = 1 THEN concat(substr(CAST(det AS STRING), 9, 2), '/', substr(CAST(det AS STRING), 6, 2), '/',
                                    substr(CAST(det AS STRING), 1, 4), substr(CAST(det AS STRING), 11, 9))
         WHEN n % 4 = 2 THEN CAST(CAST(__EPOCH__(det) AS BIGINT) AS STRING)
         ELSE concat(replace(substr(CAST(det AS STRING), 1, 19), ' ', 'T'), 'Z') END AS detected_timestamp,
    CASE WHEN n % 9 = 0 THEN CAST(NULL AS STRING)
         WHEN n % 2 = 0 THEN substr(CAST(res AS STRING), 1, 19)
         ELSE replace(substr(CAST(res AS STRING), 1, 19), '-', '/') END AS resolved_timestamp,
    concat('ws_', CAST(k % 260 AS STRING)) AS hostname,
    CASE WHEN n % 37 = 0 THEN '??' ELSE concat('EMP ', CAST(k AS STRING)) END AS user_id,
    CASE WHEN n % 3 = 0 THEN 'SensorA' WHEN n % 3 = 1 THEN 'SensorB' ELSE CAST(NULL AS STRING) END AS endpoint_product,
    CASE WHEN n % 6 = 0 THEN 'Malware Detected' WHEN n % 6 = 1 THEN 'Suspicious Script' WHEN n % 6 = 2 THEN 'Port Scan'
         WHEN n % 6 = 3 THEN 'Credential Dump' WHEN n % 6 = 4 THEN 'USB Insert' ELSE 'Policy Violation' END AS alert_name,
    CASE WHEN pri = '1-URGENT' THEN 'p1' WHEN pri = '2-HIGH' THEN 'Major'
         WHEN pri = '3-MEDIUM' THEN 'm' WHEN pri = '5-LOW' THEN 'LOW' ELSE '?' END AS severity,
    CASE WHEN st = 'O' THEN 'active' WHEN st = 'F' THEN 'closed' WHEN n % 2 = 0 THEN 'in_progress' ELSE 'false-positive' END AS status,
    concat('alert ', CAST(n AS STRING)) AS description,
    CASE WHEN n % 10 = 0 THEN CAST(NULL AS STRING) ELSE concat('/opt/app/', CAST(n % 50 AS STRING)) END AS file_path,
    concat('proc', CAST(n % 25 AS STRING)) AS process_name,
    CASE WHEN n % 5 = 0 THEN 'abc' WHEN n % 5 = 1 THEN CAST(NULL AS STRING)
         WHEN n % 5 = 2 THEN concat('zz', substr(concat(md5(CAST(n AS STRING)), md5(CAST(k AS STRING))), 3))
         WHEN n % 45 = 3 THEN 'not available'
         ELSE upper(concat(md5(CAST(n AS STRING)), md5(CAST(k AS STRING)))) END AS sha256,
    CASE WHEN n % 8 = 0 THEN CAST(NULL AS STRING) ELSE concat('analyst', CAST(n % 9 AS STRING)) END AS assigned_to,
    CASE WHEN n % 6 = 0 THEN 'critical' WHEN n % 6 = 1 THEN 'H' WHEN n % 6 = 2 THEN 'medium' WHEN n % 6 = 3 THEN 'l'
         WHEN n % 6 = 4 THEN CAST(NULL AS STRING) ELSE 'tier9' END AS device_criticality
  FROM b)
, d AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE n % 33 = 0)
SELECT alert_id, detected_timestamp, resolved_timestamp, hostname, user_id, endpoint_product, alert_name, severity,
       status, description, file_path, process_name, sha256, assigned_to, device_criticality
FROM d
"""

FIREWALL_RAW = """
WITH b AS (
  SELECT l_orderkey AS okey, l_linenumber AS ln, l_suppkey AS sk, l_partkey AS pk,
    CAST(floor(l_extendedprice) AS BIGINT) AS price, l_returnflag AS rf,
    {TS} '2024-01-01 00:00:00' + CAST((l_orderkey * 6101 + l_linenumber * 977 + l_partkey * 31) % 2592000 AS INT) * INTERVAL '1' SECOND AS ts
  FROM lineitem)
, r AS (
  SELECT okey, concat('LOG-', CAST(okey AS STRING), '-', CAST(ln AS STRING), '-', CAST(pk AS STRING), '-', CAST(sk AS STRING), '-',
                CAST(price AS STRING)) AS log_id,
    CASE WHEN pk % 29 = 0 THEN CAST(NULL AS STRING)
         WHEN pk % 43 = 0 THEN concat(replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T'), '-03:30')
         WHEN pk % 53 = 0 THEN concat(substr(CAST(ts AS STRING), 1, 19), ' +0100') WHEN ln % 2 = 0 THEN substr(CAST(ts AS STRING), 1, 19)
         ELSE concat(replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T'), 'Z') END AS timestamp,
    CASE WHEN sk % 31 = 0 THEN CAST(NULL AS STRING)
         WHEN sk % 2 = 0 THEN concat('ws-', CAST(sk * 3 AS STRING), '.CORP.LOCAL') ELSE concat('WS_', CAST(sk * 3 AS STRING)) END AS hostname,
    concat('10.0.', CAST(sk % 6 AS STRING), '.', CAST(pk % 40 AS STRING)) AS src_ip,
    CASE WHEN pk % 6 = 0 THEN 'bad_ip' ELSE concat('203.0.113.', CAST(pk % 120 AS STRING)) END AS dst_ip,
    CASE WHEN pk % 7 = 0 THEN CAST(NULL AS STRING) ELSE CAST(1024 + pk % 60000 AS STRING) END AS src_port,
    CASE WHEN pk % 9 = 0 THEN '0' WHEN pk % 9 = 1 THEN 'http' WHEN pk % 9 = 2 THEN '70000' WHEN pk % 9 = 3 THEN '443.0'
         WHEN pk % 9 = 4 THEN '80.5' ELSE CAST(1 + pk % 65535 AS STRING) END AS dst_port,
    CASE WHEN ln % 4 = 0 THEN 'tcp/6' WHEN ln % 4 = 1 THEN '17' WHEN ln % 4 = 2 THEN 'ping' ELSE 'GRE' END AS protocol,
    CASE WHEN rf = 'R' THEN 'drop' WHEN rf = 'A' THEN 'Permit' WHEN pk % 2 = 0 THEN 'log' ELSE 'BLOCK' END AS action,
    CASE WHEN pk % 5 = 0 THEN concat(CAST(pk % 40 AS STRING), '.5 KB') WHEN pk % 5 = 1 THEN '-5' WHEN pk % 5 = 2 THEN 'n/a'
         WHEN pk % 5 = 3 THEN concat(CAST(pk % 7 AS STRING), ' mb') ELSE CAST(price AS STRING) END AS bytes_sent,
    CASE WHEN pk % 4 = 0 THEN CAST(NULL AS STRING) WHEN pk % 4 = 1 THEN concat(CAST(price % 900 AS STRING), 'KB')
         ELSE CAST(price * 2 AS STRING) END AS bytes_received,
    CASE WHEN okey % 3 = 0 THEN CAST(NULL AS STRING) ELSE concat('S', CAST(okey % 9000 AS STRING)) END AS session_id,
    CASE WHEN pk % 11 = 0 THEN 'Y' WHEN pk % 11 = 1 THEN '?' ELSE '0' END AS threat_flag,
    CASE WHEN pk % 12 = 0 THEN CAST(NULL AS STRING) ELSE concat('rule-', CAST(pk % 30 AS STRING)) END AS rule_name,
    CASE WHEN sk % 3 = 0 THEN 'IN' WHEN sk % 3 = 1 THEN 'US' ELSE CAST(NULL AS STRING) END AS geo_country
  FROM b)
, d AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE okey % 50 = 1)
SELECT log_id, timestamp, hostname, src_ip, dst_ip, src_port, dst_port, protocol, action, bytes_sent, bytes_received,
       session_id, threat_flag, rule_name, geo_country
FROM d
"""

RAW_SQL = {
    "identity_raw": IDENTITY_RAW,
    "iam_raw": IAM_RAW,
    "endpoint_raw": ENDPOINT_RAW,
    "firewall_raw": FIREWALL_RAW,
}


def render(text: str, dialect: str) -> str:
    """Fill the dialect tokens of a fixture view (``spark`` or ``duckdb``)."""
    if dialect == "spark":
        return text.replace("{TS}", "TIMESTAMP_NTZ").replace("__EPOCH__", "unix_timestamp")
    return text.replace("{TS}", "TIMESTAMP").replace("__EPOCH__", "epoch")


def driver_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every driver table of a scale-factor folder, lazily read."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in DRIVER_TABLES}


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four raw telemetry tables as lazy DataFrames.

    Inputs are passed as query parameters of ``spark.sql`` so that several
    folders can be open in one session without clashing view names.
    """
    tables = driver_tables(spark, folder)
    out = {}
    for name, text in RAW_SQL.items():
        sql = render(text, "spark")
        used = {}
        for table in ("customer", "nation", "events", "orders", "lineitem"):
            for word in (f"FROM {table}", f"JOIN {table}"):
                if word in sql:
                    sql = sql.replace(word, word.replace(table, "{" + table + "}"))
                    used[table] = tables[table]
        out[name] = spark.sql(sql, **used)
    return out
