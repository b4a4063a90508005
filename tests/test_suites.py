"""Rule suites on planted rows, and tables written with their rules."""

from vantry.operators import clean, suites
from vantry.plans.pipeline import open_pipeline

GOOD = dict.fromkeys(clean.IDENTITY_COLUMNS, "x") | {
    "user_id": "EMP1", "department": "IT", "status": "Active", "hire_date": "2020-01-02 00:00:00", "termination_date": "Not Terminated"}
SIGN_IN = dict.fromkeys(clean.IAM_COLUMNS, "x") | {
    "event_id": "E1", "user_id": "EMP1", "department": "IT", "event_type": "login_success", "mfa_passed": "True", "source_ip": "10.0.0.1",
    "risk_score": 5.0, "timestamp": "2024-01-02 03:04:05", "failure_reason": "Not Applicable"}


def table(spark, rows, columns):
    kinds = ", ".join(f"{n} {'double' if n == 'risk_score' else 'string'}" for n in columns)
    return spark.createDataFrame([tuple(r[n] for n in columns) for r in rows], kinds)


def violations(df):
    return {r.check_name: (r.violations, r.status) for r in df.collect()}


def test_identity_suite_finds_each_planted_row(spark):
    planted = {
        "user_id format": {"user_id": "E9"}, "department": {"department": "Moon"}, "status": {"status": "Gone"},
        "hire date": {"hire_date": "Not Terminated"}, "termination date": {"status": "Unknown", "termination_date": "soon"},
        "terminated is not open": {"status": "Terminated"}, "terminated has a date": {"status": "Terminated", "termination_date": "Unknown"},
        "employed end is known": {"termination_date": "Unknown"}, "employed has no end": {"termination_date": "2024-01-01 00:00:00"},
        "hired before the end": {"status": "Terminated", "termination_date": "2019-01-01 00:00:00"}, "no missing cell": {"role": None}}
    rows = [GOOD] + [GOOD | {"user_id": f"EMP{k + 2}"} | p for k, p in enumerate(planted.values())] + [GOOD]
    got = violations(suites.identity_suite(table(spark, rows, clean.IDENTITY_COLUMNS)))
    assert got == {n: (1, "FAIL") for n in [*planted, "duplicate rows", "unique user_id"]}
    empty = violations(suites.identity_suite(table(spark, [], clean.IDENTITY_COLUMNS)))
    assert set(empty.values()) == {(0, "PASS")}


def test_iam_suite_finds_each_planted_row(spark):
    planted = {
        "user_id format": {"user_id": "Unknown"}, "department": {"department": "it"}, "event type": {"event_type": "logout"},
        "mfa": {"mfa_passed": "yes"}, "source address": {"source_ip": "10.0.0.999"}, "risk in 0..100": {"risk_score": 100.5},
        "timestamp": {"timestamp": "later"}, "no failure, no reason": {"failure_reason": "Bad Password"},
        "failed login has no n/a reason": {"event_type": "login_failed"}, "no missing cell": {"hostname": None}}
    rows = [SIGN_IN] + [SIGN_IN | {"event_id": f"E{k + 2}"} | p for k, p in enumerate(planted.values())]
    got = violations(suites.iam_suite(table(spark, rows, clean.IAM_COLUMNS)))
    assert got == {n: (1, "FAIL") for n in planted} | {"duplicate rows": (0, "PASS"), "unique event_id": (0, "PASS")}


def test_export_counts_rules_while_it_writes(spark, folder, tmp_path):
    p = open_pipeline(spark, folder)
    got = {(r.table_name, r.check_name): r.violations for r in p.export(f"{tmp_path}/out", ("identity", "iam", "users")).collect()}
    for name, fn in (("identity", suites.identity_suite), ("iam", suites.iam_suite)):
        written = spark.read.parquet(f"{tmp_path}/out/{name}")
        assert got[name, "rows"] == written.count() > 0
        again = {r.check_name: r.violations for r in fn(written).collect()}
        assert {n: v for (t, n), v in got.items() if t == name and n != "rows"} == {n: again[n] for n in again if not n.startswith(("duplicate", "unique"))}
    assert got["users", "rows"] == p.users.count()
