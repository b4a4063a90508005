"""Rule suites of the exported tables, as functions of a table, and writing with rules checked in the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import network
from . import clean
from .quality import Rule, counted, repeated_keys, report, suite

# What the exported columns may hold.
DEPARTMENTS = [
    "IT", "Human Resources", "Finance", "Operations", "Procurement", "Marketing", "Sales", "Legal", "R&D",
    "Customer Support", "Support", "Call Center", "Brand", "Compliance", "Innovation", "Supply Chain", "IT Support", "Unknown",
]
EMPLOYED = ["Active", "On Leave", "Disabled", "Blocked"]
EVENT_TYPES = ["login_success", "login_failed", "other"]
NO_REASON = ["Not Applicable", "Unknown"]

c = F.col


def _is_time(column: str) -> Column:
    return F.try_to_timestamp(c(column)).isNotNull()


def _whole(columns: list[str]) -> Rule:
    return Rule("no missing cell", F.forall(F.array(*[c(n).isNotNull() for n in columns]), lambda filled: filled))


def identity_rules() -> list[Rule]:
    employed, ended = c("status").isin(EMPLOYED), c("status") == "Terminated"
    return [
        _whole(clean.IDENTITY_COLUMNS),
        Rule("user_id format", c("user_id").rlike("^EMP[0-9]+$")),
        Rule("department", c("department").isin(DEPARTMENTS)),
        Rule("status", c("status").isin(*EMPLOYED, "Terminated", "Unknown")),
        Rule("hire date", (c("hire_date") == "Unknown") | _is_time("hire_date")),
        Rule("termination date", c("termination_date").isin("Unknown", "Not Terminated") | _is_time("termination_date")),
        Rule("terminated is not open", ~ended | (c("termination_date") != "Not Terminated")),
        Rule("terminated has a date", ~ended | (c("termination_date") != "Unknown")),
        Rule("employed end is known", ~employed | (c("termination_date") != "Unknown")),
        Rule("employed has no end", ~employed | c("termination_date").isin("Unknown", "Not Terminated")),
        Rule("hired before the end", F.coalesce(F.try_to_timestamp("hire_date") <= F.try_to_timestamp("termination_date"), F.lit(True))),
    ]


def iam_rules() -> list[Rule]:
    failed = c("event_type") == "login_failed"
    return [
        _whole(clean.IAM_COLUMNS),
        Rule("user_id format", c("user_id").rlike("^EMP[0-9]+$")),
        Rule("department", c("department").isin(DEPARTMENTS)),
        Rule("event type", c("event_type").isin(EVENT_TYPES)),
        Rule("mfa", c("mfa_passed").isin("True", "False", "Unknown")),
        Rule("source address", (c("source_ip") == "Unknown") | network.is_ip(c("source_ip"))),
        Rule("risk in 0..100", c("risk_score").between(0, 100)),
        Rule("timestamp", (c("timestamp") == "Unknown") | _is_time("timestamp")),
        Rule("no failure, no reason", failed | c("failure_reason").isin(NO_REASON)),
        Rule("failed login has no n/a reason", ~failed | (c("failure_reason") != "Not Applicable")),
    ]


ROW_RULES = {"identity": identity_rules, "iam": iam_rules}


def identity_suite(table: DataFrame) -> DataFrame:
    """Report over the exported identity table: its row rules in one aggregation, repeated rows and ids."""
    return report([
        suite(table, identity_rules(), "identity"),
        counted("duplicate rows", "identity", repeated_keys(table, *clean.IDENTITY_COLUMNS)),
        counted("unique user_id", "identity", repeated_keys(table, "user_id"))])


def iam_suite(table: DataFrame) -> DataFrame:
    """Report over the exported sign-in table: its row rules in one aggregation, repeated rows and ids."""
    return report([
        suite(table, iam_rules(), "iam"),
        counted("duplicate rows", "iam", repeated_keys(table, *clean.IAM_COLUMNS)),
        counted("unique event_id", "iam", repeated_keys(table, "event_id"))])


def write_checked(df: DataFrame, path: str, rules: list[Rule]) -> tuple[int, dict[str, int]]:
    """Write a table; its rows and the violations of each rule, counted by the pass that writes it."""
    seen = Observation()
    broken = [F.count(F.when(~F.coalesce(r.holds, F.lit(False)), 1)).alias(r.name) for r in rules]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *broken).write.mode("overwrite").parquet(path)
    found = dict(seen.get)
    return found.pop("rows"), found


def write_report(spark: SparkSession, written: dict[str, tuple[int, dict[str, int]]]) -> DataFrame:
    """(table_name, check_name, violations, status) of tables written by ``write_checked``; INFO rows hold row counts."""
    rows = [(t, "rows", n, "INFO") for t, (n, _) in written.items()]
    rows += [(t, name, v, "FAIL" if v else "PASS") for t, (_, found) in written.items() for name, v in found.items()]
    return spark.createDataFrame(rows, "table_name string, check_name string, violations long, status string")
