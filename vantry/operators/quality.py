"""Profiling reports and rule suites over raw and clean tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import network, numbers, text, times
from .joins import broadcast_if_small, top_per_group


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n) over text columns, NULL included.

    Columns are turned into rows and counted with a map-side combine, so one
    pass serves every profile below.
    """
    columns = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("kv")).select("kv.*")
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def percent(num: Column, den: Column) -> Column:
    return numbers.round_half_up(numbers.ratio(num, den) * 100.0, 2)


def shares(df: DataFrame, column: str) -> DataFrame:
    """Count and percent of all rows per value; the total is one number."""
    total = df.count()
    n = F.col("n")
    return df.groupBy(column).agg(F.count("*").alias("n")).select(
        column, "n", numbers.round_half_up(n * 100.0 / F.lit(float(total)), 2).alias("pct"))


def missing_counts(df: DataFrame) -> DataFrame:
    """Rows and missing values per column, all in one aggregate that explodes nothing."""
    names = df.columns
    one = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in names])
    return one.unpivot(["_rows"], [f"m_{c}" for c in names], "column_name", "missing_count").select(
        F.substring(F.col("column_name"), 3, 1 << 30).alias("column_name"), F.col("_rows").alias("row_count"), "missing_count")


def column_profile(df: DataFrame, dataset: str) -> DataFrame:
    """Rows, type, missing and distinct values per column.

    Every column is a scan of its own that reads nothing else, all of them side by side
    in one aggregation with a map-side combine; no row is copied once a column. Meant for
    columnar tables: store a table of text lines first.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cell = lambda c: df.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
    values = reduce(DataFrame.unionByName, [cell(c) for c in types]).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    none = df.sparkSession.createDataFrame([(c, None, 0) for c in types], "column_name string, value string, n long")  # columns of an empty table
    counts = values.unionByName(none).groupBy("column_name").agg(
        F.sum("n").alias("row_count"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("missing_count"), F.count("value").alias("unique_count"))
    dtype = reduce(lambda acc, kv: F.when(F.col("column_name") == kv[0], kv[1]).otherwise(acc), types.items(), F.lit(None))
    return counts.select(
        F.lit(dataset).alias("dataset"), "column_name", "row_count", dtype.alias("dtype"), "missing_count",
        percent(F.col("missing_count"), F.col("row_count")).alias("missing_percentage"), "unique_count")


def missing_report(df: DataFrame, dataset: str) -> DataFrame:
    return missing_counts(df).select(
        F.lit(dataset).alias("dataset"), "column_name", "missing_count",
        percent(F.col("missing_count"), F.col("row_count")).alias("missing_percentage")).orderBy(F.desc("missing_percentage"), "column_name")


def top_values(df: DataFrame, dataset: str, n: int = 50) -> DataFrame:
    ranked = top_per_group(value_counts(df), ["column_name"], [F.desc("n"), F.asc_nulls_first("value")], n)
    return ranked.select(F.lit(dataset).alias("dataset"), "column_name", F.coalesce("value", F.lit("nan")).alias("value"), "n")


def variations(df: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    """Spellings of categorical fields with their frequency."""
    trimmed = df.select(*[F.btrim(F.col(c), F.lit(text.BLANKS)).alias(c) for c in columns])
    return value_counts(trimmed, columns).where(F.col("value").isNotNull()).select(
        F.lit(dataset).alias("dataset"), "column_name", F.col("value").alias("raw_value"), F.col("n").alias("frequency"))


def duplicate_rows(df: DataFrame, dataset: str) -> DataFrame:
    """Whole-row duplicates: groups, rows in them, and surplus rows."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    many = F.col("_n") > 1
    total = F.sum("_n")
    return copies.agg(
        total.alias("total_rows"),
        F.coalesce(F.sum(F.when(many, F.col("_n"))), F.lit(0)).alias("exact_duplicate_rows"),
        F.count_if(many).alias("exact_duplicate_groups"),
        F.sum(F.col("_n") - 1).alias("surplus_rows"),
    ).select(
        F.lit(dataset).alias("dataset"), "*",
        percent(F.col("exact_duplicate_rows"), F.col("total_rows")).alias("duplicate_percentage"))


def duplicate_keys(df: DataFrame, dataset: str, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    many = F.col("_n") > 1
    return counts.agg(
        F.count(key).alias("unique_ids"),
        F.count_if(many).alias("duplicate_id_values"),
        F.coalesce(F.sum(F.when(many, F.col("_n"))), F.lit(0)).alias("rows_with_duplicate_ids"),
    ).select(F.lit(dataset).alias("dataset"), F.lit(key).alias("id_column"), "*")


def conflicting_keys(df: DataFrame, dataset: str, key: str) -> DataFrame:
    """Keys that occur with different row contents.

    Equal rows are counted first, so a key with very many copies is small.
    """
    distinct = df.where(F.col(key).isNotNull()).groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return distinct.groupBy(key).agg(
        F.sum("_n").alias("row_count"), F.count("*").alias("distinct_row_count")
    ).where(F.col("distinct_row_count") > 1).select(
        F.lit(dataset).alias("dataset"), F.lit(key).alias("id_column"), F.col(key).alias("id_value"), "row_count",
        "distinct_row_count")


def _parsed_counts(df: DataFrame, column: str, **options) -> DataFrame:
    """Distinct texts of a column with their count and parsed time.

    Equal texts are counted first, so each is parsed once.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    trimmed = counts.select(text.trimmed(F.col(column)).alias("raw_value"), "n")
    return trimmed.withColumn("parsed", times.parse_timestamp(F.col("raw_value"), **options))


def timestamp_profile(df: DataFrame, dataset: str, column: str, **options) -> DataFrame:
    """How well a text column parses as time."""
    p = _parsed_counts(df, column, **options)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    has, ok = F.col("raw_value").isNotNull(), F.col("parsed").isNotNull()
    return p.agg(
        F.sum("n").alias("total_rows"), total(~has).alias("raw_missing"), total(has).alias("non_missing"),
        total(ok).alias("parseable_values"), total(has & ~ok).alias("parse_failures"),
        F.count_distinct("raw_value").alias("unique_raw_values"),
    ).select(
        F.lit(dataset).alias("dataset"), F.lit(column).alias("column_name"), "*",
        percent(F.col("parseable_values"), F.col("non_missing")).alias("parse_success_rate_pct"))


def parse_failures(df: DataFrame, column: str, n: int = 100, **options) -> DataFrame:
    """The first ``n`` distinct texts that do not parse."""
    tried = _parsed_counts(df, column, **options).groupBy("raw_value").agg(F.max("parsed").alias("parsed"))
    return tried.where(F.col("raw_value").isNotNull() & F.col("parsed").isNull()).select("raw_value").orderBy(
        "raw_value").limit(n)


def chronology_issues(endpoint: DataFrame) -> DataFrame:
    """Alerts resolved before they were detected, with the hours between."""
    start, end = F.col("detected_timestamp"), F.col("resolved_timestamp")
    hours = (times.micros(end) - times.micros(start)) / F.lit(3.6e9)
    return endpoint.where(times.ends_before_start(start, end)).select(
        "alert_id", times.as_text(start).alias("detected"), times.as_text(end).alias("resolved"), "user_id", "hostname",
        "severity", "status", numbers.round_half_up(hours, 4).alias("duration_hours"))


def invalid_values(df: DataFrame, column: str, status: Column, good: list[str]) -> DataFrame:
    """Frequency of raw values whose status is not one of ``good``."""
    counts = df.groupBy(F.col(column).alias("raw_value")).agg(F.count("*").alias("n"))
    return counts.withColumn("status", status).where(~F.col("status").isin(good)).select("raw_value", "status", "n")


def validity_profile(df: DataFrame, dataset: str, ips: list[str], ports: list[str], sizes: list[str]) -> DataFrame:
    """valid / invalid / missing counts of network fields in one pass."""
    status = {}
    for c in ips:
        status[c] = ("IP address", network.ip_status(F.col(c)))
    for c in ports:
        status[c] = ("Port", numbers.port_status(F.col(c), low=0))
    for c in sizes:
        status[c] = ("Bytes", numbers.status_of(F.col(c), numbers.byte_size(F.col(c), allow_negative=True)))
    df = df.select(*[text.trimmed(F.col(c)).alias(c) for c in status])
    df = df.select(*[s.alias(c) for c, (_, s) in status.items()])
    rows = df.agg(*[
        F.struct(
            F.lit(kind).alias("field_type"),
            *[F.count_if(F.col(c) == s).alias(s) for s in ("missing", "valid", "invalid")],
        ).alias(c) for c, (kind, _) in status.items()
    ]).unpivot([], list(status), "field", "s")
    return rows.select(F.lit(dataset).alias("dataset"), "field", "s.*")


def key_normalization(df: DataFrame, dataset: str, column: str, members: DataFrame, member_key: str) -> DataFrame:
    """Raw ids by normalisation status and match with the master.

    Equal ids are counted first, so the join sees each id once.
    """
    counts = df.groupBy(F.col(column).alias("raw")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("clean", text.user_id(F.col("raw")))
    known = members.select(F.col(member_key).alias("clean")).where(F.col("clean").isNotNull()).distinct()
    joined = counts.join(known.withColumn("_hit", F.lit(True)), "clean", "left")
    status = F.when(F.col("raw").isNull(), "missing").when(F.col("clean").isNull(), "invalid").otherwise("normalized")
    match = F.when(F.col("clean").isNotNull(), F.col("_hit").isNotNull())
    return joined.select(status.alias("normalization_status"), match.alias("identity_match"), "n").groupBy(
        "normalization_status", "identity_match").agg(F.sum("n").alias("rows")).select(
        F.lit(dataset).alias("dataset"), "normalization_status", "identity_match", "rows")


def reconciliation(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Raw against clean row counts per table."""
    def one(name: str, raw: DataFrame, clean: DataFrame) -> DataFrame:
        sizes = raw.agg(F.count("*").alias("raw_rows"), F.lit(0).cast("bigint").alias("cleaned_rows")).unionByName(
            clean.agg(F.lit(0).cast("bigint").alias("raw_rows"), F.count("*").alias("cleaned_rows")))
        both = sizes.agg(F.sum("raw_rows").alias("raw_rows"), F.sum("cleaned_rows").alias("cleaned_rows"))
        return both.select(F.lit(name).alias("dataset"), "*")

    df = reduce(DataFrame.unionByName, [one(n, r, c) for n, (r, c) in pairs.items()])
    gone = F.col("raw_rows") - F.col("cleaned_rows")
    return df.select(
        "dataset", "raw_rows", gone.alias("exact_duplicates_removed"), "cleaned_rows",
        percent(F.col("cleaned_rows"), F.col("raw_rows")).alias("rows_retained_percent"),
        percent(gone, F.col("raw_rows")).alias("rows_removed_percent"))


def cleaning_summary(parsed: DataFrame, dataset: str, fields: list[str], medians: list[str]) -> DataFrame:
    """NULL counts of parsed fields and the medians used, long form."""
    from .robust import medians as exact

    nulls = parsed.agg(*[F.count_if(F.col(f).isNull()).cast("double").alias(f) for f in fields]).unpivot(
        [], fields, "field", "value").select(F.lit("unusable").alias("measure"), "field", "value")
    middle = exact(parsed, medians).select(
        F.lit("median").alias("measure"), F.col("metric").alias("field"),
        numbers.round_half_up(F.col("median"), 2).alias("value"))
    return nulls.unionByName(middle).select(F.lit(dataset).alias("dataset"), "*")


def row_measures(raw: DataFrame, clean: DataFrame, dataset: str) -> DataFrame:
    """Rows before and after cleaning in the form of ``cleaning_summary``."""
    counts = reconciliation({dataset: (raw, clean)}).select(
        "dataset", *[F.col(c).cast("double").alias(c) for c in ("raw_rows", "exact_duplicates_removed", "cleaned_rows")])
    return counts.unpivot(["dataset"], ["raw_rows", "exact_duplicates_removed", "cleaned_rows"], "field", "value").select(
        "dataset", F.lit("rows").alias("measure"), "field", "value")


# --- rule suites ------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A named row condition that must hold; NULL counts as a violation."""

    name: str
    holds: Column


def suite(df: DataFrame, rules: list[Rule], table: str) -> DataFrame:
    """Report of row rules from one aggregation: check, status, violations."""
    names = [f"r{i}" for i in range(len(rules))]
    counted = df.agg(*[
        F.count_if(~F.coalesce(r.holds, F.lit(False))).alias(n) for n, r in zip(names, rules)
    ]).unpivot([], names, "r", "violations")
    label = reduce(lambda acc, nr: F.when(F.col("r") == nr[0], nr[1].name).otherwise(acc), zip(names, rules), F.lit(None))
    return counted.select(F.lit(table).alias("table_name"), label.alias("check_name"), "violations")


def counted(name: str, table: str, violations: DataFrame) -> DataFrame:
    """A check whose violations are the rows of a frame."""
    return violations.agg(F.count("*").alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(name).alias("check_name"), "violations")


def report(parts: list[DataFrame]) -> DataFrame:
    """PASS / FAIL per check."""
    df = reduce(DataFrame.unionByName, parts)
    return df.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def totals(checks: DataFrame) -> DataFrame:
    return checks.groupBy("table_name").agg(
        F.count("*").alias("checks"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def missing_members(df: DataFrame, key: str, members: DataFrame, member_key: str) -> DataFrame:
    """Keys with no row in ``members`` (referential subset test)."""
    known = members.select(F.col(member_key).alias(key)).distinct()
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")


def repeated_hashed_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of :func:`repeated_keys` where few keys repeat: hashes are dealt, and only keys whose hash repeats are compared."""
    hashed = df.select(*keys).withColumn("_h", F.xxhash64(*keys))
    again = broadcast_if_small(hashed.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select("_h"))
    return repeated_keys(hashed.join(again, "_h", "left_semi"), *keys)


def member_checks(members: DataFrame, key: str, unique: str, table: str, df: DataFrame, ends: dict[str, str], df_table: str) -> DataFrame:
    """Report of one aggregation over all ids: keys that repeat in ``members`` (the check ``unique``), and for every
    column of ``ends`` (by the name of its check) its values that are no key."""
    hit = [F.col(f"_{i}") for i in range(len(ends))]
    marks = lambda at: [F.lit(i == at).alias(f"_{i}") for i in range(len(ends))]
    own = members.select(F.col(key).alias("_k"), F.lit(1).alias("_n"), *marks(None))
    asked = df.select(F.explode(F.array(*[F.struct(F.col(c).alias("_k"), F.lit(0).alias("_n"), *marks(i)) for i, c in enumerate(ends.values())])).alias("_e"))
    ids = own.unionByName(asked.select("_e.*")).groupBy("_k").agg(F.sum("_n").alias("_n"), *[F.max(h).alias(f"_{i}") for i, h in enumerate(hit)])
    missing = F.col("_k").isNotNull() & (F.col("_n") == 0)
    found = {unique: (table, F.count_if(F.col("_n") > 1)), **{name: (df_table, F.count_if(missing & h)) for name, h in zip(ends, hit)}}
    counts = ids.agg(F.array(*[
        F.struct(F.lit(t).alias("table_name"), F.lit(name).alias("check_name"), n.alias("violations")) for name, (t, n) in found.items()]).alias("_r"))
    return counts.select(F.inline("_r"))


def not_a_number(df: DataFrame, columns: list[str]) -> list[Rule]:
    """Rules that columns hold neither NULL, NaN nor infinities."""
    inf = float("inf")
    return [
        Rule(f"{c} is a finite number",
             F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < inf))
        for c in columns
    ]


def schema_report(df: DataFrame, expected: list[str], table: str) -> DataFrame:
    """Missing, unexpected and misplaced columns plus the row count."""
    have = df.columns
    facts = [
        ("missing columns", ", ".join(c for c in expected if c not in have)),
        ("unexpected columns", ", ".join(c for c in have if c not in expected)),
        ("column order", "" if [c for c in have if c in expected] == [c for c in expected if c in have] else "differs"),
    ]
    rows = [(table, name, "PASS" if not detail else "FAIL", detail) for name, detail in facts]
    fixed = df.sparkSession.createDataFrame(rows, "table_name string, check_name string, status string, details string")
    count = df.agg(F.count("*").alias("n")).select(
        F.lit(table).alias("table_name"), F.lit("row count").alias("check_name"),
        F.when(F.col("n") > 0, "PASS").otherwise("FAIL").alias("status"), F.col("n").cast("string").alias("details"))
    return fixed.unionByName(count)
