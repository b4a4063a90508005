"""Join and key helpers that stay balanced when keys are missing or hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BROADCAST_ROWS = 20_000
NULL_SALTS = 512


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, written: bool = False) -> DataFrame:
    """The side written once, and broadcast if it then counts at most ``rows`` rows.

    A larger side is returned unhinted, so the optimizer picks a shuffled join for
    it. ``written`` says that the side is a stored table already.
    """
    side = df if written else cut(df)
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def spread_null_key(key: Column, *spread_by: str) -> Column:
    """A join key whose NULLs are spread over many values that match nothing.

    In an outer join all NULL keys would land in one task.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(NULL_SALTS)).cast("string")
    return F.coalesce(key.cast("string"), F.concat(F.lit("\u0000"), salt))


def mark_join(df: DataFrame, key: str, members: DataFrame, member_key: str, flag: str, spread_by: str) -> DataFrame:
    """Add a boolean column telling whether ``key`` occurs in ``members``."""
    known = (
        members.select(F.col(member_key).cast("string").alias("_member"))
        .where(F.col("_member").isNotNull())
        .distinct()
    )
    return (
        df.withColumn("_probe", spread_null_key(F.col(key), spread_by))
        .join(known, F.col("_probe") == F.col("_member"), "left")
        .withColumn(flag, F.col("_member").isNotNull())
        .drop("_probe", "_member")
    )


def unmatched(df: DataFrame, key: str, members: DataFrame, member_key: str) -> DataFrame:
    """Rows with a usable key that has no partner (NULL keys are left out)."""
    known = members.select(F.col(member_key).alias(key)).where(F.col(key).isNotNull()).distinct()
    return df.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def coverage(df: DataFrame, key: Column, members: DataFrame, member_key: Column, name: str) -> DataFrame:
    """One row: usable keys, matched, unmatched and percent matched.

    Keys are counted before the join, so the join sees each key once.
    """
    keys = df.select(key.alias("_k")).where(F.col("_k").isNotNull()).groupBy("_k").agg(F.count("*").alias("_n"))
    known = members.select(member_key.alias("_m")).where(F.col("_m").isNotNull()).distinct()
    hit = F.when(F.col("_m").isNotNull(), F.col("_n")).otherwise(0)
    return (
        keys.join(known, F.col("_k") == F.col("_m"), "left")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("usable"), F.coalesce(F.sum(hit), F.lit(0)).alias("matched"))
        .select(
            F.lit(name).alias("join_name"),
            "usable",
            "matched",
            (F.col("usable") - F.col("matched")).alias("unmatched"),
            F.when(F.col("usable") > 0, F.col("matched") * 100.0 / F.col("usable")).otherwise(0.0).alias("pct_raw"),
        )
    )


def with_distinct_counts(counts: DataFrame, rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Add the number of distinct values of each column per key.

    Every column is counted over its own distinct pairs. Several exact distinct
    counts in one aggregation would copy each row once per column first.
    """
    for name, column in columns.items():
        pairs = rows.where(F.col(column).isNotNull()).select(key, column).distinct()
        counts = counts.join(pairs.groupBy(key).agg(F.count("*").alias(name)), key, "left").fillna(0, [name])
    return counts


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Put one-row frames side by side (a union folded to one row, no join)."""
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def top_per_group(df: DataFrame, groups: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group. The rank filter is also applied before the
    shuffle, so at most ``n`` rows per group and input task move."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
