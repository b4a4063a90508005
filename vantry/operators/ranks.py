"""Row numbers over a total order, also within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def numbered(df: DataFrame, order: list, out: str, group: list[str] | None = None) -> DataFrame:
    """All rows with their place (long, from 1) in ``order`` within ``group``.

    Rows are range-partitioned on group and order, written, and numbered inside
    each partition; the counts that a partition holds of its first and last group
    tell how many rows of a group stand in partitions before. No task holds more than one range, even where one group
    or one value of ``order`` but its last column holds most rows: end ``order`` with a
    column that parts ties. Null groups are groups; an empty table gives an empty result.
    """
    group = list(group or [])
    ranged = written(df.repartitionByRange(*[F.col(g) for g in group], *[F.col(c) if isinstance(c, str) else c for c in order]).withColumn("_p", F.spark_partition_id()))
    whole = F.struct(F.lit(0).alias("_0"), *group)
    ends = ranged.groupBy("_p").agg(F.min(whole).alias("_first"), F.max(whole).alias("_last"))
    held = (
        ranged.join(F.broadcast(ends), "_p").where((whole == F.col("_first")) | (whole == F.col("_last")))
        .groupBy("_p", whole.alias("_g")).agg(F.count("*").alias("_n"))
    )  # at most two rows a partition
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(F.col("_p").alias("_q"), "_g", F.sum("_n").over(before).alias("_o")).where(F.col("_o") > 0)
    inside = F.row_number().over(Window.partitionBy("_p", *group).orderBy(*order)).cast("long")
    placed = ranged.withColumn("_i", inside)
    met = placed.join(F.broadcast(offsets), (F.col("_p") == F.col("_q")) & (whole == F.col("_g")), "left")
    return met.select(*df.columns, (F.coalesce(F.col("_o"), F.lit(0)) + F.col("_i")).alias(out))
