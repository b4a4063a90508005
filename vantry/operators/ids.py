"""Row ids: hashes of a key, or running numbers over a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import TableStore


def hash_id(prefix: str, *cols: Column | str) -> Column:
    """Stable id from the key itself; no order and no shuffle needed."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 16))


def running_number(df: DataFrame, order: list[str], store: TableStore, name: str, out: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in ``order`` without sorting all rows in one task.

    Rows are range-partitioned and written with their partition number; the
    counts of the partitions give each one its offset.
    """
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    table = store.put(name, ranged)
    counts = table.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return table.join(offsets, "_p").withColumn(out, F.col("_o") + rank + F.lit(start - 1)).drop("_p", "_o")
