"""Sharding along a Hilbert curve over metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import numbered

BITS = 5  # cells of each dimension: 32


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of rows of whole coordinates below ``2 ** bits``, any number of dimensions.

    Gray-code construction: from the highest bit down, undo the exchanges and
    reversals that the curve makes in each sub-cube, then read the bits in turn.
    """
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit = np.int64(1) << level
        low = bit - 1
        for d in range(n):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else x[0]
    for d in range(1, n):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (np.int64(1) << level), (np.int64(1) << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            out = (out << 1) | ((x[d] >> level) & 1)
    return out


def _cells(df: DataFrame, column: str, weight: str) -> DataFrame:
    """(column, cell): values in code-point order, null last, cut into 32 runs of near-equal rows.

    A value is never cut, so a cell is a range of values. Input has one row per value.
    """
    order = Window.orderBy(F.col(column).isNull(), F.col(column))
    before = F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = before + F.col(weight) / 2
    share = middle / F.sum(weight).over(Window.partitionBy())
    return df.select(column, F.least(F.floor(share * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("int").alias("cell"))


def shard(
    docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", categories: tuple[str, ...] = ("source", "lang"),
    carry: bool = False,
) -> DataFrame:
    """Shards of equal row counts (at most one apart) that are runs of a Hilbert curve.

    Dimensions are the categories (cut into 32 ranges of near-equal rows) and the
    size (log2 of the bytes). Rows are ordered by curve index, then checksum of the
    text, then a hash of the key, so equal texts of one curve cell lie side by
    side; runs of the order are the shards, and min/max of every dimension prunes
    them. Places come from range partitions and the counts before them, so a hot
    source, a hot text or a row repeated very often is spread over many tasks.

    Returns (key, size, text_crc32, curve, shard, slot, rows), with ``carry`` the whole
    document as ``_row`` too. Null texts count as empty, null categories come last,
    repeated rows all get a place of their own, an empty table gives an empty
    result, other columns are left out.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = [F.struct("*").alias("_row")] if carry else []
    rows = docs.select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(categories)],
        (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("crc"), *kept)
    cells = [F.least(F.floor(F.log2("size")), F.lit((1 << BITS) - 1)).cast("int")]
    for i in range(len(categories)):
        name = f"_c{i}"
        values = rows.groupBy(name).agg(F.count("*").alias("_n"))
        cut = _cells(values, name, "_n").select(F.col(name).alias(f"_v{i}"), F.col("cell").alias(f"_d{i}"))
        rows = rows.join(cut, F.col(name).eqNullSafe(F.col(f"_v{i}"))).drop(name, f"_v{i}")
        cells.append(F.col(f"_d{i}"))

    @F.pandas_udf("int")
    def curve(*dims: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.column_stack([d.to_numpy() for d in dims]), BITS).astype(np.int32))

    placed = rows.select(
        "_key", "size", "crc", curve(*cells).alias("curve"), F.xxhash64("_key").alias("_h"), F.monotonically_increasing_id().alias("_m"), *(["_row"] if carry else []))
    ranked = numbered(placed, ["curve", "crc", "_h", "_key", "_m"], "_at")
    total = max(1, ranked.count())
    # whole-number division keeps the runs exact
    run = F.expr(f"(_at - 1) * {shards} div {total}")
    first = F.expr(f"((_at - 1) * {shards} div {total} * {total} + {shards} - 1) div {shards}")
    return ranked.select(
        F.col("_key").alias(key), "size", F.col("crc").alias("text_crc32"), "curve",
        run.cast("int").alias("shard"), (F.col("_at") - 1 - first).cast("long").alias("slot"), F.lit(total).cast("long").alias("rows"), *(["_row"] if carry else []))


PLACES = ("size", "curve", "shard", "slot")


def write(
    docs: DataFrame, folder: str, shards: int = 16, key: str = "doc_id", text: str = "text", categories: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """Write all documents by shard, and the bounds of every shard; returns the bounds.

    ``folder/rows`` has one folder a shard, whose files are runs of the curve, so
    that Parquet's own bounds prune within it as well. ``folder/bounds`` has one
    row a shard: rows, bytes, and the least and largest value of size, curve and each
    category (nulls left out; ``nulls_`` counts them). Columns of documents stay, those named like PLACES are replaced.
    """
    placed = shard(docs, shards, key, text, categories, carry=True)
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in PLACES]
    placed.select(*own, *PLACES).write.partitionBy("shard").parquet(f"{folder}/rows")
    dims = ["size", "curve", *[c for c in categories if c not in PLACES]]
    names = {d: F.col(d) if d in PLACES else F.col("_row")[d] for d in dims}
    bounds = placed.groupBy("shard").agg(
        F.count("*").alias("rows"), F.sum(F.col("size") - 1).alias("bytes"),
        *[f(names[d]).alias(f"{n}_{d}") for d in dims for n, f in (("least", F.min), ("most", F.max))],
        *[F.count_if(names[d].isNull()).alias(f"nulls_{d}") for d in dims])
    bounds.coalesce(1).write.parquet(f"{folder}/bounds")
    return docs.sparkSession.read.parquet(f"{folder}/bounds")


def read_range(spark: SparkSession, folder: str, **ranges: tuple) -> DataFrame:
    """Rows whose named dimensions lie within (low, high), read from those shards only whose bounds meet all ranges.

    Nulls lie in no range. Where no shard meets them the result is empty.
    """
    bounds = spark.read.parquet(f"{folder}/bounds")
    for d, (low, high) in ranges.items():
        bounds = bounds.where((F.col(f"least_{d}") <= F.lit(high)) & (F.col(f"most_{d}") >= F.lit(low)))
    met = [r.shard for r in bounds.select("shard").orderBy("shard").collect()]  # at most one row a shard
    rows = spark.read.option("basePath", f"{folder}/rows")
    rows = rows.parquet(*[f"{folder}/rows/shard={k}" for k in met]) if met else rows.parquet(f"{folder}/rows").where("false")
    for d, (low, high) in ranges.items():
        rows = rows.where(F.col(d).between(F.lit(low), F.lit(high)))
    return rows
