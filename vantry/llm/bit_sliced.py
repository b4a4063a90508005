"""Target-distribution importance resampling by bit-sliced sums.

A document's bucket counts are held as bit planes of one bit a bucket, and so are the
gains of the buckets, by sign. The sum of count times gain is the popcount of each
count plane ANDed with each gain plane, times a power of two: whole numbers, no rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import numbered
from .common import by_bytes, cut, word_bytes

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
SHARE = 25  # percent of the documents long enough that are drawn
BATCH = 4_000_000  # bytes of text counted together, about


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every word and of every two neighbouring words joined by a space."""
    words = word_bytes(text)
    single = list(map(crc32, words))
    # the checksum of "a b" goes on from that of "a"
    double = list(map(crc32, [b" " + w for w in words[1:]], single))
    return np.array(single + double, np.int64) % buckets


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of whole numbers from zero on: row j holds bit j of every number, 64 to a word."""
    depth = int(values.max(initial=0)).bit_length()
    bits = (values[None, :] >> np.arange(depth)[:, None] & 1).astype(np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


class Gains:
    """Bit planes of signed gains, and exact sums over bucket counts."""

    def __init__(self, gains: np.ndarray):
        self.above, self.below = planes(np.maximum(gains, 0)), planes(np.maximum(-gains, 0))

    def total(self, counts: np.ndarray) -> int:
        mine = planes(counts)
        return self._sum(mine, self.above) - self._sum(mine, self.below)

    @staticmethod
    def _sum(a: np.ndarray, b: np.ndarray) -> int:
        if not len(a) or not len(b):
            return 0
        ones = np.bitwise_count(a[:, None, :] & b[None, :, :]).sum(axis=2, dtype=np.int64)
        return sum(int(n) << (i + j) for (i, j), n in np.ndenumerate(ones))


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n) with the features of all texts; each task sends one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                held += np.bincount(features(value.as_py(), buckets), minlength=buckets)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], names=["bucket", "n"])

    counted = texts.select(text).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, gain), one for each bucket: floor(1000 ln) of the smoothed ratio of target to documents."""
    spark = docs.sparkSession
    source = bucket_counts(docs, text, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    wanted = bucket_counts(target, text, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    every = spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    both = cut(every.union(source).union(wanted).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    size, target_size = both.agg(F.sum("s"), F.sum("t")).first()
    real = lambda c, more: F.col(c).cast("double") + F.lit(float(more))
    ratio = real("t", 1) * F.lit(float(size + buckets)) / (real("s", 1) * F.lit(float(target_size + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id",
    share: int = SHARE, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Rows (key, n_features, weight, score, rank), one per document.

    ``weight`` is the floored mean gain of the document's features (0 without
    features), ``score`` adds Gumbel noise from a hash of the key, so that the highest
    scores are a draw without replacement in proportion to exp(weight / 1000).
    Of the N documents with ``least_words`` words, floor(share * N / 100) are
    drawn; ``rank`` is their place by score, then key, null for the others.

    Two passes over the texts, neither shuffles them: the first sends at most one row per
    bucket and task, the second broadcasts ``buckets`` gains, a fixed number. Ranks come from a range partition of
    short rows, so no task orders all of them. Null and empty texts have no
    features; a null key is hashed as the empty string and comes last among ties; repeated rows
    are ranked one by one; an empty table gives an empty result, an empty target counts as zero everywhere.
    """
    spark = docs.sparkSession
    table = np.zeros(buckets, np.int64)
    for row in gains(docs, target, text, buckets).collect():  # one row a bucket
        table[row.bucket] = row.gain
    sliced = spark.sparkContext.broadcast(Gains(table))
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = sliced.value
        for whole in batches:
            for batch in by_bytes(whole, "_text", BATCH):
                sizes, weights = [], []
                for value in batch.column("_text"):
                    found = features(value.as_py(), buckets)
                    sizes.append(len(found))
                    weights.append(use.total(np.bincount(found, minlength=buckets)) // len(found) if len(found) else 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key"), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], names=["_key", "n_features", "weight"])

    schema = T.StructType([T.StructField("_key", kind), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    weighed = cut(rows.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + noise))
    long_enough = F.col("n_features") >= 2 * least_words - 1  # n words are 2 n - 1 features
    drawn = weighed.where(long_enough).count() * share // 100
    placed = numbered(
        weighed.withColumn("_short", ~long_enough).withColumn("_row", F.monotonically_increasing_id()),
        ["_short", F.col("score").desc(), F.col("_key").asc_nulls_last(), "n_features", "weight", "_row"], "_place")
    return placed.select(
        F.col("_key").alias(key), "n_features", "weight", "score",
        F.when(~F.col("_short") & (F.col("_place") <= drawn), F.col("_place")).alias("rank"))
