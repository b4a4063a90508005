"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): for each node of an edge the smallest node it can reach.

    ``edges`` has two long columns; order, loops and repeats do not matter. Each
    step is a grouped minimum (combined map-side) and a join on the node, which
    adaptive execution splits where one node has very many edges. Steps end when
    every node points at a node that points nowhere; the number of steps grows with
    the logarithm of the longest chain. No edge list reaches the driver, only a
    count and a checksum.
    """
    a, b = edges.columns
    now = cut(
        edges.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    sign = _sign(now)
    while sign[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        best = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(best, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.union(best.select("u", F.col("m").alias("v"))).distinct())
        sign_after = _sign(after)
        now, done, sign = after, sign == sign_after, sign_after
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _sign(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
