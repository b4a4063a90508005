"""Mixing sources to target weights: hash-threshold histograms, no sort of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from ..operators.ranks import numbered
from .common import cut, words

BITS = 12  # hash bits of one histogram level
LEVELS = 3  # nested levels; 36 bits in all
WEIGHTS = [3.0, 1.0, 2.0]  # by the source's place in code-point order, repeating
SHARE = 1.5
MOST = 2.0
BROADCAST_SOURCES = 20_000  # rows of the per-source table that may be broadcast, counted first


def targets(sizes: DataFrame, weights: list[float] | None = None, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target of each source from rows (source, source_size), one row per source.

    Sources in code-point order, null last, get the weights in turn and divide
    ``share`` of all words; no target exceeds ``most`` times its source, and what is
    over is shared again by weight until none is above. The end of those rounds is a
    water level: with sources ordered by cap over weight, the first k are capped for
    the smallest k whose level lies below the next cap. The windows run over one row
    per source.
    """
    weights = WEIGHTS if weights is None else weights
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((F.row_number().over(place) - 1) % len(weights)) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weigh.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ranked = rows.withColumn("level", level)
    # the first source under its cap has the highest level of those under theirs; it holds for all after it
    open_level = F.max(F.when(F.col("level") < F.col("cap") / F.col("w"), F.col("level"))).over(every)
    free = F.coalesce(F.col("cap") / F.col("w") > open_level, F.lit(False))
    return ranked.select("source", "source_size", F.when(free, open_level * F.col("w")).otherwise(F.col("cap")).alias("target"))


def _place(hashed: Column, level: int) -> Column:
    """Bits of one level, the highest first; hashes have 60 bits."""
    return F.shiftright(hashed, 60 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def mix(
    docs: DataFrame, weights: list[float] | None = None, share: float = SHARE, most: float = MOST,
    text: str = "text", key: str = "doc_id", source: str = "source", text_md5: str | None = None,
) -> DataFrame:
    """How many whole copies of each document the mix takes.

    A source with target t times its size takes floor(t) copies of all its documents
    and one more of those whose hash lies under a threshold. The threshold comes from
    nested histograms: words summed by source and the highest hash bits, the bucket
    in which the budget ends refined by the next bits, and so on. Documents are
    never sorted; a histogram has 4,096 buckets a source whatever its size, and is
    combined map-side, so a hot source costs no more than others. The words taken
    miss the target by at most half a bucket of the last level, in practice by half
    a document.

    Returns (key, source, size, source_size, target, copies, taken), and the digest of the
    text in a column ``text_md5`` if that is named. Null and empty
    texts have size zero; sources that hold no words have target zero and give no
    copies; null is a source of its own; a key that is null or stands in several rows is hashed with the
    digest of the text and the row's number among equal ones, so that such rows do not
    share one fate; an empty table gives an empty result.
    """
    rows = hashed_rows(docs.select(
        F.col(key).alias("_key"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_md5")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = cut(targets(sizes, weights, share, most).select(
        "*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    ))
    budget = F.col("target") - F.col("whole") * F.col("source_size")
    small = goal.count() <= BROADCAST_SOURCES
    edge = goal.where(F.col("source_size") > 0).select(F.col("source").alias("_s"), budget.alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        inside = rows.join(F.broadcast(edge) if small else edge, F.col("source").eqNullSafe(F.col("_s")))
        if level:
            inside = inside.where(F.shiftright("h", 60 - BITS * level) == F.col("prefix"))
        bars = inside.groupBy("_s", "prefix", "left", _place(F.col("h"), level).alias("b")).agg(F.sum("size").alias("n"))
        spent = bars.withColumn("upto", F.sum("n").over(Window.partitionBy("_s").orderBy("b")))
        # the first bucket that no longer fits as a whole
        edges = spent.where(F.col("upto") > F.col("left")).groupBy("_s", "prefix", "left").agg(F.min(F.struct("b", "upto", "n")).alias("e"))
        used = F.col("e.upto") - F.col("e.n")
        place = F.col("prefix") * (1 << BITS) + F.col("e.b")
        if level == LEVELS - 1:  # the last boundary bucket is taken when that ends nearer to the target
            place = place + (F.col("e.upto") - F.col("left") < F.col("left") - used).cast("long")
        edge = cut(edges.select("_s", (F.col("left") - used).alias("left"), place.alias("prefix")))
    bound = goal.join(edge.select("_s", "prefix"), F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_s2"), "source_size", "target", "whole", "prefix")
    joined = rows.join(F.broadcast(bound) if small else bound, F.col("source").eqNullSafe(F.col("_s2")))
    more = F.coalesce(F.shiftright("h", 60 - BITS * LEVELS) < F.col("prefix"), F.lit(False)).cast("long")
    copies = F.when(F.col("whole") >= F.lit(most), F.col("whole")).otherwise(F.col("whole") + more)
    return joined.select(
        F.col("_key").alias(key), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
        *([F.col("_md5").alias(text_md5)] if text_md5 else []))


def hashed_rows(rows: DataFrame) -> DataFrame:
    """Rows (_key, source, size, _md5) with ``h``, 60 bits that part any two rows.

    Only rows of repeated and null keys are numbered, by range partitions, so a key that holds a
    third of all rows is spread.
    """
    rows = cut(rows)
    repeated = rows.groupBy("_key").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("_key").isNull())
    repeated = broadcast_if_small(repeated.select(F.col("_key").alias("_r"), F.lit(True).alias("_many")))
    marked = rows.join(repeated, F.col("_key").eqNullSafe(F.col("_r")), "left").drop("_r")
    many = marked.where("_many").withColumn("_row", F.monotonically_increasing_id())
    many = numbered(many, ["source", "size", "_row"], "_n", group=["_key", "_md5"])
    place = lambda c: F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long").alias("h")
    columns = ["_key", "source", "size", "_md5"]
    alone = marked.where(F.col("_many").isNull()).select(*columns, place(F.col("_key").cast("string")))
    return cut(alone.union(many.select(*columns, place(F.concat_ws("|", F.col("_key").cast("string"), "_md5", F.col("_n").cast("string"))))))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
    ('0x' || substr(md5(CASE WHEN doc_id IS NULL OR count(*) OVER (PARTITION BY doc_id) > 1 THEN concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')),
        (row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, '')) ORDER BY source NULLS FIRST))::VARCHAR)
      ELSE doc_id::VARCHAR END), 1, 15))::BIGINT >> 24 AS b
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w,
    source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (
      ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
o AS (SELECT *, max(CASE WHEN level < cap / w THEN level END) OVER () AS open FROM l),
g AS (
  SELECT source, source_size, CASE WHEN coalesce(cap / w > open, false) THEN open * w ELSE cap END AS target FROM o),
t AS (
  SELECT d.*, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS whole
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (
  SELECT *, target - whole * source_size AS budget,
    sum(size) OVER (PARTITION BY source ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY source, b) AS n FROM t),
f AS (
  SELECT *, CASE WHEN whole >= 2 OR source_size = 0 THEN 0 WHEN upto <= budget THEN 1
    WHEN upto - n <= budget AND n > 0 AND upto - budget < budget - (upto - n) THEN 1 ELSE 0 END AS more FROM c)
SELECT doc_id, source, size, source_size, target, (whole + more)::BIGINT AS copies, ((whole + more) * size)::BIGINT AS taken FROM f
"""
