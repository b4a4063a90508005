"""Exact medians and median absolute deviations, per group or over all rows.

Selection by brackets: mergeable sketches of all metrics (combined map-side) name two
values that lie around the middle ranks; a second pass counts what lies below and at them and
keeps only the values between, a share fixed by the sketch's accuracy. Values repeated often
become ends of a bracket and are counted, not kept. Counts prove that the middle is inside; a bracket that
misses it is widened. Two aggregations of one row per group serve every size, without rows per
metric, sorting or range partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .joins import broadcast_if_small

ACCURACY = 10_000  # ranks of a sketch are right to one part in so many
BETWEEN = 500_000  # values between the ends of one bracket, about; larger groups get finer sketches
REACH = 2  # sketch errors between the middle and each end of the first bracket


def _same(groups: list[str], other: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"{other}{g}")) for g in groups])


def _brackets(data: DataFrame, metrics: list[str], groups: list[str], accuracy: int, reach: int) -> DataFrame:
    """Per group: rows of the largest metric, and for each metric an array (low, high)."""
    off = min(0.5, reach / accuracy)
    ends = [F.percentile_approx(m, [0.5 - off, 0.5 + off], accuracy).alias(f"_b_{m}") for m in metrics]
    return data.groupBy(*groups).agg(F.greatest(*[F.count(m) for m in metrics], F.lit(0)).alias("_most"), *ends)


def _picked(metric: str, low: Column, high: Column) -> Column:
    """(n, inside, median) of one metric, given the ends of its bracket."""
    v = F.col(metric)
    counted = F.struct(
        F.count(v).alias("n"), F.count_if(v < low).alias("below"), F.count_if(v == low).alias("at"), F.first(low).alias("low"), F.first(high).alias("high"),
        F.sort_array(F.collect_list(F.when((v > low) & (v < high), v))).alias("between"), F.count_if((v == high) & (high > low)).alias("end"))
    return counted.alias(metric)


def _median(c: Column) -> Column:
    """NULL without values; the outer NULL of a rank outside the bracket is told by ``_inside``."""

    def pick(rank: Column) -> Column:
        at = rank - c["below"]
        return (
            F.when(at <= c["at"], c["low"])
            .when(at <= c["at"] + F.size(c["between"]), F.try_element_at(c["between"], (at - c["at"]).cast("int")))
            .otherwise(c["high"]))

    low, high = F.floor((c["n"] + 1) / 2), F.floor(c["n"] / 2) + 1
    return F.when(c["n"] > 0, pick(low) * 0.5 + pick(high) * 0.5)


def _inside(c: Column) -> Column:
    low, high = F.floor((c["n"] + 1) / 2), F.floor(c["n"] / 2) + 1
    return (c["n"] == 0) | ((low > c["below"]) & (high <= c["below"] + c["at"] + F.size(c["between"]) + c["end"]))


def wide_medians(df: DataFrame, metrics: list[str], groups: list[str], suffix: str = "_median", accuracy: int = ACCURACY) -> DataFrame:
    """Exact medians, one row per group, columns ``<metric><suffix>``; NULL where a group has no value. Groups may be NULL."""
    data = df.select(*groups, *[F.col(m).cast("double").alias(m) for m in metrics])
    reach = REACH
    while True:
        ends = _brackets(data, metrics, groups, accuracy, reach)
        if groups:
            ends = ends.select(*[F.col(g).alias(f"_g_{g}") for g in groups], "_most", *[f"_b_{m}" for m in metrics])
            side = broadcast_if_small(ends)
            most = side.agg(F.max("_most")).first()[0]
            met = data.join(side, _same(groups, "_g_"))
            edge = {m: (F.col(f"_b_{m}")[0], F.col(f"_b_{m}")[1]) for m in metrics}
        else:
            row = ends.first()
            most, met = row["_most"], data
            edge = {m: tuple(F.lit(x).cast("double") for x in (row[f"_b_{m}"] or (None, None))) for m in metrics}
        fine = -(-(most or 0) * 2 * (reach + 1) // BETWEEN)
        if fine > accuracy:
            accuracy = fine
            continue
        counted = met.groupBy(*groups).agg(*[_picked(m, *edge[m]) for m in metrics])
        every = reduce(lambda x, y: x & y, [_inside(F.col(m)) for m in metrics])
        found = cut(counted.select(*groups, *[_median(F.col(m)).alias(m + suffix) for m in metrics], every.alias("_inside")))
        if not found.where(~F.col("_inside")).limit(1).count():
            return found.drop("_inside")
        reach *= 16  # a sketch was less exact than promised


def medians(df: DataFrame, metrics: list[str], groups: list[str] | None = None) -> DataFrame:
    """Exact median per metric in long form: groups, metric, n, median."""
    groups = groups or []
    counts = df.groupBy(*groups).agg(*[F.count(m).alias(m) for m in metrics]).unpivot(groups, metrics, "metric", "n")
    middle = wide_medians(df, metrics, groups, "").unpivot(groups, metrics, "metric", "median")
    return counts.join(middle, [*groups, "metric"]).select(*groups, "metric", "n", "median")


def robust_stats(df: DataFrame, metrics: list[str], groups: list[str] | None = None) -> DataFrame:
    """Median and MAD per metric, one row per group: ``<m>_median``, ``<m>_mad``.

    Groups must not be NULL; fill them with a label first.
    """
    groups = groups or []
    centre = wide_medians(df, metrics, groups, "_median")
    if groups:
        joined = df.select(*groups, *metrics).join(broadcast_if_small(centre, written=True), groups)
    else:
        first = centre.first()
        joined = df.select(*metrics).withColumns({f"{m}_median": F.lit(first[f"{m}_median"]) for m in metrics})
    spread = joined.select(*groups, *[F.abs(F.col(m) - F.col(f"{m}_median")).alias(m) for m in metrics])
    mad = wide_medians(spread, metrics, groups, "_mad")
    if groups:
        return centre.join(mad, groups)
    return mad.select(*[F.lit(first[f"{m}_median"]).alias(f"{m}_median") for m in metrics], *[f"{m}_mad" for m in metrics])


def global_medians(df: DataFrame, metrics: list[str]) -> dict[str, float | None]:
    """Median of each column over the whole table as plain numbers."""
    return wide_medians(df, metrics, [], "").first().asDict()


def global_stats(df: DataFrame, metrics: list[str]) -> dict[str, tuple[float, float]]:
    """(median, MAD) of each column over the whole table as plain numbers."""
    row = robust_stats(df, metrics).first()
    return {m: (row[f"{m}_median"], row[f"{m}_mad"]) for m in metrics}


def require(values: dict[str, float | None]) -> dict[str, float]:
    """Fail when a median needed for imputation is undefined."""
    missing = sorted(name for name, value in values.items() if value is None)
    if missing:
        raise ValueError(f"no valid values to take a median of: {', '.join(missing)}")
    return values


def percentile_rank(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Percent rank within a group with average ranks for ties (0..100].

    Ranks come from counts per (group, value), so a group with a third of all
    rows is never sorted as a whole.
    """
    freq = df.groupBy(group, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(group).orderBy(value)
    below = F.coalesce(F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = freq.select(
        F.col(group).alias("_g"),
        F.col(value).alias("_v"),
        ((below + (F.col("_c") + 1) / 2) / F.sum("_c").over(Window.partitionBy(group)) * 100.0).alias(out),
    )
    match = (F.col(group) == F.col("_g")) & (F.col(value) == F.col("_v"))
    return df.join(broadcast_if_small(ranks), match, "left").drop("_g", "_v")


