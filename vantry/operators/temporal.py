"""Anchored event windows, sequences and bursts.

A window starts at an anchor event and takes every event up to ``width`` later;
the next event after it is the next anchor. The chain of anchors depends on
event order, so a naive plan sorts all events of an entity in one task. Here:

1. Events become *ticks*, the distinct (entity, time) pairs (map-side combine).
2. Ticks are range-partitioned by entity and time, sorted and written. A partition is a
   segment cut by rows: a busy entity spans as many as its ticks need.
3. Where an entity goes on from one partition to the next, its segment is reduced to a
   step function: where does a chain leave it, given where it enters. Functions compose
   associatively, so a prefix scan by doubling gives the entry of every segment in as many
   rounds as the logarithm of the segments; those that a quiet gap makes constant need none.
4. Every partition is scanned once more from its known entry.

The same path serves every size; partitions are read as streams of Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, text, times
from ..session import TableStore, cut
from .ranks import numbered

HOUR = 3_600_000_000
PAGE = 1_000  # members of a sequence in one row of its list
_START = np.iinfo(np.int64).min // 4


def ticks(events: DataFrame, entity: str, ts: str = "event_timestamp") -> DataFrame:
    """Distinct times per entity with the number of events at each."""
    return (
        events.where(F.col(entity).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(entity).alias("entity_id"), times.micros(F.col(ts)).alias("us"))
        .agg(F.count("*").alias("n"))
    )


def segments(t: DataFrame, limit: int | None = None, store: TableStore | None = None) -> DataFrame:
    """Ticks in order of entity and time, written, with the number of their partition.

    ``limit`` gives the ticks of a partition; without it the session's shuffle
    settings do. With a store the ticks are written first, so the events behind them are read once.
    """
    if store is not None:
        t = store.put(store.fresh("ticks"), t)
    order = ["entity_id", "us"]
    placed = t.repartitionByRange(max(1, -(-t.count() // limit)), *order) if limit else t.repartitionByRange(*order)
    return cut(placed.sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))


# --- step functions ------------------------------------------------------------------


def advance(until: np.ndarray, low: np.ndarray, us: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Move all chains over sorted times; chains that meet become one.

    ``until`` is the last time a chain covers and ``low`` the smallest entry
    that leads to it. ``low`` stays sorted; a chain that entered later may cover less
    as long as its next time is still to come.
    """
    while until.size and us.size and until.min() < us[-1]:
        to = np.searchsorted(us, until, side="right")
        moved = to < us.size
        until = np.where(moved, us[np.minimum(to, us.size - 1)] + width, until)
        keep = np.r_[True, until[1:] != until[:-1]]
        until, low = until[keep], low[keep]
    return until, low


class Segment:
    """Step function of one entity's times, fed in order.

    A chain entering at ``low`` or later, up to the next ``low``, leaves at ``out`` (or
    where it entered, if later). Only times in the first ``width`` can be told
    apart by a chain that comes from before, so only those open a piece; after a gap
    longer than ``width`` all chains are one.
    """

    def __init__(self, width: int, enters: bool):
        self.width, self.enters = width, enters
        self.first, self.last, self.head = None, None, []
        self.low = self.out = None if enters else np.array([_START])

    def feed(self, us: np.ndarray) -> None:
        if self.first is None:
            self.first = self.last = us[0]
        gaps = np.flatnonzero(np.diff(us, prepend=self.last) > self.width)
        self.last = us[-1]
        if gaps.size:
            self.low = self.out = np.array([_START])
            us = us[gaps[-1] :]
        if self.low is None:
            early = us < self.first + self.width
            self.head.append(us[early])
            if early.all():
                return
            self._open()
            us = us[~early]
        self.out, self.low = advance(self.out, self.low, us, self.width)

    def _open(self) -> None:
        entries = np.concatenate([np.array([_START]), *self.head])
        self.out, self.low = advance(entries, entries, entries[1:], self.width)

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        if self.low is None:
            self._open()
        return self.low, self.out


def compose(low1: np.ndarray, out1: np.ndarray, low2: np.ndarray, out2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step function of a segment and the one after it."""
    out = np.maximum(out1, out2[np.searchsorted(low2, out1, side="right") - 1])
    if len(out1) == 1:  # constant: no chain comes later
        return low1, out
    beyond = low2 > out1[-1]  # entries after all times of the first
    low, out = np.r_[low1, low2[beyond]], np.r_[out, out2[beyond]]
    keep = np.r_[True, out[1:] != out[:-1]]
    return low[keep], out[keep]


def _functions(width: int) -> Callable:
    """Functions of the first and the last entity of a partition."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, entity, now, p = [], None, None, None
        for pdf in batches:
            if pdf.empty:
                continue
            ent, us, p = pdf["entity_id"].to_numpy(), pdf["us"].to_numpy(), int(pdf["_p"].iloc[0])
            starts = np.r_[0, np.flatnonzero(ent[1:] != ent[:-1]) + 1]
            if now is None:
                entity, now = ent[0], Segment(width, True)
            if ent[0] == entity:
                now.feed(us[: starts[1] if starts.size > 1 else None])
            if ent[-1] != entity:  # entities between the first and the last are whole
                if now.enters:
                    found.append((entity, now))
                entity, now = ent[-1], Segment(width, False)
                now.feed(us[starts[-1] :])
        if now is not None:
            found.append((entity, now))
            low, out = zip(*(f.close() for _, f in found))
            yield pd.DataFrame({"entity_id": [e for e, _ in found], "_p": p, "low": low, "out": out})

    return scan


_LONGS = T.ArrayType(T.LongType())


@F.pandas_udf(T.StructType([T.StructField("low", _LONGS), T.StructField("out", _LONGS)]))
def _then(low1: pd.Series, out1: pd.Series, low2: pd.Series, out2: pd.Series) -> pd.DataFrame:
    """The second function after the first; a missing first one, and a constant second one, change nothing."""
    rows = zip(low1, out1, low2, out2)
    return pd.DataFrame([(c, d) if a is None or len(c) == 1 else compose(a, b, c, d) for a, b, c, d in rows], columns=["low", "out"])


def _going_on(r: DataFrame) -> DataFrame:
    """Ticks of the entities that more than one partition holds, at most two a partition; the others need no function."""
    on = r.groupBy("entity_id").agg(F.min("_p").alias("first"), F.max("_p").alias("last")).where("first < last")
    return r.join(F.broadcast(on.select("entity_id")), "entity_id", "left_semi").select(*r.columns)


def entries(r: DataFrame, width: int) -> dict[int, int]:
    """For partitions that begin within an entity: the time up to which an earlier window reaches.

    Prefix scan by doubling over at most two functions a partition. The result has at most
    one number a partition.
    """
    order = Window.partitionBy("entity_id")
    f = _going_on(r).mapInPandas(_functions(width), "entity_id string, _p int, low array<long>, out array<long>")
    f = f.select("*", (F.row_number().over(order.orderBy("_p")) - 1).alias("i"), F.count("*").over(order).alias("_k")).where("_k > 1").drop("_k")
    # a chain enters the first segment of an entity from nowhere
    start = F.array(F.lit(_START).cast("long"))
    first = F.col("i") == 0
    f = cut(f.withColumns({"low": F.when(first, start).otherwise(F.col("low")), "out": F.when(first, F.slice("out", 1, 1)).otherwise(F.col("out"))}))
    step = 1
    while f.where(F.size("low") > 1).limit(1).count():
        before = f.select("entity_id", (F.col("i") + step).alias("i"), F.col("low").alias("low1"), F.col("out").alias("out1"))
        met = f.join(before, ["entity_id", "i"], "left").withColumn("_f", _then("low1", "out1", "low", "out"))
        f = cut(met.select("entity_id", "_p", "i", "_f.low", "_f.out"))
        step *= 2
    reached = F.lag(F.col("out")[0]).over(order.orderBy("i"))
    return {row["_p"]: row["entry"] for row in f.select("_p", reached.alias("entry")).where("entry is not null").collect()}


# --- anchors -------------------------------------------------------------------------


def _anchor_scan(width: int, entry: dict[int, int]) -> Callable:
    """Anchors of the entities of a partition, with the events each window holds here.

    All entities of a batch advance together; a window that goes on in the next batch or
    partition is given again with the events it holds there.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, last_until = None, _START
        for pdf in batches:
            if pdf.empty:
                continue
            ent, us, n = (pdf[c].to_numpy() for c in ("entity_id", "us", "n"))
            starts = np.r_[0, np.flatnonzero(ent[1:] != ent[:-1]) + 1]
            ends = np.r_[starts[1:], us.size]
            until = np.full(starts.size, _START)
            if last is None:
                until[0] = entry.get(int(pdf["_p"].iloc[0]), _START)
            elif ent[0] == last:
                until[0] = last_until
            # lay the entities end to end on one axis, so one search serves them all
            first = us[starts]
            spans = us[ends - 1] - first + width + 2
            base = np.r_[0, np.cumsum(spans)[:-1]]
            axis = us + np.repeat(base - first, ends - starts)
            follow = np.searchsorted(axis, axis + width, side="right")
            at = np.searchsorted(axis, np.clip(until - first, -1, spans - 2) + base, side="right")
            events = np.r_[0, np.cumsum(n)]
            rows = []
            if until[0] != _START and at[0] > 0:
                rows.append((ent[:1], until[:1] - width, events[at[:1]]))
            part_of = np.arange(starts.size)
            while True:
                live = at < ends[part_of]
                part_of, at = part_of[live], at[live]
                if not at.size:
                    break
                rows.append((ent[at], us[at], events[follow[at]] - events[at]))
                until[part_of] = us[at] + width
                at = follow[at]
            last, last_until = ent[-1], until[-1]
            if rows:
                yield pd.DataFrame({c: np.concatenate(v) for c, v in zip(("entity_id", "anchor", "n"), zip(*rows))})

    return scan


def anchors_of(r: DataFrame, width: int) -> DataFrame:
    """Window anchors of written segments (see ``segments``) with the events of each window."""
    scan = _anchor_scan(width, entries(r, width))
    found = r.mapInPandas(scan, "entity_id string, anchor long, n long")
    return found.groupBy("entity_id", "anchor").agg(F.sum("n").alias("n"))


def anchors(t: DataFrame, width: int = HOUR, limit: int | None = None, store: TableStore | None = None) -> DataFrame:
    """Window anchors (entity_id, anchor, n) of ticks; exact however many ticks an entity has."""
    return anchors_of(segments(t, limit, store), width)


def in_windows(events: DataFrame, entity: str, marks: DataFrame, width: int = HOUR) -> DataFrame:
    """Events with the anchor of the window that holds them.

    An equi-join on (entity, slot of one width): a window touches two slots and
    a slot holds at most two windows of an entity, so rows never multiply.
    """
    slot = F.floor(F.col("anchor") / F.lit(width)).cast("bigint")
    marks = marks.select("entity_id", "anchor", F.explode(F.array(slot, slot + 1)).alias("slot"))
    us = times.micros(F.col("event_timestamp"))
    placed = events.where(F.col(entity).isNotNull() & F.col("event_timestamp").isNotNull()).withColumns({
        "entity_id": F.col(entity), "us": us, "slot": F.floor(us / F.lit(width)).cast("bigint")})
    return placed.join(marks, ["entity_id", "slot"]).where(
        F.col("us").between(F.col("anchor"), F.col("anchor") + width)).drop("slot")


# --- sequences -----------------------------------------------------------------------


def sequence_confidence(quality: Column, sources: Column, n: Column) -> Column:
    """0.5 timestamp quality + 0.3 cross-source + 0.2 event share (of five)."""
    cross = F.when(sources >= 2, 1.0).otherwise(0.5)
    score = F.coalesce(quality, F.lit(0.8)) * 0.5 + cross * 0.3 + F.least(F.lit(1.0), n / F.lit(5.0)) * 0.2
    return numbers.round_half_up(numbers.clip(score, 0, 1), 4)


def sequence_strength(sources: Column, categories: Column, n: Column) -> Column:
    cross = F.when(sources >= 2, 20.0).otherwise(0.0)
    total = sources * 25.0 + categories * 20.0 + F.least(F.lit(5), n) * 15.0 + cross
    return numbers.round_half_up(numbers.clip(total, 0, 100), 2)


def _user_type() -> Column:
    return (
        F.when((F.col("n_fail") > 0) & (F.col("n_success") > 0), "FAILED_AUTH_TO_SUCCESS")
        .when(F.col("n_fail") >= 2, "FAILED_LOGIN_SERIES")
        .when((F.col("n_auth") > 0) & (F.col("n_alert") > 0), "AUTH_TO_ENDPOINT_ALERT")
        .when((F.col("n_auth") > 0) & (F.col("n_flow") > 0), "AUTH_TO_FIREWALL_DENY")
        .when(F.col("n_sources") >= 2, "CROSS_SOURCE_SESSION_CHAIN")
        .otherwise("GENERAL_ACTIVITY_SEQUENCE")
    )


def _host_type() -> Column:
    return (
        F.when(F.col("n_deny") >= 3, "FIREWALL_DENY_SPIKE")
        .when(F.col("n_alert") >= 2, "ENDPOINT_ALERT_BURST")
        .when((F.col("n_flow") > 0) & (F.col("n_alert") > 0), "FIREWALL_DENY_TO_ENDPOINT_ALERT")
        .when(F.col("n_sources") >= 2, "CROSS_SOURCE_HOST_CHAIN")
        .otherwise("HOST_ACTIVITY_SEQUENCE")
    )


PREFIX = {"USER": "SEQ-USR-", "HOST": "SEQ-HST-"}
KEY_OF = {"USER": "user_id", "HOST": "hostname"}
MEMBER_COLUMNS = ["event_id", "source_dataset", "source_record_id", "event_category", "action"]


def sequence_evidence(
    events: DataFrame, kind: str, width: int = HOUR, unknown_entity: bool = False, **chain
) -> DataFrame:
    """Events of windows with two or more events, with their step number.

    ``unknown_entity`` also treats all events without an entity as one entity.
    """
    return numbered_evidence(members(events, kind, width, unknown_entity, **chain), kind)


def members(events: DataFrame, kind: str, width: int = HOUR, unknown_entity: bool = False, **chain) -> DataFrame:
    """Events of windows with two or more events, without numbers: evidence, sequences, nodes and edges are made of them.

    A record id that equals the event id is not carried; ``own_record`` says so and :func:`member_rows` puts it back.
    """
    same = F.col("source_record_id").eqNullSafe(F.col("event_id"))
    shown = events.withColumns({"own_record": same, "source_record_id": F.when(~same, F.col("source_record_id"))})
    return window_members(shown, kind, [*MEMBER_COLUMNS, "own_record"], width, unknown_entity, **chain)


def _record() -> Column:
    return F.when(F.col("own_record"), F.col("event_id")).otherwise(F.col("source_record_id")).alias("source_record_id")


def member_rows(found: DataFrame, kind: str) -> DataFrame:
    """Members with the key of their sequence and their record id."""
    shown = [_record() if n == "source_record_id" else F.col(n) for n in MEMBER_COLUMNS]
    return found.select(*_sequence_key(kind), *shown, "us", "anchor")


def numbered_evidence(found: DataFrame, kind: str) -> DataFrame:
    """Members (see :func:`members`) with their step number."""
    placed = numbered(found, ["us", "event_id"], "step", group=["entity_id", "anchor"])
    return (
        placed.select(
            *_sequence_key(kind),
            "event_id",
            "source_dataset",
            _record(),
            times.as_text(times.from_micros(F.col("us"))).alias("event_timestamp"),
            "event_category",
            F.col("step").cast("int").alias("step"),
            "action",
            "us",
            "anchor",
        )
        .withColumn("role_in_sequence", F.concat(F.lit("step_"), F.col("step").cast("string")))
    )


def _sequence_key(kind: str) -> list[Column]:
    name = F.concat(F.lit(PREFIX[kind]), F.col("entity_id"), F.lit("-"), F.col("anchor").cast("string"))
    return [name.alias("sequence_id"), F.col("entity_id"), F.lit(kind).alias("entity_type")]


def window_members(
    events: DataFrame, kind: str, kept: list[str], width: int = HOUR, unknown_entity: bool = False, **chain
) -> DataFrame:
    """Events of windows with two or more events: entity_id, us, anchor and the ``kept`` columns, which alone cross the join."""
    key = KEY_OF[kind]
    if unknown_entity:
        events = events.withColumn(key, F.coalesce(F.col(key), F.lit("Unknown")))
    marks = anchors(ticks(events, key), width, **chain).where(F.col("n") >= 2)
    shown = events.select(key, "event_timestamp", *kept)
    return in_windows(shown, key, marks.select("entity_id", "anchor"), width).drop(key, "event_timestamp")


def summed_members(events: DataFrame, kind: str, width: int = HOUR, unknown_entity: bool = False, **chain) -> DataFrame:
    """What ``sequence_rows`` reads of the evidence, without ids, step numbers or a written table."""
    kept = ["source_dataset", "event_category", "action"]
    return window_members(events, kind, kept, width, unknown_entity, **chain).select(*_sequence_key(kind), *kept, "us", "anchor")


def member_pages(evidence: DataFrame, size: int = PAGE) -> DataFrame:
    """Members of sequences in step order as rows (sequence_id, page, event_ids) of at most ``size`` ids."""
    page = F.floor((F.col("step") - 1) / F.lit(size)).cast("int").alias("page")
    listed = F.array_sort(F.collect_list(F.struct("step", "event_id")))
    return evidence.groupBy("sequence_id", page).agg(F.transform(listed, lambda x: x["event_id"]).alias("event_ids"))


def with_members(seq: DataFrame, pages: DataFrame) -> DataFrame:
    """Sequences for export: the pages of each joined to the one text ``event_ids``."""
    joined = F.array_sort(F.collect_list(F.struct("page", F.array_join("event_ids", "; ").alias("ids"))))
    texts = pages.groupBy("sequence_id").agg(F.array_join(F.transform(joined, lambda x: x["ids"]), "; ").alias("event_ids"))
    names = seq.columns
    names.insert(names.index("event_count") + 1, "event_ids")
    return seq.join(texts, "sequence_id").select(*names)


def sequences(evidence: DataFrame, kind: str, width: int = HOUR, **actions) -> DataFrame:
    """One row per sequence in export form, with the text of its members."""
    return with_members(sequence_rows(evidence, kind, width, **actions), member_pages(evidence))


def _held(column: str, known: list[str] | None) -> Column:
    """The distinct values of a column in order; with ``known`` values as bits, which need no set per group."""
    if known is None:
        return F.array_sort(F.collect_set(column))
    bits = reduce(lambda acc, iv: acc.when(F.col(column) == iv[1], 1 << iv[0]), enumerate(sorted(known)), F.when(F.lit(False), 0))
    return F.coalesce(F.bit_or(bits), F.lit(0))


def _listed(column: str, known: list[str] | None) -> Column:
    if known is None:
        return F.col(column)
    names = F.array(*[F.when(F.col(column).bitwiseAND(1 << i) != 0, v) for i, v in enumerate(sorted(known))])
    return F.array_compact(names)


def sequence_rows(
    evidence: DataFrame, kind: str, width: int = HOUR,
    fail_action: str = "LOGIN_FAILED", success_action: str = "LOGIN_SUCCESS",
    known_sources: list[str] | None = None, known_categories: list[str] | None = None,
) -> DataFrame:
    """One row per sequence, aggregated from its evidence rows; ``member_pages`` lists its members.

    ``known_sources`` and ``known_categories`` promise that no other source or category occurs.
    """
    is_cat = lambda c: F.count_if(F.col("event_category") == c)
    is_action = lambda a: F.count_if(F.col("action") == a)
    df = evidence.groupBy("entity_id", "anchor").agg(
        F.count("*").alias("event_count"),
        F.max("us").alias("last_us"),
        _held("source_dataset", known_sources).alias("sources"),
        _held("event_category", known_categories).alias("categories"),
        is_cat("AUTHENTICATION").alias("n_auth"),
        is_cat("ENDPOINT_ALERT").alias("n_alert"),
        is_cat("NETWORK_FLOW").alias("n_flow"),
        is_action(fail_action).alias("n_fail"),
        is_action(success_action).alias("n_success"),
        is_action("DENY").alias("n_deny"),
    ).withColumns({"sources": _listed("sources", known_sources), "n_categories": F.size(_listed("categories", known_categories))})
    df = df.withColumn("n_sources", F.size("sources"))
    n, src = F.col("event_count"), F.col("n_sources")
    seconds = F.floor((F.col("last_us") - F.col("anchor")) / F.lit(1e6)).cast("bigint")
    counter = text.join_flags([(src < 2, "SINGLE_SOURCE_ONLY"), (seconds == 0, "IDENTICAL_TIMESTAMP_WINDOW")])
    return df.select(
        *_sequence_key(kind),
        (_user_type() if kind == "USER" else _host_type()).alias("sequence_type"),
        times.as_text(times.from_micros(F.col("anchor"))).alias("start_time"),
        times.as_text(times.from_micros(F.col("last_us"))).alias("end_time"),
        seconds.alias("duration_seconds"),
        n,
        F.array_join("sources", "; ").alias("source_datasets"),
        F.lit(width // 60_000_000).cast("bigint").alias("temporal_window_minutes"),
        sequence_confidence(F.lit(1.0), src, n).alias("sequence_confidence"),
        sequence_strength(src, F.col("n_categories"), n).alias("sequence_strength"),
        counter.alias("counter_evidence"),
    )


def pattern_frequency(seq: DataFrame) -> DataFrame:
    return seq.groupBy("sequence_type").agg(
        F.count("*").alias("pattern_occurrence_count"),
        F.count_distinct("entity_id").alias("unique_entities"),
        numbers.round_half_up(F.avg("event_count"), 2).alias("avg_event_count"),
        numbers.round_half_up(F.avg("duration_seconds"), 2).alias("avg_duration_sec"),
    ).withColumn("rarity_category", numbers.pattern_rarity(F.col("pattern_occurrence_count")))


def temporal_signals(seq: DataFrame, entities: DataFrame, key: str, extra: list[str] | None = None) -> DataFrame:
    """Sequence summary per entity; entities without sequences get zeros."""
    agg = seq.groupBy(F.col("entity_id").alias(key)).agg(
        F.count("*").alias("temporal_sequence_count"),
        F.max("sequence_strength").alias("strongest_sequence_strength"),
        F.sum("event_count").alias("temporal_evidence_count"),
        F.max("sequence_confidence").alias("temporal_confidence"),
    )
    filled = [
        "temporal_sequence_count", "strongest_sequence_strength", "temporal_evidence_count", "temporal_confidence"]
    df = entities.select(key, *(extra or [])).join(agg, key, "left").fillna(0, filled)
    return df.withColumn("temporal_signal_present", F.col("temporal_sequence_count") > 0)


# --- bursts ---------------------------------------------------------------------------


def _first_events(least: int) -> Callable:
    """One row a partition: its first and last entity, and the first ``least`` ticks of the first."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, p, first, last = [], None, None, None
        for pdf in batches:
            if pdf.empty:
                continue
            if first is None:
                p, first = int(pdf["_p"].iloc[0]), pdf["entity_id"].iloc[0]
            if len(head) < least:
                own = pdf[pdf["entity_id"] == first].head(least - len(head))
                head += list(zip(own["us"].tolist(), own["n"].tolist()))
            last = pdf["entity_id"].iloc[-1]
        if first is not None:
            yield pd.DataFrame({"_p": [p], "first": [first], "last": [last], "us": [[u for u, _ in head]], "n": [[n for _, n in head]]})

    return scan


def following(r: DataFrame, least: int) -> dict[int, list[tuple[int, int]]]:
    """For partitions whose last entity goes on: the next ticks (time, events) of it, up to ``least``."""
    heads = r.select("entity_id", "us", "n", "_p").mapInPandas(_first_events(least), "_p int, first string, last string, us array<long>, n array<long>")
    # one row a partition; every later one of the same entity adds a tick at least
    after = Window.orderBy("_p").rowsBetween(1, least)
    listed = F.collect_list(F.struct("first", "us", "n")).over(after)
    rows = heads.select("_p", F.filter(listed, lambda x: x["first"] == F.col("last")).alias("after")).where(F.size("after") > 0).collect()
    return {x["_p"]: [pair for a in x["after"] for pair in zip(a["us"], a["n"])][:least] for x in rows}


def _can_start(r: DataFrame, width: int, least: int) -> DataFrame:
    """Ticks of written segments from which at least ``least`` events follow within ``width``."""
    beyond = following(r, least)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, p = None, None

        def judge(pdf: pd.DataFrame, own: int, final: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
            """(ticks that can start, ticks that need later ones) of the first ``own`` rows."""
            ent, us, n = (pdf[c].to_numpy() for c in ("entity_id", "us", "n"))
            upto = np.cumsum(n)
            at = np.searchsorted(upto, upto - n + least, side="left")  # the tick of the last event needed
            known, near = at < len(us), np.minimum(at, len(us) - 1)
            hit = known & (ent[near] == ent) & (us[near] <= us + width)
            hit[own:] = False
            return pdf[hit], pdf[:0] if final else pdf[~known]

        for pdf in batches:
            if pdf.empty:
                continue
            p = int(pdf["_p"].iloc[0])
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            hit, held = judge(pdf, len(pdf), False)
            yield hit
        if held is not None and len(held):
            more = pd.DataFrame(beyond.get(p, []), columns=["us", "n"]).assign(entity_id=held["entity_id"].iloc[-1], _p=p)
            yield judge(pd.concat([held, more[held.columns]], ignore_index=True), len(held), True)[0]

    return cut(r.mapInPandas(scan, r.schema))


def bursts(events: DataFrame, kind: str, width: int = HOUR // 2, least: int = 3, **chain) -> DataFrame:
    """Dense windows: ``least`` or more events within ``width`` of the first.

    On a miss the scan moves one event on, on a hit it jumps past the window.
    That equals anchored windows whose anchors are drawn only from the ticks
    that can start a burst.
    """
    key = KEY_OF[kind]
    marks = anchors_of(_can_start(segments(ticks(events, key), **chain), width, least), width)
    df = in_windows(events, key, marks.select("entity_id", "anchor"), width).groupBy("entity_id", "anchor").agg(
        F.count("*").alias("event_count"),
        F.max("us").alias("last_us"),
        F.size(F.collect_set("source_dataset")).cast("bigint").alias("source_diversity_count"),
        F.min("source_dataset").alias("source"),
    )
    seconds = F.greatest(F.lit(1.0), (F.col("last_us") - F.col("anchor")) / F.lit(1e6))
    n = F.col("event_count")
    return df.select(
        F.concat(F.lit(f"BURST-{kind}-"), F.col("entity_id"), F.lit("-"), F.col("anchor").cast("string"))
        .alias("burst_id"),
        "entity_id",
        F.lit(kind).alias("entity_type"),
        times.as_text(times.from_micros(F.col("anchor"))).alias("burst_start"),
        times.as_text(times.from_micros(F.col("last_us"))).alias("burst_end"),
        numbers.round_half_up(seconds, 1).alias("burst_duration_sec"),
        "event_count",
        numbers.round_half_up(n / (seconds / 60.0), 2).alias("event_density_per_min"),
        "source_diversity_count",
        burst_category(F.col("source_diversity_count"), F.col("source")).alias("burst_category"),
        F.when(n >= 10, "CRITICAL").when(n >= 5, "HIGH").otherwise("MEDIUM").alias("severity_level"),
    )


def burst_category(diversity: Column, source: Column) -> Column:
    name = F.lower(source)
    return (
        F.when(diversity > 1, "MULTI_SOURCE_BURST")
        .when(F.contains(name, F.lit("iam")), "AUTHENTICATION_BURST")
        .when(F.contains(name, F.lit("endpoint")), "ENDPOINT_BURST")
        .otherwise("FIREWALL_BURST")
    )
