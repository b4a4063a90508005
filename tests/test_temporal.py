import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantry.operators import temporal

START = datetime(2024, 1, 1)
SCHEMA = "event_id string, user_id string, event_timestamp timestamp_ntz"


def make_rows(seed: int):
    """Sparse and dense users, ties, and one user with most of the events."""
    rng = random.Random(seed)
    rows = []
    for user in range(25):
        n, gap = (1500, 200) if user == 0 else (rng.choice([1, 2, 5, 60]), rng.choice([30, 900, 5000, 40000]))
        t = START + timedelta(seconds=rng.randint(0, 90000))
        for i in range(n):
            t += timedelta(seconds=rng.choice([0, int(rng.expovariate(1 / gap))]))
            rows.append((f"E{user}-{i}", f"U{user}", t))
    return rows


def by_user(rows):
    groups = defaultdict(list)
    for _, user, t in rows:
        groups[user].append(t)
    return {u: sorted(ts) for u, ts in groups.items()}


def greedy(rows, width):
    out = set()
    for user, ts in by_user(rows).items():
        i = 0
        while i < len(ts):
            j = i
            while j < len(ts) and (ts[j] - ts[i]).total_seconds() <= width:
                j += 1
            out.add((user, ts[i], j - i))
            i = j
    return out


def greedy_bursts(rows, width, least):
    out = set()
    for user, ts in by_user(rows).items():
        i = 0
        while i < len(ts):
            j = i
            while j < len(ts) and (ts[j] - ts[i]).total_seconds() <= width:
                j += 1
            if j - i >= least:
                out.add((user, ts[i], j - i))
                i = j
            else:
                i += 1
    return out


@pytest.mark.parametrize("limit", [None, 10**6, 40, 400])
def test_windows_equal_the_plain_loop(spark, store, limit):
    rows = make_rows(7)
    df = spark.createDataFrame(rows, SCHEMA)
    marks = temporal.anchors(temporal.ticks(df, "user_id"), temporal.HOUR, limit, store)
    assert {(r.entity_id, START + timedelta(microseconds=r.anchor - 1704067200 * 10**6), r.n) for r in marks.collect()} == greedy(rows, 3600)
    members = temporal.in_windows(df, "user_id", marks.drop("n")).groupBy("user_id", "anchor").agg(F.count("*").alias("n"))
    got = {(r.user_id, START + timedelta(microseconds=r.anchor - 1704067200 * 10**6), r.n) for r in members.collect()}
    assert got == greedy(rows, 3600)


@pytest.mark.parametrize("limit", [10**6, 30])
def test_bursts_equal_the_plain_loop(spark, limit):
    rows = make_rows(11)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("source_dataset", F.lit("IAM"))
    got = {(r.entity_id, datetime.fromisoformat(r.burst_start), r.event_count)
           for r in temporal.bursts(df, "USER", limit=limit).collect()}
    assert got == greedy_bursts(rows, 1800, 3)


def test_chains_merge():
    us = np.arange(0, 1000, 7)
    entries = np.arange(0, 50, 3)
    until, low = temporal.advance(entries, entries, us, 100)
    for entry in entries:
        at = entry
        while at < us[-1]:
            at = us[np.searchsorted(us, at, side="right")] + 100
        assert until[np.searchsorted(low, entry, side="right") - 1] == at
    assert len(until) < len(entries)


def follow(entry, us, width):
    for t in us:
        if t > entry:
            entry = t + width
    return entry


def test_segments_compose_like_one():
    """Functions of pieces of one entity, composed in any grouping, equal the plain chain."""
    rng = random.Random(3)
    for _ in range(300):
        width, us, parts = rng.choice([5, 20, 60]), [], []
        t = 0
        for _ in range(rng.randint(1, 5)):
            part = []
            for _ in range(rng.randint(1, 25)):
                t += rng.choice([1, 1, 2, 3, 9, 70])
                part.append(t)
            parts.append(part)
            us += part
        made = []
        for part in parts:
            f = temporal.Segment(width, True)
            at = rng.randint(0, len(part))
            for piece in (part[:at], part[at:]):
                if piece:
                    f.feed(np.array(piece))
            made.append(f.close())
        while len(made) > 1:
            k = rng.randrange(len(made) - 1)
            made[k : k + 2] = [temporal.compose(*made[k], *made[k + 1])]
        low, out = made[0]
        for entry in [temporal._START, *range(us[0], us[0] + width)]:  # a chain from an earlier tick
            assert max(entry, out[np.searchsorted(low, entry, side="right") - 1]) == follow(entry, us, width)


def test_a_host_with_most_events_in_many_segments(spark):
    """Dense ticks without a quiet gap: entries come from several rounds of composition."""
    rng = random.Random(9)
    us, t = [], 1_700_000_000_000_000
    for _ in range(3_000):
        t += rng.choice([1, 2, 3]) * 1_000_000
        us.append(t)
    df = spark.createDataFrame([("hot", u, 1) for u in us] + [("cold", us[5], 2)], "entity_id string, us long, n long")
    r = temporal.segments(df, limit=40)
    assert r.select("_p").distinct().count() > 40
    want, at = [], temporal._START
    for u in us:
        if u > at:
            want.append(u)
            at = u + temporal.HOUR
    got = {(x.entity_id, x.anchor): x.n for x in temporal.anchors_of(r, temporal.HOUR).collect()}
    assert set(got) == {("hot", u) for u in want} | {("cold", us[5])}
    assert sum(got.values()) == 3_002 and got[("cold", us[5])] == 2


def test_pages_of_members(spark):
    ok = ("AUTHENTICATION", "IAM", "OTHER")
    evidence = temporal.sequence_evidence(events(spark, [(i % 3000, *ok) for i in range(2_500)]), "USER")
    pages = temporal.member_pages(evidence, 400).orderBy("page").collect()
    assert [len(r.event_ids) for r in pages] == [400] * 6 + [100]
    text = temporal.with_members(temporal.sequence_rows(evidence, "USER"), temporal.member_pages(evidence, 400)).first().event_ids
    assert text == "; ".join(i for r in pages for i in r.event_ids) == temporal.sequences(evidence, "USER").first().event_ids


def events(spark, rows):
    return spark.createDataFrame(
        [(f"E{i}", "U", START + timedelta(seconds=s), cat, src, act) for i, (s, cat, src, act) in enumerate(rows)],
        "event_id string, user_id string, event_timestamp timestamp_ntz, event_category string, source_dataset string, "
        "action string").withColumn("source_record_id", F.col("event_id"))


def sequence(spark, rows, **kw):
    ev = temporal.sequence_evidence(events(spark, rows), "USER")
    return temporal.sequences(ev, "USER", **kw).collect()


def test_window_edge(spark):
    auth = ("AUTHENTICATION", "IAM", "OTHER")
    assert len(sequence(spark, [(0, *auth), (3600, *auth)])) == 1
    assert sequence(spark, [(0, *auth), (3601, *auth)]) == []


def test_sequence_types_and_strength(spark):
    fail, ok = ("AUTHENTICATION", "IAM", "LOGIN_FAILED"), ("AUTHENTICATION", "IAM", "LOGIN_SUCCESS")
    alert = ("ENDPOINT_ALERT", "Endpoint", "ALERT_TRIGGERED")
    assert sequence(spark, [(0, *fail), (1, *ok)])[0].sequence_type == "FAILED_AUTH_TO_SUCCESS"
    assert sequence(spark, [(0, *fail), (1, *fail)])[0].sequence_type == "FAILED_LOGIN_SERIES"
    row = sequence(spark, [(0, *ok), (1, *alert), (2, *alert), (3, *alert)])[0]
    assert row.sequence_type == "AUTH_TO_ENDPOINT_ALERT" and row.sequence_strength == 100.0
    assert row.event_ids == "E0; E1; E2; E3" and row.source_datasets == "Endpoint; IAM"
    same = sequence(spark, [(0, *ok), (0, *ok)])[0]
    assert same.counter_evidence == "SINGLE_SOURCE_ONLY; IDENTICAL_TIMESTAMP_WINDOW"


def test_steps_of_a_busy_window_follow_time_and_id(spark):
    ok = ("AUTHENTICATION", "IAM", "OTHER")
    rows = [((i * 37) % 1800, *ok) for i in range(2_000)]
    got = temporal.sequence_evidence(events(spark, rows), "USER").orderBy("step").collect()
    assert [r.step for r in got] == list(range(1, 2_001))
    keys = [(r.us, r.event_id) for r in got]
    assert keys == sorted(keys)


def test_long_sequences_list_all_members(spark):
    ok = ("AUTHENTICATION", "IAM", "OTHER")
    rows = [(i % 3000, *ok) for i in range(12_000)]
    evidence = temporal.sequence_evidence(events(spark, rows), "USER")
    seq = temporal.sequences(evidence, "USER").first()
    assert seq.event_count == 12_000 == evidence.count()
    assert sorted(seq.event_ids.split("; ")) == sorted(f"E{i}" for i in range(12_000))


def test_events_without_a_user(spark):
    df = events(spark, [(0, "NETWORK_FLOW", "Firewall", "DENY"), (5, "NETWORK_FLOW", "Firewall", "DENY")])
    df = df.withColumn("user_id", F.lit(None).cast("string"))
    assert temporal.sequence_evidence(df, "USER").count() == 0
    assert temporal.sequence_evidence(df, "USER", unknown_entity=True).count() == 2
