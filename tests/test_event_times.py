"""Baselines count the times of events that are not written."""

from vantry.operators import baselines, canonical
from vantry.plans.pipeline import open_pipeline


def test_user_baselines_read_no_firewall(spark, folder):
    p = open_pipeline(spark, folder, fresh=True)
    assert p.user_baselines.count() > 0
    assert not {"events", "firewall", "firewall_parsed"} & set(p.__dict__)


def test_times_count_as_the_events_do(spark, folder):
    p = open_pipeline(spark, folder)
    for key, rows in (("user_id", canonical.event_times(p.iam, p.endpoint)), ("hostname", canonical.event_times(p.iam, p.endpoint, p.firewall))):
        got, want = (sorted(map(str, baselines.observations(df, key).collect())) for df in (rows, p.events))
        assert want and got == want


def test_host_baselines_write_no_events(spark, folder):
    p = open_pipeline(spark, folder, fresh=True)
    assert p.host_baselines.count() > 0 and "events" not in p.__dict__
