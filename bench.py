"""Headline timings on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

The pipeline starts on an empty store, so every stage is timed with the work it
adds; the queries then run on the written stage tables.
"""

from __future__ import annotations

import json
import os
import time

from vantry.plans.pipeline import open_pipeline
from vantry.plans.queries import Q
from vantry.session import local_session

STAGES = [
    "identity", "iam", "endpoint", "firewall", "events", "user_features", "host_features", "session_features",
    "event_features", "user_baselines", "host_baselines", "user_risk", "host_risk", "risk_evidence",
    "user_sequence_evidence", "host_sequence_evidence", "sequences", "bursts", "nodes", "edges", "clustered",
]
QUERIES = [
    "R02_user_risk", "R11_sensitivity", "T09_pattern_frequency", "T10_user_signals", "G03_metadata", "G08_shared_address",
    "G11_neighborhood_summary", "G12_shortest_path", "I10_peer_outliers", "L03_triage_by_risk", "L09_evidence_by_source",
    "L14_evidence_packages", "L15_entity_resolution", "L17_intent", "L20_failed_logins_by_department", "Q01_column_profile",
    "Q10_key_normalization", "Q19_graph_checks",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    pipeline = open_pipeline(spark, folder, fresh=True)
    times: dict[str, float] = {}
    for name in STAGES:
        start = time.perf_counter()
        run(getattr(pipeline, name))
        times[f"stage_{name}"] = round(time.perf_counter() - start, 3)
    for name in QUERIES:
        start = time.perf_counter()
        run(Q[name](pipeline))
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "pipeline stages plus lookup queries, total wall time", "value": total, "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
