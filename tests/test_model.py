"""Risk, graph, clusters, lookups and readers on small literal inputs."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantry.functions import numbers
from vantry.operators import graph, ids, insights, lookups, quality, risk
from vantry.sources import io


# --- risk ---


def dev(spark, a, n, e, o):
    return spark.createDataFrame([(float(a), float(n), float(e), float(o))],
                                 "authentication_deviation double, network_deviation double, endpoint_deviation double, "
                                 "off_hours_deviation double")


@pytest.mark.parametrize("z, score", [((0, 0, 0, 0), 0), ((4, 0, 0, 0), 25), ((40, 0, 0, 0), 25), ((4, 4, 0, 0), 62.5),
                                      ((4, 4, 4, 4), 100), ((2, 2, 2, 2), 50), ((2.5, 2.5, 2.5, 0), 70.3125)])
def test_risk_score(spark, z, score):
    assert risk.scored(dev(spark, *z), risk.USER_WEIGHTS).first()._raw_score == pytest.approx(score)


def test_evidence_confidence(spark):
    df = spark.createDataFrame([(0, 0.0, "UNTRUSTED"), (20, 1.0, "HIGH"), (5, 0.5, "odd")], "n long, q double, b string")
    got = [r.c for r in df.select(risk.evidence_confidence(F.col("n"), F.col("q"), F.col("b")).alias("c")).collect()]
    assert got == [0.03, 1.0, 0.5]


def test_rounding_rule(spark):
    df = spark.createDataFrame([(0.125,), (-0.125,), (2.0,)], "v double")
    assert [r.o for r in df.select(numbers.round_half_up(F.col("v"), 2).alias("o")).collect()] == [0.13, -0.12, 2.0]


# --- graph ---


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(3)
    pairs = {(f"N{rng.randint(0, 40)}", f"N{rng.randint(0, 40)}") for _ in range(45)}
    pairs |= {("N0", f"H{i}") for i in range(30)}  # one hub
    rows = sorted(p for p in pairs if p[0] != p[1])
    return rows, spark.createDataFrame([(f"e{i}", a, b) for i, (a, b) in enumerate(rows)],
                                       "edge_id string, source_id string, target_id string")


def levels(rows, root):
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    depth, frontier = {root: 0}, [root]
    while frontier:
        nxt = sorted({m for n in frontier for m in near.get(n, ()) if m not in depth})
        depth.update({m: depth[frontier[0]] + 1 for m in nxt})
        frontier = nxt
    return depth, near


def test_neighborhood(edges, store):
    rows, df = edges
    depth, _ = levels(rows, "N0")
    hood = graph.neighborhood(df, "N0", 2, store)
    assert {r.node_id: r.depth for r in hood.collect()} == {n: d for n, d in depth.items() if d <= 2}
    s = graph.neighborhood_summary(df, hood, "N0", 2).first()
    inner = {n for n, d in depth.items() if d < 2}
    assert s.edge_count == sum((a in inner) + (b in inner) for a, b in rows)
    assert s.distinct_edge_count == sum(a in inner or b in inner for a, b in rows)


def test_neighborhood_edges_read_only_their_folders(edges, store):
    rows, df = edges
    links = graph.adjacency(df.withColumn("relationship_type", F.lit("R")), store, store.fresh("adjacency"))
    assert links.count() == 2 * len(rows)
    depth, _ = levels(rows, "N0")
    hood = graph.neighborhood(df, "N0", 2, store, links)
    got = graph.neighborhood_edges(links, hood, 2, store)
    inner = {n for n, d in depth.items() if d < 2}
    assert {(r.source_id, r.target_id) for r in got.collect()} == {(a, b) for a, b in rows if a in inner or b in inner}
    one = graph.at_nodes(links, hood.where("depth = 0"))
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in one._jdf.queryExecution().toString()


def test_smallest_of_many_shortest_paths(spark, store):
    """A grid has many paths of one length; the smallest by ids is taken, wherever the sides meet."""
    rows = [(f"E{i}{j}{d}", f"{i}{j}", f"{i + (d == 0)}{j + (d == 1)}") for i in range(5) for j in range(5) for d in (0, 1)]
    df = spark.createDataFrame(rows, "edge_id string, source_id string, target_id string")
    path = [r.node_id for r in graph.shortest_path(df, "00", "44", store).orderBy("step").collect()]
    assert path == ["00", "01", "02", "03", "04", "14", "24", "34", "44"]
    assert [r.node_id for r in graph.shortest_path(df, "44", "00", store).orderBy("step").collect()] == ["44", "34", "24", "14", "04", "03", "02", "01", "00"]


def test_shortest_path(edges, store):
    rows, df = edges
    depth, near = levels(rows, "H3")
    far = max(depth, key=lambda n: (depth[n], n))
    walk = lambda a, b: [r.node_id for r in graph.shortest_path(df, a, b, store).orderBy("step").collect()]
    path = walk("H3", far)
    assert path[0] == "H3" and path[-1] == far and len(path) == depth[far] + 1
    assert all(b in near[a] for a, b in zip(path, path[1:]))
    assert walk("H3", "H3") == ["H3"]
    assert walk("H3", "absent") == []


def test_path_of_any_length(spark, store):
    chain = spark.createDataFrame([(f"E{i}", f"N{i:03d}", f"N{i + 1:03d}") for i in range(40)], "edge_id string, source_id string, target_id string")
    path = graph.shortest_path(chain, "N000", "N040", store).orderBy("step").collect()
    assert [(r.step, r.node_id) for r in path] == [(i, f"N{i:03d}") for i in range(41)]


def test_missing_node_gets_defaults(spark):
    nodes = spark.createDataFrame([("A", "USER", "a", "IT", "Active")], "node_id string, node_type string, label string, department string, status string")
    got = {r.node_id: r.label for r in graph.lookup_nodes(nodes, spark.createDataFrame([("A",), ("B",)], "node_id string")).collect()}
    assert got == {"A": "a", "B": "NO_VERIFIED_RELATIONSHIP"}


# --- clusters ---


def test_kmeans_equals_numpy(spark, store):
    rng = np.random.default_rng(5)
    data = np.round(np.vstack([rng.normal(m, 0.6, (30, 6)) for m in (0, 3, 6)]), 4)
    names = [f"U{i:03d}" for i in range(len(data))]
    points = spark.createDataFrame([(n, *map(float, r)) for n, r in zip(names, data)],
                                   "entity_id string, " + ", ".join(f"{f} double" for f in insights.FEATURES))
    start = insights.initial_centroids(*insights.numbered_points(points, store), 3)
    assert start == [data[i * 30].tolist() for i in range(3)]
    fit = insights.kmeans(points, start)
    centroids = data[[0, 30, 60]]
    for _ in range(300):
        labels = ((data[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([data[labels == j].mean(axis=0) if (labels == j).any() else centroids[j] for j in range(3)])
        if np.allclose(centroids, new, atol=1e-5):
            break
        centroids = new
    assert fit.converged and np.allclose(fit.centroids, centroids, atol=1e-9)
    got = {r.entity_id: r.label for r in insights.assigned(points, fit).collect()}
    assert got == dict(zip(names, labels.tolist()))


def test_running_number(spark, store):
    df = spark.range(1000).select(F.sha1(F.col("id").cast("string")).alias("k"))
    got = [r.n for r in ids.running_number(df, ["k"], store, store.fresh("t"), "n", 5).orderBy("k").collect()]
    assert got == list(range(5, 1005))


# --- lookups and checks ---


def test_entity_resolution(spark):
    users = spark.createDataFrame([("EMP1", "IT"), ("EMP12", "IT"), ("EMP30", "Sales")], "entity_id string, department string")
    hosts = spark.createDataFrame([("WS-1",)], "entity_id string")
    seqs = spark.createDataFrame([("SEQ-USR-9",)], "sequence_id string")
    terms = spark.createDataFrame([("emp1",), ("ws-1",), ("seq-usr-9",), ("30",), ("IT",), ("zzz",), ("1",), (None,)], "term string")
    got = {r.term: (r.status, r.entity_type, r.entity_id, r.candidates)
           for r in lookups.resolve_entities(terms, users, hosts, seqs).collect()}
    assert got == {
        "EMP1": ("RESOLVED", "user", "EMP1", None), "WS-1": ("RESOLVED", "host", "WS-1", None),
        "SEQ-USR-9": ("RESOLVED", "sequence", "SEQ-USR-9", None), "30": ("RESOLVED", "user", "EMP30", None),
        "IT": ("AMBIGUOUS", None, None, "EMP1; EMP12"), "ZZZ": ("NOT_FOUND", None, None, None),
        "1": ("AMBIGUOUS", None, None, "EMP1; EMP12"),
    }


def test_suite_counts_null_as_violation(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "v int")
    row = quality.report([quality.suite(df, [quality.Rule("positive", F.col("v") > 0)], "t")]).first()
    assert (row.violations, row.status) == (2, "FAIL")


def test_schema_report(spark):
    df = spark.createDataFrame([(1, 2)], "b int, x int")
    got = {r.check_name: (r.status, r.details) for r in quality.schema_report(df, ["a", "b"], "t").collect()}
    assert got["missing columns"] == ("FAIL", "a") and got["unexpected columns"] == ("FAIL", "x")


# --- readers ---


@pytest.mark.parametrize("body", [
    json.dumps([{"a": "1"}, {"a": "2"}]), json.dumps([{"a": "1"}, {"a": "2"}], indent=2),
    json.dumps({"records": [{"a": "1"}, {"a": "2"}]}), json.dumps({"iam_logs": [{"a": "1"}, {"a": "2"}]}, indent=2),
    '{"a": "1"}\n{"a": "2"}\n',
])
def test_json_layouts(spark, tmp_path, body):
    path = tmp_path / "x.json"
    path.write_text(body)
    assert sorted(r.a for r in io.read_json(spark, str(path)).collect()) == ["1", "2"]


def test_single_json_object(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"a": "1"}, indent=1))
    assert [r.a for r in io.read_json(spark, str(path)).collect()] == ["1"]


def test_headers_and_absent_tables(spark, tmp_path):
    df = spark.createDataFrame([("1",)], "` Event ID ` string")
    assert io.standard_headers(df).columns == ["event_id"]
    schema = io.text_schema(["a"])
    assert io.load_table(spark, str(tmp_path), ["none"], schema).count() == 0
    with pytest.raises(ValueError):
        io.read_table(spark, "x.xlsx")
