"""The whole pipeline as named tables, built on demand.

Tables read by several others are written once to the shared folder; the rest
stay lazy, so a query plans only what it needs.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baselines, canonical, clean, features, graph, insights, lookups, risk, suites, temporal
from ..session import TableStore
from ..sources import fixtures


class Pipeline:
    """Tables derived from four raw telemetry tables.

    ``raw`` maps identity_raw, iam_raw, endpoint_raw and firewall_raw to text
    DataFrames from any source.
    """

    def __init__(self, spark: SparkSession, raw: dict[str, DataFrame], store: TableStore, folder: str = ""):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # a longer method is never compiled by the JVM; Spark then makes the projection of many short ones
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        self.spark, self.raw, self.store, self.folder = spark, raw, store, folder
        self._stored: dict[str, DataFrame] = {}

    def stored_raw(self, source: str) -> DataFrame:
        """A raw table in columnar form, written when first asked for."""
        if source not in self._stored:
            self._stored[source] = self.store.put(f"raw_{source}", self.raw[f"{source}_raw"])
        return self._stored[source]

    # clean tables
    @cached_property
    def identity(self) -> DataFrame:
        return self.store.put("identity", clean.clean_identity(self.raw["identity_raw"]))

    @cached_property
    def iam_parsed(self) -> DataFrame:
        return self.store.put("iam", clean.parse_iam(self.raw["iam_raw"]))

    @cached_property
    def iam(self) -> DataFrame:
        return clean.finish_iam(self.iam_parsed)

    @cached_property
    def endpoint_parsed(self) -> DataFrame:
        return self.store.put("endpoint", clean.parse_endpoint(self.raw["endpoint_raw"]))

    @cached_property
    def endpoint(self) -> DataFrame:
        return clean.finish_endpoint(self.endpoint_parsed)

    @cached_property
    def firewall_parsed(self) -> DataFrame:
        return self.store.put("firewall", clean.parse_firewall(self.raw["firewall_raw"]))

    @cached_property
    def firewall(self) -> DataFrame:
        return clean.finish_firewall(self.firewall_parsed)

    # canonical model
    @cached_property
    def events(self) -> DataFrame:
        parts = canonical.event_parts(self.identity, self.iam, self.endpoint, self.firewall)
        return self.store.put_parts("events", "source_dataset", parts)

    @cached_property
    def users(self) -> DataFrame:
        return canonical.canonical_users(self.identity, self.iam, self.endpoint)

    @cached_property
    def hosts(self) -> DataFrame:
        return canonical.canonical_hosts(self.identity, self.firewall, self.endpoint)

    @cached_property
    def sessions(self) -> DataFrame:
        return canonical.canonical_sessions(self.iam, self.firewall)

    @cached_property
    def relationships(self) -> DataFrame:
        return canonical.canonical_relationships(self.identity, self.endpoint, self.firewall)

    # features, baselines, risk
    @cached_property
    def user_features(self) -> DataFrame:
        return self.store.put("user_features", features.user_features(self.identity, self.iam, self.endpoint))

    @cached_property
    def host_features(self) -> DataFrame:
        return self.store.put("host_features", features.host_features(self.identity, self.endpoint, self.firewall))

    @cached_property
    def session_features(self) -> DataFrame:
        return features.session_features(self.iam, self.firewall)

    @cached_property
    def event_features(self) -> DataFrame:
        return features.event_features(self.events, self.endpoint)

    @cached_property
    def user_baselines(self) -> DataFrame:
        return self.store.put("user_baselines", baselines.user_baselines(
            self.user_features, canonical.event_times(self.iam, self.endpoint)))

    @cached_property
    def host_baselines(self) -> DataFrame:
        return self.store.put("host_baselines", baselines.host_baselines(
            self.host_features, canonical.event_times(self.iam, self.endpoint, self.firewall)))

    @cached_property
    def user_deviations(self) -> DataFrame:
        return baselines.user_deviations(self.user_baselines)

    @cached_property
    def host_deviations(self) -> DataFrame:
        return baselines.host_deviations(self.host_baselines)

    @cached_property
    def user_risk(self) -> DataFrame:
        return self.store.put("user_risk", risk.user_risk(self.user_deviations))

    @cached_property
    def host_risk(self) -> DataFrame:
        return self.store.put("host_risk", risk.host_risk(self.host_deviations))

    @cached_property
    def risk_scores(self) -> DataFrame:
        return risk.risk_scores(self.user_risk).unionByName(risk.risk_scores(self.host_risk))

    @cached_property
    def hypotheses(self) -> DataFrame:
        return risk.hypotheses(self.user_risk, "USER").unionByName(risk.hypotheses(self.host_risk, "HOST"))

    @cached_property
    def risk_evidence(self) -> DataFrame:
        return self.store.put(
            "risk_evidence", risk.normalized_evidence(self.events, self.user_risk, self.host_risk))

    # temporal
    @cached_property
    def user_members(self) -> DataFrame:
        return self.store.put("user_members", temporal.members(self.events, "USER", store=self.store))

    @cached_property
    def host_members(self) -> DataFrame:
        return self.store.put("host_members", temporal.members(self.events, "HOST", store=self.store))

    @cached_property
    def members(self) -> DataFrame:
        """Events of sequences without their numbers."""
        return temporal.member_rows(self.user_members, "USER").unionByName(temporal.member_rows(self.host_members, "HOST"))

    @cached_property
    def user_sequence_evidence(self) -> DataFrame:
        return self.store.put("user_sequence_evidence", temporal.numbered_evidence(self.user_members, "USER"))

    @cached_property
    def host_sequence_evidence(self) -> DataFrame:
        return self.store.put("host_sequence_evidence", temporal.numbered_evidence(self.host_members, "HOST"))

    @cached_property
    def sequence_evidence(self) -> DataFrame:
        return self.user_sequence_evidence.unionByName(self.host_sequence_evidence)

    @cached_property
    def sequences(self) -> DataFrame:
        """Summed from written members if there are any, else from the events in windows: ask first for members if both are read."""
        parts = {
            kind: temporal.member_rows(self.__dict__[name], kind) if (name := f"{kind.lower()}_members") in self.__dict__
            else temporal.summed_members(self.events, kind, store=self.store) for kind in ("USER", "HOST")}
        return self.store.put("sequences", reduce(DataFrame.unionByName, [
            temporal.sequence_rows(df, kind, known_sources=canonical.SOURCES, known_categories=canonical.CATEGORIES)
            for kind, df in parts.items()]))

    @cached_property
    def sequence_members(self) -> DataFrame:
        return temporal.member_pages(self.sequence_evidence)

    @cached_property
    def exported_sequences(self) -> DataFrame:
        members = self.sequence_members
        return temporal.with_members(self.sequences, members)

    @cached_property
    def bursts(self) -> DataFrame:
        both = temporal.bursts(self.events, "USER", store=self.store).unionByName(
            temporal.bursts(self.events, "HOST", store=self.store))
        return self.store.put("bursts", both)

    # graph
    @cached_property
    def entity_nodes(self) -> DataFrame:
        """Nodes of all types but events."""
        return self.store.put("nodes/entities", graph.entity_nodes(
            self.identity, self.host_features, self.sessions, self.events, self.risk_scores, self.sequences))

    @cached_property
    def cited(self) -> DataFrame:
        return graph.cited_ids(self.risk_evidence, self.members)

    @cached_property
    def node_ids(self) -> DataFrame:
        """Ids of all nodes, repeats included: every cited event is a node, so that events are not read again."""
        cited = self.cited.select(F.col("event_id").alias("node_id"))  # before the sequences
        return self.entity_nodes.select("node_id").union(cited.where(F.col("node_id").isNotNull()))

    @cached_property
    def nodes(self) -> DataFrame:
        cited = self.cited  # before the sequences, which are summed from written members
        own = self.store.put("nodes/events", graph.event_nodes(self.events, cited, self.entity_nodes))
        return self.entity_nodes.unionByName(own)

    @cached_property
    def _edge_types(self) -> dict[str, graph.EdgeType]:
        tables = ("identity", "relationships", "events", "risk_scores", "sequences", "members", "risk_evidence")
        return graph.edge_types(*[(lambda name=name: getattr(self, name)) for name in tables])

    def edges_of(self, *names: str) -> DataFrame:
        """Edges of some types; each type is written when first asked for, and only from the tables it reads."""
        for name in names:
            if name not in self._stored:
                rows = graph.typed_rows(self._edge_types[name], lambda: self.nodes, ends=self._with_open_ends)
                self._stored[name] = self.store.put(f"edges/{name}", rows)
        return reduce(DataFrame.unionByName, [
            graph.typed_edges(self._stored[name], name, self._edge_types[name]) for name in names])

    def _with_open_ends(self, rows: DataFrame, ends: tuple[str, ...]) -> DataFrame:
        if not ends:
            return rows
        return graph.with_open_ends(rows, ends, self.entity_nodes, self.events, lambda: self.cited, self.store)

    @cached_property
    def edges(self) -> DataFrame:
        self.members  # before the sequences, which are summed from written members
        return self.edges_of(*graph.EDGE_TYPES)

    @cached_property
    def entity_edges(self) -> DataFrame:
        """All edges that can touch a risk-scored entity.

        Edges from risk rows and sequences to events are left out, unless an entity bears the id of one of these.
        """
        ids = self.risk_scores.select(F.col("entity_id").alias("node_id")).distinct()
        ids = self.store.put(self.store.fresh("entity_ids"), ids)
        named = ids.where(F.col("node_id").startswith("RISK-") | F.col("node_id").startswith("SEQ-"))
        if not named.isEmpty() or graph.holds_any(self.events, ids):
            return self.edges
        self.members  # as edges to alerts ask for the citations
        return self.edges_of(*[n for n in graph.EDGE_TYPES if n not in graph.OF_EVIDENCE])

    @cached_property
    def address_edges(self) -> DataFrame:
        """Edges for :func:`graph.scenarios`: of flows and sequences, and all whose target can be an address.

        Targets that are events bear such a name only if an event does.
        """
        if not self.events.where(F.col("event_id").startswith("IP-")).isEmpty():
            return self.edges
        return self.edges_of(*[n for n in graph.EDGE_TYPES if n not in (*graph.OF_EVIDENCE, "TRIGGERED_EVENT")])

    def edges_at(self, ids: DataFrame) -> DataFrame:
        """Edges of all types at a few written nodes (column entity_id), not stored."""
        self.members
        parts = []
        for name, kind in self._edge_types.items():
            rows = graph.typed_rows(kind, lambda: self.nodes, at=ids, ends=self._with_open_ends)
            parts.append(graph.typed_edges(rows, name, kind))
        return reduce(DataFrame.unionByName, parts)

    def nodes_at(self, ids: DataFrame) -> DataFrame:
        """Nodes among which those of a few written ids (column entity_id) are; events only if an id is one."""
        events = graph.holds_any(self.events, ids.select(F.col("entity_id").alias("node_id")))
        return self.nodes if events else self.entity_nodes

    def nodes_among(self, ids: DataFrame) -> DataFrame:
        """Nodes among which those of any number of ids (column node_id) are.

        Risk rows and sequences are asked for only if an id is named like theirs, and all nodes only then or if an
        id that is no earlier node is an event's.
        """
        asked = self.store.put(self.store.fresh("asked"), ids.select("node_id").where(F.col("node_id").isNotNull()).distinct())
        if not asked.where(F.col("node_id").startswith("RISK-") | F.col("node_id").startswith("SEQ-")).isEmpty():
            return self.nodes
        hosts = canonical.host_names(self.identity, self.firewall, self.endpoint)
        early = self.store.put(self.store.fresh("early_nodes"), graph.entity_nodes(self.identity, hosts, self.sessions, self.events))
        left = self.store.put(self.store.fresh("left"), asked.join(early.select("node_id"), "node_id", "left_anti"))
        return self.nodes if graph.holds_any(self.events, left) else early

    @cached_property
    def scenario_contexts(self) -> DataFrame:
        self.members
        scenes = self.store.put("scenarios", graph.scenarios(self.address_edges, self.risk_scores))
        targets = self.store.put("scenario_targets", scenes.select(F.col("target_entity").alias("entity_id")).distinct())
        return graph.scenario_contexts(scenes, self.nodes_at(targets), self.edges_at(targets), self.hypotheses)

    @cached_property
    def links(self) -> DataFrame:
        return graph.adjacency(self.edges, self.store, hashed_ids=True)

    # insights
    @cached_property
    def points(self) -> DataFrame:
        return self.user_risk.select(
            F.col("user_id").alias("entity_id"), "behavior_deviation_score", *insights.FEATURES)

    def cluster(self, k: int = 4, max_iter: int = 300, tol: float = 1e-5) -> DataFrame:
        numbered, count = insights.numbered_points(self.points, self.store)
        fit = insights.kmeans(numbered, insights.initial_centroids(numbered, count, k), max_iter, tol)
        return insights.assigned(numbered.drop("_row"), fit)

    @cached_property
    def clustered(self) -> DataFrame:
        return self.store.put("clustered", self.cluster())

    @cached_property
    def cluster_profiles(self) -> DataFrame:
        return self.store.put("cluster_profiles", insights.cluster_profiles(self.clustered, self.user_risk))

    @cached_property
    def user_clusters(self) -> DataFrame:
        return insights.user_clusters(self.clustered, self.cluster_profiles, self.identity, self.user_risk)

    @cached_property
    def outliers(self) -> DataFrame:
        return insights.user_outliers(self.user_risk).unionByName(insights.host_outliers(self.host_risk))

    @cached_property
    def peer_outliers(self) -> DataFrame:
        return insights.peer_outliers(self.user_risk)

    @cached_property
    def evidence_packages(self) -> DataFrame:
        edges = self.entity_edges
        return lookups.evidence_packages(
            self.risk_scores, lookups.behavior_profile(self.user_risk, self.user_clusters),
            lookups.peer_comparison(self.user_risk, self.peer_outliers), self.sequences, self.risk_evidence, edges)

    def export(self, folder: str, tables: tuple[str, ...] | None = None) -> DataFrame:
        """Write named tables below a folder, clean ones in their exported form; a report of rows and rules.

        Row rules of a table are counted while it is written, so that no table is read again.
        """
        done = {}
        for name in tables or EXPORTED:
            df = getattr(self, name)
            if name in CLEAN:
                df = clean.to_analytical(df, name)
            rules = suites.ROW_RULES[name]() if name in suites.ROW_RULES else []
            done[name] = suites.write_checked(df, f"{folder}/{name}", rules)
        return suites.write_report(self.spark, done)


CLEAN = ("identity", "iam", "endpoint", "firewall")
EXPORTED = (
    *CLEAN, "events", "users", "hosts", "sessions", "relationships", "user_features", "host_features", "session_features",
    "event_features", "user_baselines", "host_baselines", "user_risk", "host_risk", "risk_scores", "hypotheses", "risk_evidence",
    "exported_sequences", "bursts", "nodes", "edges", "user_clusters", "cluster_profiles", "outliers", "peer_outliers")


_OPEN: dict[tuple[str, str], Pipeline] = {}


def open_pipeline(spark: SparkSession, folder: str, fresh: bool = False) -> Pipeline:
    """The pipeline over a driver folder; one per session and folder."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if fresh or key not in _OPEN:
        name = f"{folder.strip('/').replace('/', '_')}_{len(_OPEN) if fresh else 0}"
        _OPEN[key] = Pipeline(spark, fixtures.raw_tables(spark, folder), TableStore(spark, name), folder)
    return _OPEN[key]
