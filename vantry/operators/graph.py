"""Evidence graph: node and edge tables, neighbourhoods and shortest paths."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import TableStore, cut
from .ids import hash_id
from .joins import BROADCAST_ROWS, broadcast_if_small, one_row

# Column names of the exported tables, and edge types.
NODE_COLUMNS = ["node_id", "node_type", "label", "department", "status", "source_dataset", "source_record_id"]
EDGE_COLUMNS = [
    "edge_id", "source_id", "target_id", "relationship_type", "relationship_confidence", "source_dataset",
    "source_record_id", "evidence_type",
]
KEY = ["source_id", "target_id", "relationship_type"]
REPEATS = 2_000_000  # hashes of repeated keys that are broadcast
OF_EVIDENCE = ("SUPPORTED_BY_EVIDENCE", "SEQUENCE_INCLUDES_EVENT")  # from risk rows and sequences to events
EDGE_TYPES = [
    "BELONGS_TO", "ASSOCIATED_WITH_HOST", "TRIGGERED_EVENT", "AUTHENTICATED_VIA", "CONNECTED_FROM_IP",
    "COMMUNICATED_WITH_IP", "HAS_RISK_ASSESSMENT", "SUPPORTED_BY_EVIDENCE", "INVOLVED_IN_SEQUENCE",
    "SEQUENCE_INCLUDES_EVENT",
]


def _text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _first_of_key(df: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """One row per key, the least by the other columns in their order.

    A minimum of structs combines map-side, so a key with very many copies
    never reaches one task as rows. Without other columns the keys are only made distinct.
    """
    if not rest:
        return df.select(*keys).distinct()
    kept = F.min(F.struct(*rest)).alias("_r")
    return df.groupBy(*keys).agg(kept).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _first_where_repeated(df: DataFrame, keys: list[str], rest: list[str], most: int = REPEATS) -> DataFrame:
    """The rows of :func:`_first_of_key` where few keys repeat: a row whose hashed key no other row has stays where it is read.

    Hashes are dealt instead of rows. Those that repeat are broadcast, and rows that bear them are compared whole, so
    that hashes that collide lose nothing; beyond ``most`` all rows are compared.
    """
    key = F.xxhash64(*keys)
    repeated = cut(df.groupBy(key.alias("_r")).agg(F.count("*").alias("_n")).where("_n > 1").select("_r"))
    if repeated.count() > most:
        return _first_of_key(df, keys, rest)
    met = df.withColumn("_h", key).join(F.broadcast(repeated), F.col("_h") == F.col("_r"), "left")
    again = df.withColumn("_h", key).join(F.broadcast(repeated), F.col("_h") == F.col("_r"), "left_semi")
    return met.where(F.col("_r").isNull()).select(*keys, *rest).unionByName(_first_of_key(again, keys, rest))


def graph_nodes(
    users: DataFrame, hosts: DataFrame, sessions: DataFrame, events: DataFrame, risk: DataFrame,
    sequences: DataFrame, sequence_evidence: DataFrame, risk_evidence: DataFrame,
) -> DataFrame:
    """Nodes of eight types; an id claimed by two types goes to the earlier one."""
    earlier = entity_nodes(users, hosts, sessions, events, risk, sequences)
    return earlier.unionByName(event_nodes(events, cited_ids(risk_evidence, sequence_evidence), earlier))


def cited_ids(*evidence: DataFrame) -> DataFrame:
    """Ids of the events that are nodes, repeats included."""
    return reduce(DataFrame.union, [df.select("event_id") for df in evidence])


def _nodes(df, rank, node_id, kind, label, department, status, source, record) -> DataFrame:
    values = [node_id, kind, label, department, status, source, record]
    return df.select(F.lit(rank).alias("_rank"), *[_text(v).alias(n) for n, v in zip(NODE_COLUMNS, values)])


def entity_nodes(
    users: DataFrame, hosts: DataFrame, sessions: DataFrame, events: DataFrame, risk: DataFrame | None = None,
    sequences: DataFrame | None = None,
) -> DataFrame:
    """Nodes of the seven types before events; no evidence is read. Without risk rows or sequences their types are left out."""
    unknown, nodes = F.lit("Unknown"), _nodes
    c = F.col
    text_of = lambda name: F.coalesce(c(name), unknown)
    departments = users.select(F.coalesce("department", unknown).alias("department")).distinct()
    addresses = (
        events.select(c("source_ip").alias("ip")).distinct()
        .union(events.select(c("destination_ip").alias("ip")).distinct())
        .where(c("ip").isNotNull()).distinct()
    )
    ip_node = F.concat(F.lit("IP-"), c("ip"))
    parts = [
        nodes(users, 0, c("user_id"), "USER", text_of("username"), text_of("department"), text_of("status"),
              "canonical_users", c("user_id")),
        nodes(departments, 1, text.department_node(c("department")), "DEPARTMENT", c("department"), c("department"),
              "Active", "canonical_users", F.concat(F.lit("DEPT-"), c("department"))),
        nodes(hosts, 2, c("hostname"), "HOST", c("hostname"), unknown,
              F.when(c("is_managed"), "Managed").otherwise("Unmanaged"), "canonical_hosts", c("hostname")),
        nodes(addresses, 3, ip_node, "IP", c("ip"), unknown, "Active", "canonical_events", ip_node),
        nodes(sessions, 4, c("session_id"), "SESSION", c("session_id"), unknown, "Active", "canonical_sessions",
              c("session_id")),
    ]
    if risk is not None:
        parts.append(nodes(risk, 5, F.concat(F.lit("RISK-"), c("entity_id")), "RISK_ASSESSMENT",
              F.concat(F.lit("Risk: "), c("risk_score").cast("string"), F.lit(" ("), c("risk_level"), F.lit(")")),
              c("department"), c("risk_level"), "risk_scores", c("entity_id")))
    if sequences is not None:
        parts.append(nodes(sequences, 6, c("sequence_id"), "TEMPORAL_SEQUENCE",
              F.concat(c("sequence_type"), F.lit(" (Strength: "), c("sequence_strength").cast("string"), F.lit(")")),
              unknown, "Detected", "temporal_sequences", c("sequence_id")))
    rows = reduce(DataFrame.unionByName, parts).where(c("node_id").isNotNull())
    return _first_of_key(rows, ["node_id"], ["_rank", *NODE_COLUMNS[1:]]).select(*NODE_COLUMNS)


def event_nodes(events: DataFrame, cited: DataFrame, earlier: DataFrame) -> DataFrame:
    """Cited events (column event_id) that are no node of an earlier type.

    They are by far the most nodes and are dealt by id once, for the citations, the choice of one row an id
    and the ids that an earlier type holds.
    """
    c, unknown = F.col, F.lit("Unknown")
    shown = _nodes(
        events.where(c("event_id").isNotNull()).join(cited, "event_id", "left_semi"), 7, c("event_id"), "EVENT",
        F.concat(c("event_category"), F.lit(": "), c("action")), F.coalesce(c("department"), unknown),
        F.coalesce(c("severity"), unknown), c("source_dataset"), c("source_record_id"))
    own = _first_of_key(shown, ["node_id"], NODE_COLUMNS[2:]).withColumn("node_type", F.lit("EVENT"))
    return own.join(earlier.select("node_id"), "node_id", "left_anti").select(*NODE_COLUMNS)


class EdgeType(NamedTuple):
    """How the edges of one type are made.

    ``columns`` are those that an edge does not take from its key or its type; of edges with one key the
    least by them stays. ``open_ends`` are ends that need not be nodes; the others are nodes by the way
    :func:`graph_nodes` makes them of the same tables. ``few_repeats`` says that a key seldom has two rows.
    """

    rows: Callable[[], DataFrame]
    source: Column
    target: Column
    columns: dict[str, Column]
    fixed: dict[str, Column]
    open_ends: tuple[str, ...] = ()
    few_repeats: bool = False


def edge_types(
    users: Callable, relationships: Callable, events: Callable, risk: Callable, sequences: Callable,
    sequence_evidence: Callable, risk_evidence: Callable,
) -> dict[str, EdgeType]:
    """The ten types of edges by name. Tables are functions, so that a type asks only for those it reads."""
    c, lit = F.col, F.lit
    risk_node = F.concat(lit("RISK-"), c("entity_id"))
    department = text.department_node(F.coalesce(c("department"), lit("Unknown")))
    address = lambda name: F.concat(lit("IP-"), c(name))
    rel = lambda kind: lambda: relationships().where(c("target_type") == kind)
    sessions = lambda: events().where((c("source_dataset") == "IAM") & c("session_id").isNotNull())
    flows = lambda: events().where(c("event_category") == "NETWORK_FLOW")
    record, source, target = c("source_record_id"), c("source_id"), c("target_id")
    told = {"relationship_confidence": c("confidence"), "source_dataset": c("provenance")}
    cited = {"source_dataset": c("source_dataset"), "source_record_id": record}

    def fixed(evidence: str, dataset: str = "", own: Column | None = None, exact: bool = True) -> dict[str, Column]:
        out = {"evidence_type": lit(evidence)} | ({"relationship_confidence": lit("EXACT")} if exact else {})
        return out | ({"source_dataset": lit(dataset)} if dataset else {}) | ({} if own is None else {"source_record_id": own})

    seen = {"source_record_id": record}
    return {
        "BELONGS_TO": EdgeType(users, c("user_id"), department, {}, fixed("ORGANIZATIONAL_ASSIGNMENT", "canonical_users", source)),
        "ASSOCIATED_WITH_HOST": EdgeType(
            rel("HOST"), c("source_node"), c("target_node"), told, fixed("TELEMETRY_ASSOCIATION", own=source, exact=False)),
        "TRIGGERED_EVENT": EdgeType(
            rel("ALERT"), c("source_node"), c("target_node"), told, fixed("TELEMETRY_ASSOCIATION", own=target, exact=False),
            ("source_id", "target_id")),
        "AUTHENTICATED_VIA": EdgeType(
            sessions, c("user_id"), c("session_id"), seen, fixed("IAM_SESSION_ESTABLISHMENT", "canonical_events"), ("source_id",)),
        "CONNECTED_FROM_IP": EdgeType(
            sessions, c("session_id"), address("source_ip"), seen, fixed("NETWORK_ORIGIN_IP", "canonical_events")),
        "COMMUNICATED_WITH_IP": EdgeType(
            flows, c("hostname"), address("destination_ip"), seen, fixed("FIREWALL_NETWORK_FLOW", "canonical_events")),
        "HAS_RISK_ASSESSMENT": EdgeType(
            risk, c("entity_id"), risk_node, {}, fixed("EXPLAINABLE_RISK_EVALUATION", "risk_scores", source)),
        "SUPPORTED_BY_EVIDENCE": EdgeType(
            risk_evidence, risk_node, c("event_id"), cited, fixed("FLAGGED_ANOMALY_EVIDENCE"), few_repeats=True),
        "INVOLVED_IN_SEQUENCE": EdgeType(
            sequences, c("entity_id"), c("sequence_id"), {}, fixed("CHRONOLOGICAL_SEQUENCE_MEMBER", "temporal_sequences", target),
            ("source_id",)),
        "SEQUENCE_INCLUDES_EVENT": EdgeType(
            sequence_evidence, c("sequence_id"), c("event_id"), cited, fixed("SEQUENCE_EVENT_STEP"), few_repeats=True),
    }


def typed_rows(
    kind: EdgeType, nodes: Callable[[], DataFrame], at: DataFrame | None = None, ends: Callable | None = None
) -> DataFrame:
    """Edges of one type, unique per source and target, ends present; key and own columns only.

    The node table is asked for only where an end is open, and not at all if ``ends`` takes its place
    (see :func:`with_open_ends`). ``at`` (column entity_id, few rows, broadcast) keeps the edges at these
    nodes before anything is shuffled.
    """
    rows = kind.rows().select(kind.source.alias("source_id"), kind.target.alias("target_id"), *[v.alias(n) for n, v in kind.columns.items()])
    rows = rows.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    if at is not None:
        some = [F.broadcast(at.select(F.col("entity_id").alias(end))) for end in ("source_id", "target_id")]
        rows = rows.join(some[0], "source_id", "left_semi").unionByName(rows.join(some[1], "target_id", "left_semi"))
    first = _first_where_repeated if kind.few_repeats and at is None else _first_of_key
    unique = first(rows, ["source_id", "target_id"], list(kind.columns))
    if ends is not None:
        return ends(unique, kind.open_ends)
    return with_ends(unique, nodes(), kind.open_ends) if kind.open_ends else unique


def typed_edges(rows: DataFrame, name: str, kind: EdgeType) -> DataFrame:
    """All columns of the edges of one type; what follows from the key or the type is not stored."""
    full = rows.withColumns({"relationship_type": F.lit(name), **kind.fixed})
    return full.withColumn("edge_id", hash_id("EDG-", *KEY)).select(*EDGE_COLUMNS)


def graph_edges(
    nodes: DataFrame, users: DataFrame, relationships: DataFrame, events: DataFrame, risk: DataFrame,
    sequences: DataFrame, sequence_evidence: DataFrame, risk_evidence: DataFrame,
) -> DataFrame:
    """Edges of ten types, unique per (source, target, type), ends present in the nodes of the same tables."""
    tables = [(lambda df=df: df) for df in (users, relationships, events, risk, sequences, sequence_evidence, risk_evidence)]
    return reduce(DataFrame.unionByName, [
        typed_edges(typed_rows(kind, lambda: nodes), name, kind) for name, kind in edge_types(*tables).items()])


def with_ends(edges: DataFrame, nodes: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    for end in ends:
        edges = edges.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    return edges


def with_open_ends(
    edges: DataFrame, ends: tuple[str, ...], entities: DataFrame, event_ids: DataFrame, cited: Callable[[], DataFrame], store: TableStore
) -> DataFrame:
    """Edges whose open ends are nodes, of which ``entities`` are those before events.

    The citations, for which all windows are needed, are asked for only if an end that is no entity
    can be an event. Ids outside the least and the greatest end in question meet none and are left out
    before they are dealt.
    """
    for end in ends:
        asked = edges.select(F.col(end).alias("node_id")).distinct()
        ids = asked.join(entities.select("node_id"), "node_id", "left_anti")
        left = store.put(store.fresh("open_ends"), ids)
        nodes = entities.select("node_id")
        low, high, n = left.agg(F.min("node_id"), F.max("node_id"), F.count("*")).first()
        many = n > BROADCAST_ROWS
        if n and (many or holds_any(event_ids, left)):
            held = cited().select(F.col("event_id").alias("node_id")).where(F.col("node_id").between(low, high))
            nodes = nodes.union(held if many else held.join(F.broadcast(left), "node_id", "left_semi"))
        edges = with_ends(edges, nodes, (end,))
    return edges


def holds_any(event_ids: DataFrame, ids: DataFrame) -> bool:
    """Whether one of the written ids (column node_id) is an event id."""
    asked = broadcast_if_small(ids.select(F.col("node_id").alias("event_id")), written=True)
    return not event_ids.select("event_id").join(asked, "event_id", "left_semi").isEmpty()


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    return with_ends(edges, nodes, ("source_id", "target_id"))


def graph_metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals and counts per type in long form."""
    by_type = nodes.groupBy(F.col("node_type").alias("name")).agg(F.count("*").alias("n"))
    by_rel = edges.groupBy(F.col("relationship_type").alias("name")).agg(F.count("*").alias("n"))
    part = lambda df, kind: df.select(F.lit(kind).alias("section"), "name", "n")
    totals = [
        by_type.agg(F.sum("n").alias("n")).select(F.lit("total").alias("section"), F.lit("nodes").alias("name"), "n"),
        by_rel.agg(F.sum("n").alias("n")).select(F.lit("total").alias("section"), F.lit("edges").alias("name"), "n"),
    ]
    return reduce(DataFrame.unionByName, [part(by_type, "node"), part(by_rel, "edge"), *totals])


# --- lookups -----------------------------------------------------------------------


def lookup_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Attributes for a table of ids (column node_id); unknown ids get defaults."""
    default = {"node_type": "UNKNOWN", "label": "NO_VERIFIED_RELATIONSHIP", "department": "Unknown", "status": "Unknown"}
    found = ids.select("node_id").distinct().join(nodes, "node_id", "left")
    return found.select("node_id", *[F.coalesce(F.col(n), F.lit(v)).alias(n) for n, v in default.items()])


def connections(edges: DataFrame, entity_id: str) -> DataFrame:
    """Edges that touch an entity, with the direction seen from it."""
    side = lambda end, name, other: edges.where(F.col(end) == entity_id).select(
        F.lit(name).alias("direction"), F.col(other).alias("neighbor"), "relationship_type", "edge_id")
    return side("source_id", "outbound", "target_id").unionByName(side("target_id", "inbound", "source_id"))


def typed_targets(edges: DataFrame, kind: str, sources: DataFrame | None = None, strip: str = "") -> DataFrame:
    """(entity, neighbour) over one edge type, for some entities or for all."""
    df = edges.where(F.col("relationship_type") == kind)
    if sources is not None:
        df = df.join(sources.select(F.col("entity_id").alias("source_id")), "source_id", "left_semi")
    target = text.drop_prefix(F.col("target_id"), strip) if strip else F.col("target_id")
    return df.select(F.col("source_id").alias("entity_id"), target.alias("neighbor"))


def shared_addresses(edges: DataFrame, address: str | None = None) -> DataFrame:
    """Entities per IP address as rows, each with the size of its group.

    Members stay rows, so an address used by everybody is no single huge list.
    """
    df = edges.where(F.col("target_id").startswith("IP-"))
    if address is not None:
        df = df.where(F.col("target_id") == (address if address.startswith("IP-") else f"IP-{address}"))
    df = df.select(text.drop_prefix(F.col("target_id"), "IP-").alias("ip_address"), F.col("source_id").alias("entity_id"))
    sizes = df.groupBy("ip_address").agg(F.count("*").alias("connected_entities_count"))
    return df.join(sizes, "ip_address")


def degrees(edges: DataFrame, kind: str, end: str = "target_id") -> DataFrame:
    """Distinct neighbours per node over one edge type."""
    other = "source_id" if end == "target_id" else "target_id"
    return edges.where(F.col("relationship_type") == kind).groupBy(F.col(end).alias("node_id")).agg(
        F.count_distinct(other).alias("neighbors"))


def risk_evidence_of(edges: DataFrame, risk: DataFrame, entity_id: str) -> DataFrame:
    """Risk row of an entity next to each supporting event (one row if none)."""
    support = edges.where(
        (F.col("relationship_type") == "SUPPORTED_BY_EVIDENCE") & (F.col("source_id") == f"RISK-{entity_id}")
    ).select(text.drop_prefix(F.col("source_id"), "RISK-").alias("entity_id"), F.col("target_id").alias("event_id"))
    own = risk.where(F.col("entity_id") == entity_id).select("entity_id", "risk_score", "risk_level")
    return own.join(support, "entity_id", "left")


# --- traversal ------------------------------------------------------------------------


BUCKETS = 64  # folders of the stored adjacency


def bucket_of(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int")


def adjacency(edges: DataFrame, store: TableStore, name: str = "adjacency", hashed_ids: bool = False) -> DataFrame:
    """Every edge at both of its ends (bucket, node, neighbor, edge columns), stored by bucket of the node.

    A search reads only the folders of the nodes it stands on, and within them only the row groups that can hold
    these nodes, as rows are ordered by node. The rebalancing hint splits the folder of a node with very many edges.
    ``hashed_ids`` says that the ids are those of :func:`typed_edges`, which follow from the key and are not stored.
    """
    c = F.col
    kept = [n for n in ("relationship_type", "edge_id") if n in edges.columns and not (hashed_ids and n == "edge_id")]
    both = F.array(
        F.struct(c("source_id").alias("node"), c("target_id").alias("neighbor"), F.lit(True).alias("outward")),
        F.struct(c("target_id").alias("node"), c("source_id").alias("neighbor"), F.lit(False).alias("outward")))
    rows = edges.select(F.explode(both).alias("_e"), *kept)
    rows = rows.select(bucket_of(c("_e.node")).alias("bucket"), "_e.*", *kept)
    table = store.put(name, rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "node"), partition_by=["bucket"])
    table = table.withColumns({
        "source_id": F.when(c("outward"), c("node")).otherwise(c("neighbor")), "target_id": F.when(c("outward"), c("neighbor")).otherwise(c("node"))})
    if hashed_ids:
        table = table.withColumn("edge_id", hash_id("EDG-", *KEY))
    return table.drop("outward")


def at_nodes(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored edges at a written table of nodes (column node_id); one scan, of the folders that hold them."""
    held = [r[0] for r in nodes.select(bucket_of(F.col("node_id"))).distinct().collect()]  # at most BUCKETS numbers
    some = links.where(F.col("bucket").isin(held)) if len(held) < BUCKETS else links
    return some.join(broadcast_if_small(nodes.select(F.col("node_id").alias("node")), written=True), "node")


class _Levels:
    """Breadth-first levels from one node, each written to the store."""

    def __init__(self, links: DataFrame, root: str, store: TableStore, name: str):
        self.links, self.store, self.name = links, store, name
        start = links.sparkSession.range(1).select(F.lit(root).alias("node_id"))
        self.tables = [store.put(f"{name}_0", start)]

    def grow(self) -> bool:
        reached = at_nodes(self.links, self.tables[-1]).select(F.col("neighbor").alias("node_id")).distinct()
        # an undirected search can only meet the last two levels again
        for seen in self.tables[-2:]:
            reached = reached.join(seen, "node_id", "left_anti")
        table = self.store.put(f"{self.name}_{len(self.tables)}", reached)
        if table.isEmpty():
            return False
        self.tables.append(table)
        return True

    def reached(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [
            t.select("node_id", F.lit(d).cast("bigint").alias("depth")) for d, t in enumerate(self.tables)])


def neighborhood(edges: DataFrame, root: str, max_hops: int, store: TableStore, links: DataFrame | None = None) -> DataFrame:
    """Nodes within ``max_hops`` of a node, with their depth; ``links`` is the stored adjacency of the edges."""
    links = adjacency(edges, store, store.fresh("adjacency")) if links is None else links
    levels = _Levels(links, root, store, store.fresh("hop"))
    for _ in range(max_hops):
        if not levels.grow():
            break
    return levels.reached()


def neighborhood_edges(links: DataFrame, hood: DataFrame, max_hops: int, store: TableStore) -> DataFrame:
    """Edges of a neighbourhood: those at a node that was expanded, each once."""
    inner = store.put(store.fresh("inner"), hood.where(F.col("depth") < max_hops).select("node_id"))
    return at_nodes(links, inner).select("edge_id", "source_id", "target_id", "relationship_type").distinct()


def neighborhood_summary(edges: DataFrame, hood: DataFrame, root: str, max_hops: int, links: DataFrame | None = None) -> DataFrame:
    """Node count and edge counts of a neighbourhood.

    ``edge_count`` counts an edge once per expanded end; ``distinct_edge_count``
    counts it once.
    """
    inner = hood.where(F.col("depth") < max_hops).select(F.col("node_id").alias("node"))
    if links is None:
        links = edges.select("edge_id", F.explode(F.array("source_id", "target_id")).alias("node"))
    hits = links.select("edge_id", "node").join(inner, "node").groupBy("edge_id").agg(F.count("*").alias("n"))
    counts = hits.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("edge_count"), F.count("*").alias("distinct_edge_count"))
    size = hood.agg(F.count("*").alias("node_count"))
    return one_row([size, counts]).select(
        F.lit(root).alias("root_entity"), F.lit(max_hops).cast("bigint").alias("max_hops"), "node_count", "edge_count",
        "distinct_edge_count")


def shortest_path(edges: DataFrame, source: str, target: str, store: TableStore, links: DataFrame | None = None) -> DataFrame:
    """Rows (step, node_id) of the path of fewest hops, smallest by node ids; none if there is no path.

    Levels grow from both ends, the smaller side first, until they meet. The source's
    levels are then narrowed, from the meeting level back, to nodes on shortest paths, and the
    path goes from the source to the smallest neighbour that is one hop closer. Each hop reads the
    folders of its nodes once; the driver holds the path itself and the numbers of levels.
    """
    spark = edges.sparkSession
    links = adjacency(edges, store, store.fresh("adjacency")) if links is None else links
    sides = [_Levels(links, end, store, store.fresh("path")) for end in (source, target)]
    while (meeting := sides[0].tables[-1].join(sides[1].tables[-1], "node_id", "left_semi")).isEmpty():
        if not min(sides, key=lambda s: s.tables[-1].count()).grow():
            return spark.createDataFrame([], "step long, node_id string")
    ahead = [store.put(store.fresh("path_on"), meeting)]
    for level in reversed(sides[0].tables[1:-1]):
        near = at_nodes(links, ahead[0]).select(F.col("neighbor").alias("node_id"))
        ahead.insert(0, store.put(store.fresh("path_on"), level.join(near, "node_id", "left_semi")))
    if len(sides[0].tables) == 1:
        ahead = []
    path = [source]
    for level in [*ahead, *reversed(sides[1].tables[:-1])]:
        here = F.lit(path[-1])
        near = links.where((F.col("bucket") == _bucket(spark, path[-1])) & (F.col("node") == here)).select(F.col("neighbor").alias("node_id"))
        path.append(near.join(level, "node_id", "left_semi").agg(F.min("node_id")).first()[0])
    return spark.createDataFrame(list(enumerate(path)), "step long, node_id string")


def _bucket(spark, node: str) -> int:
    return spark.range(1).select(bucket_of(F.lit(node))).first()[0]


# --- investigation context --------------------------------------------------------------


def investigation_context(nodes: DataFrame, edges: DataFrame, hypotheses: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per requested entity (column entity_id): attributes and counts.

    Lists of sequences and events stay in :func:`context_items`, so an entity
    with very many of them is no single row.
    """
    ids = entities.select("entity_id").distinct()
    attr = lookup_nodes(nodes, ids.select(F.col("entity_id").alias("node_id"))).withColumnRenamed("node_id", "entity_id")
    tally = lambda end, name: edges.join(
        ids.select(F.col("entity_id").alias(end)), end, "left_semi"
    ).groupBy(F.col(end).alias("entity_id")).agg(F.count("*").alias(name))
    hyp = hypotheses.select("entity_id", "hypothesis", "risk_score")
    return (
        attr.join(hyp, "entity_id", "left")
        .join(tally("source_id", "outbound_count"), "entity_id", "left")
        .join(tally("target_id", "inbound_count"), "entity_id", "left")
        .fillna(0, ["outbound_count", "inbound_count"])
        .withColumns({
            "hypothesis": F.coalesce("hypothesis", F.lit("NO_ACTIONABLE_HYPOTHESIS")),
            "investigation_readiness": F.lit("READY"),
        })
        .withColumnRenamed("node_type", "entity_type")
    )


def context_items(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Sequences and supporting events of entities, one row each."""
    ids = entities.select("entity_id").distinct()
    own = typed_targets(edges, "INVOLVED_IN_SEQUENCE", ids).select(
        "entity_id", F.lit("sequence").alias("item_type"), F.col("neighbor").alias("item_id"))
    risk_ids = ids.select(F.concat(F.lit("RISK-"), "entity_id").alias("entity_id"))
    events = typed_targets(edges, "SUPPORTED_BY_EVIDENCE", risk_ids).select(
        text.drop_prefix(F.col("entity_id"), "RISK-").alias("entity_id"), F.lit("event").alias("item_type"),
        F.col("neighbor").alias("item_id"))
    return own.unionByName(events)


def scenarios(edges: DataFrame, risk: DataFrame) -> DataFrame:
    """Targets of four standard investigations, chosen from the data.

    Top user, top host, an address the top host talks to (else any address) and
    a sequence of the top user (else of the riskiest entity that has one). Every
    choice is one ranked row of a frame; nothing is fetched.
    """

    def top(kind: str) -> DataFrame:
        return risk.where(F.col("entity_type") == kind).orderBy(F.desc("risk_score"), "entity_id").limit(1).select("entity_id")

    def scenario(n: int, title: str, chosen: DataFrame) -> DataFrame:
        return chosen.select(F.lit(f"SCENARIO-{n:02d}").alias("scenario_id"), F.lit(title).alias("title"), F.col("entity_id").alias("target_entity"))

    flows = edges.where(F.col("relationship_type") == "COMMUNICATED_WITH_IP").select("source_id", F.col("target_id").alias("address"))
    near = flows.join(F.broadcast(top("HOST")), F.col("source_id") == F.col("entity_id")).select(F.lit(0).alias("o"), "address")
    known = edges.where(F.col("target_id").startswith("IP-")).select(F.lit(1).alias("o"), F.col("target_id").alias("address"))
    address = near.unionByName(known).agg(F.min(F.struct("o", "address")).alias("x")).where("x is not null").select(F.col("x.address").alias("entity_id"))
    involved = edges.where(F.col("relationship_type") == "INVOLVED_IN_SEQUENCE").select(F.col("source_id").alias("entity_id"), "target_id")
    ranked = involved.join(risk.select("entity_id", "risk_score"), "entity_id").join(
        F.broadcast(top("USER").withColumn("first", F.lit(0))), "entity_id", "left")
    sequence = ranked.orderBy(F.coalesce("first", F.lit(1)), F.desc("risk_score"), "entity_id", "target_id").limit(1)
    return reduce(DataFrame.unionByName, [
        scenario(1, "Highest Risk User Investigation", top("USER")),
        scenario(2, "High Risk Host Endpoint & Network Investigation", top("HOST")),
        scenario(3, "Shared Infrastructure IP Investigation", address),
        scenario(4, "Temporal Sequence Event Chain Investigation", sequence.select(F.col("target_id").alias("entity_id"))),
    ])


def scenario_contexts(scenes: DataFrame, nodes: DataFrame, edges: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """The scenarios with the investigation context of their targets."""
    wanted = scenes.select(F.col("target_entity").alias("entity_id"))
    context = investigation_context(nodes, edges, hypotheses, wanted)
    return scenes.join(context, F.col("target_entity") == F.col("entity_id"), "left").drop("entity_id")
