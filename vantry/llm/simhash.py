"""SimHash near-dedup: fingerprints of word shingles, joined exactly through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut
from .components import components

WIDTH = 4  # words of a shingle
RADIUS = 4  # differing bits of a link
SEED = 42
# Slices of the 64 bits as (lowest bit, bits, radius). Of two fingerprints within
# RADIUS at least one slice lies within its own radius, as the radii plus one sum to
# RADIUS + 1; distances over a slice obey the triangle inequality like whole ones.
SLICES = [(0, 22, 1), (22, 21, 1), (43, 21, 0)]
SHARD_POINTS = 20_000  # fingerprints of a shard, about
SAMPLE = 4_096  # fingerprints that place the medians of the routing trees
BLOCK = 1 << 22  # pairs compared at once
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64-bit SimHash, signed: a bit is set if set in over half of the shingle hashes.

    Null, empty and blank texts have fingerprint zero. Memory beside the words is
    bounded, as hashes are counted in runs of 65,536.
    """
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total, counts = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for at in range(0, total, 65_536):
        pairs = zip(starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def as_hex(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


class Tree:
    """Routing tree of one slice: vantage points and median distances, in heap order."""

    def __init__(self, low: int, bits: int, radius: int, depth: int, sample: np.ndarray):
        self.low, self.mask, self.radius, self.depth = np.uint64(low), np.uint64((1 << bits) - 1), radius, depth
        self.points, self.medians = np.zeros(1 << depth, np.uint64), np.zeros(1 << depth, np.int64)
        self._build(1, 0, self.slice(sample), np.random.default_rng(low))

    def slice(self, values: np.ndarray) -> np.ndarray:
        return (values >> self.low) & self.mask

    def _build(self, node: int, level: int, sample: np.ndarray, rng) -> None:
        if level == self.depth:
            return
        point = rng.integers(0, int(self.mask) + 1, dtype=np.uint64)
        far = np.bitwise_count(sample ^ point).astype(np.int64)
        self.points[node], self.medians[node] = point, int(np.median(far)) if len(far) else int(self.mask).bit_count() // 2
        near = far <= self.medians[node]
        self._build(2 * node, level + 1, sample[near], rng)
        self._build(2 * node + 1, level + 1, sample[~near], rng)

    def route(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, rows, whether they live there): their own shard, and each whose ball the bounds can't exclude."""
        yield from self._down(1, 0, self.slice(values), np.arange(len(values)), np.ones(len(values), bool))

    def _down(self, node: int, level: int, slices: np.ndarray, rows: np.ndarray, home: np.ndarray):
        if not len(rows):
            return
        if level == self.depth:
            yield node, rows, home
            return
        far = np.bitwise_count(slices ^ self.points[node]).astype(np.int64)
        median = self.medians[node]
        for child, reach, inside in ((2 * node, far - self.radius <= median, far <= median), (2 * node + 1, far + self.radius > median, far > median)):
            yield from self._down(child, level + 1, slices[reach], rows[reach], home[reach] & inside[reach])


class Links:
    """A forest over positions: linked pairs join trees, roots are smallest positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[x]
            if np.array_equal(up, x):
                return x
            x = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            differ = a != b
            a, b = np.maximum(a, b)[differ], np.minimum(a, b)[differ]
            np.minimum.at(self.up, a, b)


def near_pairs(values: np.ndarray, points: np.ndarray, queries: np.ndarray, tree: tuple[int, int, int], links: Links, radius: int = RADIUS) -> None:
    """Link every query to every point within ``radius`` bits, by a vantage-point tree made on the way.

    ``points`` and ``queries`` are positions in ``values``. A node takes one of its
    points as vantage point and parts the others at the median distance over the
    slice; a query goes to each side that the triangle bound can't exclude. Small
    nodes, and those that no vantage point parts, are compared pair by pair in
    blocks of bounded memory.
    """
    low, bits, bound = tree
    mask = np.uint64((1 << bits) - 1)
    slices = (values >> np.uint64(low)) & mask
    rng = np.random.default_rng(len(points))
    stack = [(points, queries)]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        split = None
        if len(p) * len(q) > BLOCK // 64:
            for _ in range(6):
                point = slices[p[rng.integers(len(p))]]
                if bound:  # a point near the edge of the others parts them better than one among them
                    point = point ^ rng.integers(0, int(mask) + 1, dtype=np.uint64)
                far_p, far_q = (np.bitwise_count(slices[x] ^ point).astype(np.int64) for x in (p, q))
                for median in (int(np.median(far_p)), int(np.median(far_p)) - 1):
                    near_p, near_q, other_q = far_p <= median, far_q - bound <= median, far_q + bound > median
                    work = near_p.sum() * near_q.sum() + (~near_p).sum() * other_q.sum()
                    if work < 0.85 * len(p) * len(q) and (split is None or work < split[0]):
                        split = (work, (p[near_p], q[near_q]), (p[~near_p], q[other_q]))
                if split:
                    break
        if split:
            stack += split[1:]
            continue
        step = max(1, BLOCK // len(q))
        for at in range(0, len(p), step):
            part = p[at : at + step]
            i, j = np.nonzero(np.bitwise_count(values[part][:, None] ^ values[q][None, :]) <= radius)
            links.add(part[i], q[j])


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``radius`` bits, from distinct ``fp`` rows.

    Each slice has a routing tree over shards of about ``SHARD_POINTS``; its medians
    come from a sample of at most about ``SAMPLE`` fingerprints, its shards
    hold all. A shard returns a forest over its linked fingerprints, so never more rows
    than it was given, and no pairs are written.
    """
    count = prints.count()
    depth = max(0, int(np.ceil(np.log2(max(1, count) / SHARD_POINTS))))
    step = max(1, count // SAMPLE)
    sample = np.array([r.fp for r in prints.where(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)
    slices = SLICES
    trees = [Tree(*s, depth, sample) for s in slices]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            for k, tree in enumerate(trees):
                for shard, rows, home in tree.route(fp.view(np.uint64)):
                    yield pd.DataFrame({"tree": k, "shard": shard, "fp": fp[rows], "home": home})

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("fp", kind="stable")
        values, home = group["fp"].to_numpy(np.int64), group["home"].to_numpy(bool)
        links = Links(len(values))
        near_pairs(values.view(np.uint64), np.flatnonzero(home), np.arange(len(values)), slices[int(group["tree"].iloc[0])], links, radius)
        roots = links.root(np.arange(len(values)))
        moved = roots != np.arange(len(values))
        return pd.DataFrame({"a": values[moved], "b": values[roots[moved]]})

    routed = prints.mapInPandas(route, "tree int, shard int, fp long, home boolean")
    return routed.groupBy("tree", "shard").applyInPandas(search, "a long, b long")


def _components_of(classes: DataFrame) -> DataFrame:
    """(fp, first, c): distinct fingerprints with the smallest fingerprint reachable over links."""
    linked = components(near_links(classes.select("fp")))
    return classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, fp, component_id), the smallest key reachable over links.

    Equal fingerprints (equal texts, and blank ones with fingerprint zero) are one
    vertex, whatever their number; only distinct fingerprints are searched. Rows
    with the same key are one document; null keys never name a component while its
    documents have others; an empty table gives an empty result; other columns are left out.
    """
    prints = cut(docs.select(F.col(key).alias("_key"), fingerprints(F.col(text)).alias("fp")))
    named = _components_of(prints.groupBy("fp").agg(F.min("_key").alias("first")))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    table = named.select("fp", "c").join(least, "c").select("fp", "component_id")
    return prints.join(table, "fp").select(F.col("_key").alias(key), "fp", "component_id")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows under the smallest key of each component, all columns kept.

    Keys must name documents: rows of one key stay together, and rows with a null
    key are left out. ``one_of_each`` needs no such keys.
    """
    first = near_duplicates(docs, key, text).where(F.col(key) == F.col("component_id")).select(F.col(key)).distinct()
    return docs.join(first, key, "left_semi")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, exactly one row of each component, all columns kept.

    A row is named by its key, the hash of its text and that of all its columns. The
    row of the smallest key stays, null keys last, ties by the hashes; of rows equal in
    all that one stays. Null and repeated keys thus lose no text.
    """
    names = [F.col(key).alias("_k"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("_t"), F.xxhash64(*docs.columns).alias("_r")]
    prints = cut(docs.select(*names, fingerprints(F.col(text)).alias("fp")))
    order = F.struct(F.col("_k").isNull().alias("_n"), "_k", "_t", "_r")
    # rows of one name count together, and only names that several rows bear are grouped with their rows
    named = prints.groupBy("fp", "_k", "_t", "_r").agg(F.count("*").alias("m"))
    classes = named.groupBy("fp").agg(F.min(F.struct(order.alias("o"), "m")).alias("first"))
    first = cut(_components_of(classes).groupBy("c").agg(F.min("first").alias("first")).select("first.o._k", "first.o._t", "first.o._r", "first.m"))
    rows = docs.select(F.struct("*").alias("_row"), *[n.alias(f"_d{i}") for i, n in enumerate(names)])
    kept = rows.join(first, F.col("_d0").eqNullSafe(F.col("_k")) & (F.col("_d1") == F.col("_t")) & (F.col("_d2") == F.col("_r")))
    several = kept.where("m > 1").groupBy("_k", "_t", "_r").agg(F.first("_row").alias("_row"))
    return kept.where("m = 1").select("_row").union(several.select("_row")).select("_row.*")
