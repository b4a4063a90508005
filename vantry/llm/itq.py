"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .components import components
from .simhash import Links

COSINE = 0.93
BITS = 64  # of a code, or the dimension where that is smaller
ERROR = 0.12  # share of bits that a pair at the threshold differs in at least: its angle over pi
MISS = 0.01  # chance that such a pair meets in no table
PAIRS = 4_000  # vectors of the sample from which pairs at the threshold are made
TABLES = 160  # tables beyond which slices get narrower instead
BUCKET = 64  # vectors that a bucket of the largest label is meant to hold
SAMPLE = 10_000  # vectors, by hash of the key, to which the rotation is fitted
ROUNDS = 50
BLOCK = 1_024  # vectors of one bucket that are compared in one piece


class Rotation:
    """Centre, principal directions and the learned rotation; codes are signs."""

    def __init__(self, x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 0):
        n, dim = x.shape
        self.bits = max(1, min(bits, dim))
        self.centre = x.mean(axis=0) if n else np.zeros(dim)
        y = x - self.centre
        _, vectors = np.linalg.eigh(y.T @ y)
        self.directions = vectors[:, ::-1][:, : self.bits]
        y = y @ self.directions
        turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.bits, self.bits)))
        for _ in range(rounds if n else 0):  # fixed signs, best rotation, in turn
            u, _, v = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
            turn = v.T @ u.T
        self.matrix = self.directions @ turn

    def codes(self, x: np.ndarray) -> np.ndarray:
        signs = ((x - self.centre) @ self.matrix) >= 0
        return np.packbits(np.pad(signs, ((0, 0), (0, 64 - self.bits))), axis=1, bitorder="little").view("<u8").ravel()


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def tables(largest: int, bits: int, miss: float = MISS) -> tuple[int, int]:
    """(width of a slice in bits, number of tables) for a label of ``largest`` vectors.

    Slices are as wide as fills buckets with BUCKET vectors; narrower ones would make
    comparisons grow with the square. The chance that a pair at the threshold agrees in a
    whole slice gives the number of tables that leave ``miss`` of such pairs where no
    mean is shared; ``fit`` goes on from there.
    """
    width = int(np.clip(np.ceil(np.log2(max(1, largest) / BUCKET)), 4, min(24, bits)))
    count = int(np.ceil(np.log(miss) / np.log1p(-((1 - ERROR) ** width))))
    return width, max(count, bits // width if bits // width < 2 * count else count)


def at_threshold(x: np.ndarray, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at exactly ``cosine``: x turned in random directions, and towards other vectors of x."""
    rng = np.random.default_rng(1)
    out = []
    for away in (rng.standard_normal(x.shape), x[rng.permutation(len(x))]):
        away = away - (away * x).sum(axis=1, keepdims=True) * x
        length = np.linalg.norm(away, axis=1, keepdims=True)
        ok = length[:, 0] > 1e-6
        if ok.any():
            out.append((x[ok], cosine * x[ok] + np.sqrt(max(0.0, 1 - cosine**2)) * away[ok] / length[ok]))
    return out


def cut_codes(codes: np.ndarray, width: int, each: int) -> np.ndarray:
    """``each`` slices of ``width`` bits of every code."""
    return np.column_stack([(codes >> np.uint64(k * width)) & np.uint64((1 << width) - 1) for k in range(each)])


def fit(x: np.ndarray, largest: int, bits: int = BITS, cosine: float = COSINE, miss: float = MISS, most: int = TABLES) -> tuple[int, int, list[Rotation]]:
    """(width of a slice, number of tables, rotations) that miss at most ``miss`` of the pairs at ``cosine``.

    Codes are signs of centred vectors, and where vectors share a mean a pair at the threshold
    differs in more bits than its angle tells. So pairs at the threshold are made from
    the sample and sent through the rotations, and tables are added until they
    meet. Slices that would need more than ``most`` tables get narrower; at width 0 all vectors of a label meet.
    """
    turns = [Rotation(x, bits)]
    bits = turns[0].bits
    width, least = tables(largest, bits, miss)
    pairs = at_threshold(x[:PAIRS], cosine)
    codes: list[list[tuple[np.ndarray, np.ndarray]]] = []
    while width:
        each, count = bits // width, 0
        apart = [np.ones(len(a), bool) for a, _ in pairs]
        while count < least or any(p.mean() > miss for p in apart):
            if count >= max(most, least):
                break
            at, k = divmod(count, each)
            if at == len(turns):
                turns.append(Rotation(x, bits, seed=at))
            if at == len(codes):
                codes.append([(turns[at].codes(a), turns[at].codes(b)) for a, b in pairs])
            mask = np.uint64(((1 << width) - 1) << (k * width))
            for p, (a, b) in zip(apart, codes[at]):
                p &= ((a ^ b) & mask) != 0
            count += 1
        if all(p.mean() <= miss for p in apart):
            return width, count, turns[: -(-count // each)]
        width, least = width - 1, 1
    return 0, 1, turns[:1]


def compare(one: bool, own: np.ndarray, keys: np.ndarray, copies: np.ndarray, x: np.ndarray, slices: np.ndarray, table: int, cosine: float) -> pd.DataFrame:
    """Rows (a, b, n): each linked vector, its root in the forest of links here, and the vectors linked to it.

    Rows are of ``one`` block (each pair once), or of two that ``own`` parts (pairs across). Pairs that met in an earlier table are left to it.
    """
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    left = np.arange(len(keys)) if one else np.flatnonzero(own)
    right = left if one else np.flatnonzero(~own)
    i, j = np.nonzero(x[left] @ x[right].T >= cosine)
    i, j = left[i], right[j]
    ok = (i < j) if one else np.ones(len(i), bool)
    if table:
        for at in range(0, len(i), 1 << 18):
            part = slice(at, at + (1 << 18))
            ok[part] &= ~(slices[i[part], :table] == slices[j[part], :table]).any(axis=1)
    i, j = i[ok], j[ok]
    counts = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
    joined = Links(len(keys))
    joined.add(i, j)
    at = np.flatnonzero(counts)
    return pd.DataFrame({"a": keys[at], "b": keys[joined.root(at)], "n": counts[at].astype(np.int64)})


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = COSINE, bits: int = BITS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per vector: (key, n_links, component_id, kept).

    Equal vectors of a label are one class with a count, so a vector repeated very often
    is compared once. The rotation is fitted to at most about ``2 * sample`` classes;
    every class is indexed. Each one goes to one bucket in every table, with its
    vector; buckets beyond ``block`` are cut into blocks by hash, and pairs of
    blocks are groups of their own, so that no bucket fills a task. Pairs are
    never written: a group returns, for each of its vectors, how many it is linked to and
    one link of a forest. Links are exact in double precision; what may be missed are
    pairs that differ in every slice (see ``MISS``).

    Null, zero and non-finite vectors, null components and null labels link with
    nothing and are kept; null keys link with equal vectors only; vectors of another length than most share one blocked
    bucket; rows with one key count as several vectors; an empty table gives an
    empty result; other columns are left out.
    """
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = F.coalesce(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("_k"), F.when(good, F.struct(F.col(label).alias("l"), F.xxhash64(vector).alias("g"), F.hash(vector).alias("f"))).alias("c"), F.col(vector).alias("x"))
    classes = cut(rows.where("c is not null").groupBy("c").agg(F.min("_k").alias("_k"), F.count("*").alias("n"), F.first("x").alias("x")))
    labels = classes.groupBy("c.l").agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    count, most = labels["all"] or 0, labels["most"] or 0
    step = max(1, count // sample)
    some = classes.where(F.pmod(F.xxhash64("_k"), F.lit(step)) == 0).select("_k", "x").limit(2 * sample).toPandas().sort_values("_k")
    sizes = some["x"].map(len)
    dim = int(sizes.mode().iloc[0]) if len(some) else 1
    fitted = _stack(some["x"][sizes == dim]) if len(some) else np.ones((1, 1))
    fitted /= np.linalg.norm(fitted, axis=1, keepdims=True)
    width, n_tables, turns = fit(fitted, most, bits, cosine)
    each = turns[0].bits // width if width else 1

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def slices_of(column: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(column), dtype=object)
        lengths = column.map(len)
        for size in lengths.unique():
            at = np.flatnonzero(lengths == size)
            if size != dim:
                found = np.full((len(at), 1), -int(size), np.int64)
            else:
                x = _stack(column.iloc[at])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = np.column_stack([cut_codes(t.codes(x), width, each) for t in turns])
                found = found[:, :n_tables].astype(np.int64)
            for i, row in zip(at.tolist(), found.tolist()):
                out.iloc[i] = row
        return out

    coded = cut(classes.where("_k is not null").select("_k", "c.l", "n", "x", slices_of("x").alias("s")))
    placed = coded.select("*", F.posexplode("s").alias("t", "h"))
    bucket = ["l", "t", "h"]
    busy = coded.select("l", F.posexplode("s").alias("t", "h")).groupBy(*bucket).agg(F.count("*").alias("m")).where(F.col("m") > block)
    busy = cut(busy.select(*bucket, F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    if busy.count() <= 20_000:
        busy = F.broadcast(busy)
    placed = placed.join(busy, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("_k", "t"), F.col("blocks")).cast("int")
    placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) < 2:
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        group = group.sort_values("_k")
        one = group["i"].iloc[0] == group["j"].iloc[0]
        own = (group["mine"] == group["i"]).to_numpy()
        return compare(bool(one), own, group["_k"].to_numpy(), group["n"].to_numpy(), _stack(group["x"]), np.stack(group["s"].to_numpy()), int(group["t"].iloc[0]), cosine)

    found = cut(placed.select("l", "t", "h", "i", "j", "mine", "_k", "n", "x", "s").groupBy("l", "t", "h", "i", "j").applyInPandas(search, "a long, b long, n long"))
    links = found.groupBy(F.col("a").alias("_k")).agg(F.sum("n").alias("links"))
    reached = components(found.select("a", "b")).select(F.col("node").alias("_k"), "component")
    by_class = classes.select("c", "_k", "n").join(links, "_k", "left").join(reached, "_k", "left").select(
        "c", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "_k").alias("component_id"))
    out = rows.select("_k", "c").join(by_class, "c", "left").select(
        F.col("_k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "_k").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
