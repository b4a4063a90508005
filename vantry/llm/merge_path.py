"""Cross-tokenizer alignment by merge paths.

The token ends of tokenizers A and B in the same bytes are two sorted lists. Diagonals of
their merge matrix, found by binary search, cut the merging into pieces of equally
many steps that need nothing of each other. Pieces emit the token pairs that overlap;
groups open at a piece's edge are stitched to those of the piece before.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import by_bytes, cut

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
STEPS = 64  # merge steps of one piece
BATCH = 2_000_000  # bytes of text aligned together, about
# Fixed value: the pattern that byte-level tokenizers of this kind split texts by.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letters() -> dict[str, int]:
    """Byte of each letter of byte-level vocabularies: visible bytes stand for themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the texts of ids for digests."""

    def __init__(self, a_json: bytes, b_model: bytes):
        self.slow = Tokenizer.from_str(a_json.decode())
        self.slow.encode_special_tokens = True
        letters = _letters()
        vocabulary = {t: i for t, i in json.loads(a_json)["model"]["vocab"].items() if all(c in letters for c in t)}
        self.a = [b""] * self.slow.get_vocab_size()
        for token, i in vocabulary.items():
            self.a[i] = bytes(letters[c] for c in token)
        special = {i for i, t in self.slow.get_added_tokens_decoder().items() if t.special}
        ranks = {x: i for i, x in enumerate(self.a) if x and i not in special}
        # ids in the order of merges serve as ranks, with the same result and less time
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if _in_merge_order(a_json, letters, ranks) else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b = [
            bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size()))]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a, self.b))
        # ids with the sign that follows them in a digest: more of a group, or its end
        self.signed = [f"{i}{sign}".encode() for sign, n in ((",", len(self.a)), ("|", len(self.a)), (",", len(self.b)), (";", len(self.b))) for i in range(n)]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.fast is not None:
            try:
                return [self.fast.encode_ordinary(t) for t in texts]
            except (ValueError, RuntimeError):  # patterns beyond the limits of the quick encoder
                pass
        return [e.ids for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)


def _in_merge_order(a_json: bytes, letters: dict[str, int], ranks: dict[bytes, int]) -> bool:
    model = json.loads(a_json)["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [ranks.get(bytes(letters[c] for c in x + y)) for x, y in pairs]
    return None not in made and made == sorted(made)


@functools.lru_cache(maxsize=2)
def load(a_json: bytes, b_model: bytes) -> Tokenizers:
    return Tokenizers(a_json, b_model)


class Cuts(NamedTuple):
    a: np.ndarray
    b: np.ndarray


def cuts(a: np.ndarray, b: np.ndarray, steps: int) -> Cuts:
    """Where the diagonals 0, steps, 2 steps, ... cross the merge path: ends of A and of B before each.

    All binary searches run side by side. Of equal ends that of A comes first.
    """
    d = np.arange(0, len(a) + len(b), steps)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        before = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - 1 - mid, 0, len(b) - 1)])
        low, high = np.where(before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return Cuts(low, d - low)


class Merged(NamedTuple):
    a: np.ndarray  # token of A of each overlap, in text order
    b: np.ndarray
    group: np.ndarray
    ends: np.ndarray  # whether both tokens of the overlap end together


def merge(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> Merged:
    """Overlapping token pairs of two lists of ends over the same bytes, and their groups.

    Pieces advance in lockstep, one merge step of every piece at a time.
    """
    at = cuts(a, b, steps)
    i, j = at.a.copy(), at.b.copy()
    i_stop, j_stop = np.append(at.a[1:], len(a)), np.append(at.b[1:], len(b))
    far = np.iinfo(np.int64).max
    starts_a, starts_b = np.concatenate([[0], a]), np.concatenate([[0], b])
    ends_a, ends_b = np.append(a, far), np.append(b, far)
    shape = (steps, len(i))
    left, right = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    met, tied = np.zeros(shape, bool), np.zeros(shape, bool)
    for step in range(steps):
        alive = (i < i_stop) | (j < j_stop)
        end_a, end_b = ends_a[i], ends_b[j]
        first = end_a <= end_b
        left[step], right[step] = i, j
        met[step] = alive & (np.maximum(starts_a[i], starts_b[j]) < np.minimum(end_a, end_b))
        tied[step] = alive & (end_a == end_b)
        i += alive & first
        j += alive & ~first
    # groups are numbered within each piece, then by the groups that ended before the piece
    left, right, met, tied = left.T, right.T, met.T, tied.T
    closed = np.cumsum(tied, axis=1)
    before = np.concatenate([[0], np.cumsum(closed[:, -1])[:-1]]) if len(closed) else np.zeros(0, np.int64)
    group = before[:, None] + closed - tied
    return Merged(left[met], right[met], group[met], tied[met])


class Aligned(NamedTuple):
    """Tokens of several texts, laid end to end, and their groups."""

    used: list[bool]  # texts that both tokenizers give back byte by byte
    a_counts: np.ndarray
    b_counts: np.ndarray
    a: np.ndarray
    b: np.ndarray
    merged: Merged


def align_texts(use: Tokenizers, texts: list[str | None], steps: int = STEPS) -> Aligned:
    given = [t or "" for t in texts]
    found_a, found_b = use.encode_a([" " + t for t in given]), use.encode_b(given)
    used = []
    for k, t in enumerate(given):
        raw = b" " + t.encode("utf-8", "surrogatepass")
        fits = bool(t) and b"".join(map(use.a.__getitem__, found_a[k])) == raw == b"".join(map(use.b.__getitem__, found_b[k]))
        used.append(fits)
        if not fits:
            found_a[k], found_b[k] = [], []
    a, b = (np.fromiter((i for ids in found for i in ids), np.int64) for found in (found_a, found_b))
    counts = [np.array([len(ids) for ids in found], np.int64) for found in (found_a, found_b)]
    # texts have as many bytes in A as in B, so their ends may be counted through
    return Aligned(used, *counts, a, b, merge(np.cumsum(use.a_sizes[a]), np.cumsum(use.b_sizes[b]), steps))


def group_texts(use: Tokenizers, x: Aligned) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    ties = x.merged.ends
    last_a, last_b = np.zeros(len(x.a), bool), np.zeros(len(x.b), bool)
    last_a[x.merged.a[ties]], last_b[x.merged.b[ties]] = True, True
    # groups that end before each token; tokens of A go before those of B in a group
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    a_in, b_in = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1  # tokens up to the end of each group
    b_before = np.concatenate([[0], b_in])
    place = np.zeros(len(x.a) + len(x.b), np.int64)
    n_a, n_b = len(use.a), len(use.b)
    place[np.arange(len(x.a)) + b_before[group_a]] = x.a + n_a * last_a
    if len(x.b):
        place[np.arange(len(x.b)) + a_in[group_b]] = 2 * n_a + x.b + n_b * last_b
    stops = np.cumsum(x.a_counts + x.b_counts).tolist()
    out, at = [], 0
    for stop in stops:
        out.append(b"".join(map(use.signed.__getitem__, place[at:stop].tolist()))[:-1])
        at = stop
    return out


def _files(docs: DataFrame, a_path: str, b_path: str):
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))  # two vocabulary files


GROUP = T.StructType([T.StructField(n, T.IntegerType()) for n in ("a_from", "a_to", "b_from", "b_to", "byte_from", "byte_to")])
OVERLAP = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])


def align(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, text: str = "text", steps: int = STEPS) -> DataFrame:
    """All columns with ``a_ids``, ``b_ids``, ``groups`` and ``overlaps`` of each text.

    A group has its token ranges in A and B (from, to: end exclusive) and its bytes in
    space + text; ``overlaps`` lists the places of tokens that share a byte.
    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have
    empty lists; repeated rows are aligned one by one; an empty table gives an empty result;
    columns named like the new ones are replaced. Nothing is shuffled.
    """
    files = _files(docs, a_path, b_path)
    ints = T.ArrayType(T.IntegerType())
    new = T.StructType([
        T.StructField("a_ids", ints), T.StructField("b_ids", ints), T.StructField("groups", T.ArrayType(GROUP)), T.StructField("overlaps", T.ArrayType(OVERLAP))])
    kept = [c for c in docs.columns if c not in new.names]
    rows = docs.select(*kept, F.col(text).alias("_text"))

    def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = load(*files.value)
        for whole in batches:
            for batch in by_bytes(whole, "_text", BATCH):
                x = align_texts(use, batch.column("_text").to_pylist(), steps)
                m = x.merged
                text_of = np.repeat(np.arange(len(x.used)), x.a_counts)
                a_zero = np.concatenate([[0], np.cumsum(x.a_counts)])
                b_zero = np.concatenate([[0], np.cumsum(x.b_counts)])
                at = text_of[m.a]  # text of each overlap
                ends = np.cumsum(use.a_sizes[x.a])
                zero = np.concatenate([[0], ends])[a_zero[:-1]]
                a_to, b_to, of = m.a[m.ends] + 1, m.b[m.ends] + 1, at[m.ends]
                a_from, b_from = (np.concatenate([[0], t[:-1]])[: len(t)] for t in (a_to, b_to))
                byte_to = ends[a_to - 1]
                byte_from = np.concatenate([[0], byte_to[:-1]])[: len(byte_to)]
                small = lambda v: pa.array(v.astype(np.int32))
                groups = pa.StructArray.from_arrays(
                    [small(a_from - a_zero[of]), small(a_to - a_zero[of]), small(b_from - b_zero[of]), small(b_to - b_zero[of]),
                     small(byte_from - zero[of]), small(byte_to - zero[of])], names=GROUP.names)
                pairs = pa.StructArray.from_arrays([small(m.a - a_zero[at]), small(m.b - b_zero[at])], names=OVERLAP.names)
                count = lambda of: np.bincount(of, minlength=len(x.used))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), lists(small(x.a), x.a_counts), lists(small(x.b), x.b_counts), lists(groups, count(of)), lists(pairs, count(at))],
                    names=[*kept, *new.names])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], *new.fields]))


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """Id pairs that can end together at all: of two such tokens one is a suffix of the other."""

    def table(tokens: list[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for t in tokens:
            if t:
                out[t] = out.get(t, 0) + 1
        return out

    in_a, in_b = table(a), table(b)
    longer_a = sum(n * in_b.get(t[k:], 0) for t, n in in_a.items() for k in range(len(t)))
    return longer_a + sum(n * in_a.get(t[k:], 0) for t, n in in_b.items() for k in range(1, len(t)))


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return zstandard.compress(np.concatenate([np.diff(keys, prepend=0), counts]).astype("<i8").tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(data), "<i8")
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def link_counts(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, text: str = "text", key: str = "doc_id", steps: int = STEPS) -> DataFrame:
    """Rows (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one per document.

    A link is a pair of tokens that end together; its id pair's count is the number of
    such links in all documents. ``n_best`` counts the links whose count is the highest of
    their B id, ``count_sum`` sums the counts of all links of the document.

    Texts are read and aligned once. Each gives a short row with its distinct id pairs,
    which is written; tasks then sum the pairs they hold before a grouped sum. Of two
    tokens that end together one is a suffix of the other, so the vocabularies alone
    bound the number of distinct pairs (``most_pairs``, checked), and the table of counts is
    broadcast whatever the size of the corpus. Odd rows are as in ``align``: they have zeros and the empty digest.
    """
    files = _files(docs, a_path, b_path)
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    longs = ("n_a", "n_b", "n_groups", "n_links")
    schema = T.StructType([
        T.StructField("_key", docs.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in longs),
        T.StructField("groups_sha256", T.StringType()), T.StructField("_links", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = load(*files.value)
        for whole in batches:
            for batch in by_bytes(whole, "_text", BATCH):
                x = align_texts(use, batch.column("_text").to_pylist(), steps)
                m, n = x.merged, len(x.used)
                text_of = np.repeat(np.arange(n), x.a_counts)[m.a[m.ends]]
                keys = (x.a[m.a[m.ends]] << 32) | x.b[m.b[m.ends]]
                links = np.bincount(text_of, minlength=n)
                stops = np.concatenate([[0], np.cumsum(links)])
                packed = [_pack(*np.unique(keys[s:e], return_counts=True)) for s, e in zip(stops, stops[1:])]
                digests = [hashlib.sha256(t).hexdigest() if ok else "" for t, ok in zip(group_texts(use, x), x.used)]
                groups = links  # each group ends with the one pair of tokens that end there
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key"), *(pa.array(v.astype(np.int64)) for v in (x.a_counts, x.b_counts, groups, links)), pa.array(digests), pa.array(packed, pa.binary())],
                    names=schema.names)

    aligned = cut(rows.mapInArrow(run, schema))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            parts = [_unpack(v.as_py()) for v in batch.column(0)]
            keys = np.concatenate([held_keys, *(k for k, _ in parts)])
            counts = np.concatenate([held, *(c for _, c in parts)])
            held_keys, at = np.unique(keys, return_inverse=True)
            held = np.zeros(len(held_keys), np.int64)
            np.add.at(held, at, counts)
        yield pa.RecordBatch.from_arrays([pa.array(held_keys), pa.array(held)], names=["pair", "n"])

    pairs = aligned.select("_links").mapInArrow(add_up, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    table = pairs.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best")).toPandas().sort_values("pair")
    use = load(*files.value)
    if len(table) > most_pairs(use.a, use.b):
        raise ValueError("more id pairs than the vocabularies allow")
    counts = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = counts.value
        for batch in batches:
            found = []
            for v in batch.column("_links"):
                keys, times = _unpack(v.as_py())
                at = np.searchsorted(known, keys)
                found.append((int(times[best[at]].sum()), int((times * n[at]).sum())) if len(keys) else (0, 0))
            n_best, sums = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out.names if c not in ("n_best", "count_sum", "groups_sha256")), n_best, sums, batch.column("groups_sha256")], names=out.names)

    out = T.StructType([*schema.fields[:5], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), schema["groups_sha256"]])
    return aligned.mapInArrow(look_up, out).withColumnRenamed("_key", key)
