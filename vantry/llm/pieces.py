"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The normaliser, the pieces and byte fallback are compiled once into a transducer whose
states are pieces; a text is composed with it position by position, and the
shortest path over the tropical semiring (min, +) gives the pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
REMEMBERED = 300_000  # segments whose paths a task keeps
BATCH = 3_000_000  # bytes of text composed together, about
LONG = 64  # characters beyond which a segment is not kept
START = -1


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        head = number()
        kind = head & 7
        if kind == 0:
            yield head >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield head >> 3, data[at : at + size]
            at += size


class Transducer:
    """Compiled model: text to piece ids and back."""

    def __init__(self, pieces: list[tuple[str, float, int]], model_type: int, dummy_prefix: bool = True, squeeze: bool = False):
        self.type, self.dummy_prefix, self.squeeze = model_type, dummy_prefix, squeeze
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[1:][2:4], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.score = [s for _, s, _ in pieces]
        self.text = [p if kind in (NORMAL, USER) else "" for p, _, kind in pieces]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # every ending of a piece, so that composition stops where no piece goes further back
        self.arcs: dict[str, int] = {}
        for p in self.ids:
            for n in range(1, len(p)):
                self.arcs.setdefault(p[n:], -1)
        self.arcs.update(self.ids)
        whole = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        # no piece has a space mark after another character, so paths may part there
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if whole else "(?s).+", re.S)
        self.worst = min((self.score[i] for i in self.ids.values()), default=0.0) - 10
        if model_type == BPE:
            order = sorted(self.ids.values(), key=lambda i: (-self.score[i], i))
            self.rank = {self.text[i]: r for r, i in enumerate(order)}
            self._derive()
        self.known: dict[int, bool] = {}
        self.paths: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str = MODEL) -> Transducer:
        pieces, kind, dummy, squeeze = [], UNIGRAM, True, True
        with open(path, "rb") as file:
            data = file.read()
        for field, value in _fields(data):
            if field == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, NORMAL)))
            elif field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("only the identity character map is supported")
                dummy, squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        return cls(pieces, kind, dummy, squeeze)

    def _derive(self) -> None:
        """The two parts of every piece, and which pieces merging makes from their own letters."""
        self.parts: dict[int, tuple[int, int]] = {}
        own = {}
        for p, i in self.ids.items():
            letters = list(p)
            while len(letters) > 1:
                found = [(self.rank[x + y], k) for k, (x, y) in enumerate(zip(letters, letters[1:])) if x + y in self.rank]
                if not found:
                    break
                k = min(found)[1]
                if len(letters) == 2:
                    self.parts[i] = tuple(self.ids.get(x, -1) for x in letters)
                letters[k : k + 2] = [letters[k] + letters[k + 1]]
            if len(letters) == 1:
                own[p] = i
        self.arcs.update({p: -1 for p in self.ids if p not in own})

    def _spine(self, piece: int, side: int) -> list[tuple[str, float]]:
        """(symbol, rank of the merge that takes it up) along one edge of a piece's merges."""
        out, until = [], float("inf")
        while True:
            out.append((self.text[piece], until))
            until = self.rank[self.text[piece]]
            if piece not in self.parts:
                return out
            piece = self.parts[piece][side]
            if piece < 0:
                return out

    def weight(self, before: int, piece: int) -> float:
        """Weight of an arc from one state to the next.

        A unigram model weighs pieces. A merge model forbids pairs between which
        merging would have joined symbols: over the edges of both pieces, a merge that
        comes before each of its symbols is taken up (of equal ones the left one
        first). Just one path of finite weight is left, the merged text.
        """
        if self.type != BPE:
            return -self.score[piece]
        if before < 0:
            return 0.0
        key = before * len(self.text) + piece
        known = self.known.get(key)
        if known is None:
            right, left = self._spine(before, 1), self._spine(piece, 0)
            known = not any(
                (r := self.rank.get(x + y)) is not None and r < x_until and r <= y_until for x, x_until in right for y, y_until in left)
            if len(self.known) > 4_000_000:
                self.known.clear()
            self.known[key] = known
        return 0.0 if known else float("inf")

    def shortest(self, segments: list[str]) -> Iterator[tuple[str, bytes]]:
        """(segment, piece ids as 32-bit words) of the shortest path through each, in sorted order.

        The best path to a position depends on what lies before it only, so a segment
        goes on from what it shares with the one before. A position keeps its
        best path only: in a merge model no other path is finite, and in a unigram model
        weights do not depend on the state. A character without a piece of its own takes
        its bytes, or the unknown piece.
        """
        arc, known, size, merging, ids = self.arcs.get, self.known, len(self.text), self.type == BPE, self.ids
        inf = float("inf")
        cost, last, start, before = [0.0], [START], [0], ""
        for s in sorted(segments):
            shared, most = 0, min(len(s), len(before))
            while shared < most and s[shared] == before[shared]:
                shared += 1
            del cost[shared + 1 :], last[shared + 1 :], start[shared + 1 :]
            for end in range(shared + 1, len(s) + 1):
                least, piece_of, from_at = inf, START, end - 1
                for at in range(end - 1, -1, -1):
                    piece = arc(s[at:end])
                    if piece is None:
                        break
                    if piece < 0:
                        continue
                    state = last[at]
                    if merging:
                        if state >= 0:
                            fits = known.get(state * size + piece)
                            if fits is None:
                                fits = self.weight(state, piece) == 0.0
                            if not fits:
                                continue
                        least, piece_of, from_at = 0.0, piece, at
                        break
                    total = cost[at] + self.weight(state, piece)
                    if total < least:
                        least, piece_of, from_at = total, piece, at
                if s[end - 1] not in ids:
                    total = cost[end - 1] + (0.0 if merging else -self.worst)
                    if total < least:
                        least, piece_of, from_at = total, START, end - 1
                cost.append(least)
                last.append(piece_of)
                start.append(from_at)
            before = s
            path, at = [], len(s)
            while at:
                if last[at] >= 0:
                    path.append(last[at])
                elif self.bytes:
                    path.extend(self.bytes[b] for b in reversed(s[start[at] : at].encode("utf-8", "surrogatepass")))
                else:
                    path.append(self.unknown)
                at = start[at]
            path.reverse()
            yield s, array("i", path).tobytes()

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of texts; paths of short segments are kept for the texts to come."""
        found = [self.segments.findall(self.normalise(t or "")) for t in texts]
        memory = self.paths
        if len(memory) > REMEMBERED:
            memory.clear()
        fresh = set(chain.from_iterable(found)).difference(memory)
        memory.update(self.shortest(list(fresh)))
        out = [np.frombuffer(b"".join(map(memory.__getitem__, segments)), np.int32) for segments in found]
        for s in fresh:
            if len(s) > LONG:
                del memory[s]
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int], no_bytes: bool = False) -> str:
        """Text of ids: byte pieces join to characters, and the prefix goes again."""
        if no_bytes or self.byte_of.keys().isdisjoint(ids):
            text = "".join(itemgetter(*ids)(self.text)) if ids else ""
        else:
            text = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].encode("utf-8") for i in ids).decode("utf-8", "replace")
        text = text.replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """All columns with ``ids`` (array of piece ids), ``n_pieces``, ``n_bytes`` and ``round_trip``.

    The transducer is compiled on the driver, and its size is that of the vocabulary;
    tasks compose it with whole texts, batch by batch, without shuffle. ``n_bytes`` counts
    byte pieces; ``round_trip`` tells whether decoding the ids gives the text again
    (it fails only where the text itself holds the space mark). Null and empty texts
    have no ids; repeated rows are encoded one by one; an empty table gives an empty
    result; columns named like the new ones are replaced.
    """
    machine = docs.sparkSession.sparkContext.broadcast(Transducer.load(model))
    new = T.StructType([
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()),
        T.StructField("n_bytes", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    kept = [c for c in docs.columns if c not in new.names]
    rows = docs.select(*kept, F.col(text).alias("_text")) if text not in kept else docs.select(*kept)
    given = text if text in kept else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = machine.value
        low, high = (min(use.byte_of), max(use.byte_of)) if use.byte_of else (0, -1)
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(given)), 0).to_numpy(zero_copy_only=False))
            edges = [0, *(np.flatnonzero(np.diff(sizes // BATCH)) + 1).tolist(), whole.num_rows]
            for at, stop in zip(edges, edges[1:]):
                batch = whole.slice(at, stop - at)
                texts = batch.column(given).to_pylist()
                found = use.encode_all(texts)
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                counts = np.array([len(x) for x in found], np.int64)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                is_byte = np.concatenate([[0], np.cumsum((flat >= low) & (flat <= high))])
                n_bytes = is_byte[ends[1:]] - is_byte[ends[:-1]]
                same = [use.decode(x.tolist(), not n) == (t or "") for x, n, t in zip(found, n_bytes, texts)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(counts),
                     pa.array(n_bytes), pa.array(same, pa.bool_())],
                    names=[*kept, *new.names])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], *new.fields]))


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "text") -> DataFrame:
    """All columns with the text of the ids; null ids give the empty text."""
    machine = rows.sparkSession.sparkContext.broadcast(Transducer.load(model))

    @F.pandas_udf(T.StringType())
    def text_of(column: pd.Series) -> pd.Series:
        use = machine.value
        return pd.Series([use.decode(x.tolist()) if x is not None else "" for x in column], dtype=object)

    return rows.withColumn(out, text_of(F.col(ids)))
