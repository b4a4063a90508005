"""Suffix-array dedup: bytes of every long string that occurs twice are removed.

Suffixes are sorted at anchors only: positions that every long window chooses by its
own content, so that equal windows choose alike. Suffixes of one anchor are ordered
deep-shallow: multikey quicksort on eight-byte keys to a shallow depth, blind tries
for what is still tied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, written

SPAN = 400  # bytes of a string that counts as repeated
PASSAGE = 256  # bytes of a string of a repeated passage
PASSAGE_WORDS = 50  # a passage holds more words than these
GRAM = 16  # bytes of an anchor in windows below 240 bytes
SHALLOW = 32  # bytes ordered by multikey quicksort before the blind tries take over
HOT = 32_768  # occurrences of an anchor that one task orders (25 MB of context); beyond it windows are counted by hash
CHUNK = 1 << 20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def gram_size(span: int) -> int:
    """Bytes of an anchor: a fifth of the window in steps of GRAM, as long ones are seldom shared by chance."""
    return max(GRAM, span // 5 // GRAM * GRAM)


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` bytes, a multiple of GRAM, from every position on."""
    if size > GRAM:
        step, n = gram_hashes(raw), len(raw) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = step[:n].copy()
        for at in range(GRAM, size, GRAM):
            h ^= h >> np.uint64(29)
            h *= _B
            h += step[at : at + n]
        h ^= h >> np.uint64(31)
        h *= _A
        return h ^ (h >> np.uint64(32))
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,))
    h = words[:n] * _A
    h ^= h >> np.uint64(31)
    h += words[8 : 8 + n]
    h *= _B
    h ^= h >> np.uint64(29)
    h *= _C
    return h ^ (h >> np.uint64(32))


def window_anchors(raw: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first window, anchor of each window, hashes) in chunks: the leftmost least gram of the window."""
    width, windows = span - gram_size(span) + 1, len(raw) - span + 1
    for base in range(0, windows, CHUNK):
        part = raw[base : base + CHUNK + span - 1]
        hashes = gram_hashes(part, gram_size(span))
        n, low = len(hashes), np.uint64((1 << 21) - 1)
        keys = (hashes & ~low) | np.arange(n, dtype=np.uint64)
        pad = -n % width
        blocks = np.concatenate([keys, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()[:n]
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
        least = np.minimum(back[: n - width + 1], ahead[width - 1 :])
        yield base, base + (least & low).astype(np.int64), hashes


def anchors(raw: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of all anchors of a text."""
    places, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for base, at, hashes in window_anchors(raw, span):
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        places.append(at)
        grams.append(hashes[at - base].view(np.int64))
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(grams)[first]


def own_repeats(raw: bytes, places: np.ndarray, grams: np.ndarray, span: int, size: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(anchors to search for, ranges known to repeat) of one text.

    Anchors of ``size`` bytes whose whole surroundings, ``span - size`` bytes before and ``span`` from it on,
    stand twice in the text are repeated there already; one of them is left to be
    met by other texts. A long run of one short line is thus a few anchors.
    """
    _, place, count = np.unique(grams, return_inverse=True, return_counts=True)
    full = (count[place] > 1) & (places >= span - size) & (places + span <= len(raw))
    first: dict[bytes, int] = {}
    keep, twice = np.ones(len(places), bool), set()
    for i in np.flatnonzero(full).tolist():
        at = int(places[i])
        around = raw[at - span + size : at + span]
        if around in first:
            keep[i] = False
            twice.update((first[around], at))
        else:
            first[around] = at
    return keep, merged([(at - span + size, at + span) for at in twice])


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Compact trie that keeps branch depths and bytes only; an insert compares with one string."""

    def __init__(self, strings: list[bytes], members: list[int]):
        self.strings = strings
        self.root: list = [members[0]]  # a leaf is a list of equal strings, an inner node (depth, {byte: child})
        for m in members[1:]:
            self._insert(m)

    def _insert(self, m: int) -> None:
        s, node = self.strings[m], self.root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = self.strings[node[0]]
        same = common(s, other)
        if same == len(s) == len(other):
            node.append(m)
            return
        up, node = None, self.root
        while isinstance(node, tuple) and node[0] < same:
            key = s[node[0]]
            up, node = (node, key), node[1][key]
        mine = s[same] if same < len(s) else -1
        if isinstance(node, tuple) and node[0] == same:
            node[1][mine] = [m]
            return
        branch = (same, {mine: [m], other[same] if same < len(other) else -1: node})
        if up is None:
            self.root = branch
        else:
            up[0][1][up[1]] = branch

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(string, length of its common prefix with the one before) in sorted order."""
        stack: list = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if isinstance(node, list):
                for k, m in enumerate(node):
                    yield m, len(self.strings[m]) if k else before
            else:
                depth, children = node
                for k, key in reversed(list(enumerate(sorted(children)))):
                    stack.append((children[key], depth if k else before))


def deep_shallow(strings: list[bytes], members: list[int], depth: int = 0) -> tuple[list[int], list[int]]:
    """Sorted order and common prefixes of neighbours (the first one's is 0).

    Multikey quicksort: three-way parts by the eight bytes at ``depth``; a part equal
    in them goes on eight bytes deeper, until SHALLOW bytes are equal and a blind trie
    orders the rest.
    """
    order: list[int] = []
    lcps: list[int] = []
    stack: list = [(members, depth, False)]
    while stack:
        part, at, _ = stack.pop()
        if len(part) == 1:
            found = [(part[0], 0)]
        elif at >= SHALLOW:
            found = list(BlindTrie(strings, part).ordered())
        else:
            pivot = strings[part[len(part) // 2]][at : at + 8]
            less, same, more = [], [], []
            for m in part:
                key = strings[m][at : at + 8]
                (same if key == pivot else less if key < pivot else more).append(m)
            if not less and not more and len(pivot) < 8:
                found = [(m, len(strings[m]) if k else 0) for k, m in enumerate(same)]
            else:
                deeper = at + 8 if len(pivot) == 8 else SHALLOW
                stack += [(x, d, True) for x, d in ((more, at), (same, deeper), (less, at)) if x]
                continue
        for k, (m, same_as_before) in enumerate(found):
            lcps.append(same_as_before if k else common(strings[order[-1]], strings[m]) if order else 0)
            order.append(m)
    return order, lcps


def reaches(left: list[bytes], right: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """``all_reaches`` for one span."""
    return all_reaches(left, right, (span,))[0]


def all_reaches(left: list[bytes], right: list[bytes], spans: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """How far before and after the anchor each occurrence is covered by strings seen twice, for each span.

    ``left`` holds reversed bytes before the anchor. Two occurrences share L bytes before
    and R from it on; where L + R >= span every string of ``span`` bytes between is repeated. All
    such ranges of one occurrence hold its anchor, so the union is one range.
    """
    n = len(left)
    if n == 2:
        a, b = common(left[0], left[1]), common(right[0], right[1])
        return [(np.array([a] * 2), np.array([b] * 2)) if a + b >= span else (np.zeros(2, np.int64),) * 2 for span in spans]
    found = [(np.zeros(n, np.int64), np.zeros(n, np.int64)) for _ in spans]
    members = list(range(n))
    (order_l, lcp_l), (order_r, lcp_r) = deep_shallow(left, members), deep_shallow(right, members)
    lcp_l, lcp_r = np.array(lcp_l), np.array(lcp_r)
    place_l = np.empty(n, np.int64)
    place_l[order_l] = np.arange(n)
    order_r_array = np.array(order_r)
    in_left = place_l[order_r_array]

    def row(lcps: np.ndarray, at: int) -> np.ndarray:
        out = np.empty(len(lcps), np.int64)
        out[at] = 0
        out[at + 1 :] = np.minimum.accumulate(lcps[at + 1 :])
        out[:at] = np.minimum.accumulate(lcps[at:0:-1])[::-1]
        return out

    for k, m in enumerate(order_r):
        r, l = row(lcp_r, k), row(lcp_l, place_l[m])[in_left]  # noqa: E741
        total = l + r
        total[k] = -1
        for span, (before, after) in zip(spans, found):
            valid = total >= span
            if valid.any():
                before[m], after[m] = l[valid].max(), r[valid].max()
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters that they hold only in part."""
    out = []
    for s, e in spans:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while s < e and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def _raw(text):
    return F.coalesce(text, F.lit("")).cast("binary")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", spans: tuple[int, ...] = (SPAN,), hot: int = HOT) -> DataFrame:
    """Rows (_key, _tk, spans): for each document and text hash the sorted ranges (span, start, end) of repeated strings.

    1. Every text of the least span or more gives its anchors as small rows, chosen in
       windows of that span, without those that repeat within it whole; a grouped minimum and maximum tells which grams occur in
       more than one place, whatever their number, with one row per gram and task.
    2. Equal texts are one class, and one document stands for it; copies need no search.
    3. Representatives that hold repeated grams meet their anchors once by a join, their
       text compressed, and give the bytes around them, as far as the largest span reaches. A repeated
       string of any span holds an anchor, so one search serves all spans.
    4. Occurrences of a gram are sorted in tasks, many grams to each. A gram with more
       than ``hot`` occurrences is not gathered: each string whose first window chose it becomes a
       128-bit hash, counted with a map-side combine.
    """
    least, most, size = min(spans), max(spans), gram_size(min(spans))
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("_key"), _raw(F.col(text)).alias("raw"))
    rows = rows.where(F.octet_length("raw") >= least).withColumn("_tk", F.xxhash64("raw"))
    ids = ["_key", "_tk"]
    schema = T.StructType([T.StructField("_key", kind), T.StructField("_tk", T.LongType())])

    def longs(*names: str) -> T.StructType:
        return T.StructType([*schema, *(T.StructField(n, T.LongType()) for n in names)])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in range(0, batch.num_rows, 512):
                part = batch.slice(some, 512)
                rows: list[tuple] = []  # (text, gram, position, None), or (text, None, start, end) of a range known to repeat
                for i, x in enumerate(part.column("raw")):
                    data = x.as_py()
                    places, grams = anchors(np.frombuffer(data, np.uint8), least)
                    keep, known = own_repeats(data, places, grams, most, size)
                    rows += [(i, g, p, None) for g, p in zip(grams[keep].tolist(), places[keep].tolist())]
                    rows += [(i, None, s, e) for s, e in known]
                if rows:
                    text_of, gram, pos, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c).take(pa.array(text_of)) for c in ids), *(pa.array(x, pa.int64()) for x in (gram, pos, end))],
                        names=[*ids, "gram", "pos", "end"])

    picked = written(rows.select(*ids, "raw").mapInArrow(pick, longs("gram", "pos", "end")))
    every = F.explode(F.array(*[F.lit(x).cast("long") for x in spans])).alias("span")
    known = picked.where("gram is null").select(*ids, every, F.col("pos").alias("s"), F.col("end").alias("e"))
    picked = picked.where("gram is not null").drop("end")
    place = F.xxhash64("_tk", "pos")
    grams = (
        picked.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n"))
        .where(F.col("a") != F.col("b")).select("gram", (F.col("n") > hot).alias("hot"))
    )
    classes = cut(
        rows.select(*ids, F.md5("raw").alias("m"), F.octet_length("raw").alias("size"))
        .groupBy("m", "_tk", "size").agg(F.min("_key").alias("_key"), F.count("*").alias("n"))
    )

    def same(a: DataFrame, b: DataFrame):
        return a["_key"].eqNullSafe(b["_key"]) & (a["_tk"] == b["_tk"])

    wanted = picked.join(grams, "gram").groupBy(*ids).agg(F.collect_list(F.struct("pos", "gram", "hot")).alias("at"))
    stands = classes.select(*ids).distinct()
    wanted = wanted.join(stands, same(wanted, stands), "left_semi")

    packed = rows.select(*ids, packed_bytes("raw").alias("raw"))
    held = packed.join(wanted, same(packed, wanted)).select(packed["_key"], packed["_tk"], "raw", "at")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                data = unpacker.decompress(batch.column("raw")[i].as_py())
                marks = batch.column("at")[i].as_py()
                some = [(x["pos"], x["gram"]) for x in marks if not x["hot"]]
                busy = {x["pos"] for x in marks if x["hot"]}
                ident = [batch.column(c).slice(i, 1) for c in ids]

                def rows_of(pos, gram, span, left, right):
                    n = pa.array(np.zeros(len(pos), np.int64))
                    return pa.RecordBatch.from_arrays(
                        [*(c.take(n) for c in ident), *(pa.array(x, pa.int64()) for x in (pos, gram, span)), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                        names=[*ids, "pos", "gram", "span", "before", "after"])

                for k in range(0, len(some), 2_000):
                    pos = [p for p, _ in some[k : k + 2_000]]
                    yield rows_of(
                        pos, [g for _, g in some[k : k + 2_000]], [None] * len(pos),
                        [data[max(0, p - most + size) : p][::-1] for p in pos], [data[p : p + most] for p in pos])
                if busy:
                    for base, at, _ in window_anchors(np.frombuffer(data, np.uint8), least):
                        starts = base + np.flatnonzero(np.isin(at, list(busy)))
                        for span in spans:
                            whole = starts[starts + span <= len(data)].tolist()
                            for k in range(0, len(whole), 10_000):
                                pos = whole[k : k + 10_000]
                                hashes = [hashlib.blake2b(data[p : p + span], digest_size=16).digest() for p in pos]
                                yield rows_of(pos, [None] * len(pos), [span] * len(pos), [None] * len(pos), hashes)

    around = held.mapInArrow(contexts, T.StructType([
        *longs("pos", "gram", "span"), T.StructField("before", T.BinaryType()), T.StructField("after", T.BinaryType())]))
    any_hot = bool(grams.where("hot").limit(1).count())
    if any_hot:
        around = cut(around)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            table = batch if rest is None else rest if batch is None else pa.Table.from_batches([*rest.to_batches(), *batch.to_batches()])
            if batch is None and rest is None:
                return
            gram = table.column("gram").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1, [len(gram)]])
            last = len(edges) - 1 if batch is None else len(edges) - 2  # the last gram may go on in the next batch
            rest = None if batch is None else table.slice(edges[-2])
            done = table.slice(0, edges[last])
            if not done.num_rows:
                continue
            left, right = done.column("before").to_pylist(), done.column("after").to_pylist()
            pos = done.column("pos").to_numpy()
            reach = np.zeros((len(spans), 2, len(pos)), np.int64)
            for s, e in zip(edges[:last].tolist(), edges[1 : last + 1].tolist()):
                if e - s > 1:
                    for k, found in enumerate(all_reaches(left[s:e], right[s:e], spans)):
                        reach[k, 0, s:e], reach[k, 1, s:e] = found
            for span, (before, after) in zip(spans, reach):
                at = np.flatnonzero(after)
                yield pa.RecordBatch.from_arrays(
                    [*(done.column(c).take(pa.array(at)).combine_chunks() for c in ids), pa.array(np.full(len(at), span)), pa.array(pos[at] - before[at]), pa.array(pos[at] + after[at])],
                    names=[*ids, "span", "s", "e"])

    near = around.where("gram is not null").select(*ids, "pos", "gram", "before", "after")
    found = near.repartition("gram").sortWithinPartitions("gram").mapInArrow(search, longs("span", "s", "e"))
    if any_hot:
        windows = around.where("gram is null").select(*ids, "pos", "span", F.col("after").alias("w"))
        twice = windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
        found = found.union(windows.join(twice, "w").select(*ids, "span", F.col("pos").alias("s"), (F.col("pos") + F.col("span")).alias("e")))
    # a text with a copy is repeated from end to end
    copied = classes.where("n > 1").select("m", F.col("size").cast("long").alias("e"))
    full = rows.select(*ids, F.md5("raw").alias("m")).join(copied, "m").select(*ids, every, F.lit(0).cast("long").alias("s"), "e").where("e >= span").distinct()
    return found.union(full).union(known).groupBy(*ids).agg(F.sort_array(F.collect_set(F.struct("span", "s", "e"))).alias("spans"))


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table | None]:
    for batch in batches:
        if batch.num_rows:
            yield pa.Table.from_batches([batch])
    yield None


def dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, hot: int = HOT,
    more_words_than: int = 0, passage: int | None = None, passage_words: int = PASSAGE_WORDS,
) -> DataFrame:
    """All columns of every document with (n_bytes, n_removed, n_spans, kept_sha256, kept_text).

    A byte goes if a string of ``span`` bytes that covers it starts at any other place
    of any document, the same one included; strings are judged on the input, so all
    copies of a passage go. Of the maximal runs of such bytes those go that touch more
    words than ``more_words_than``. With ``passage``, two more columns
    report (n_passages, passage_bytes): runs covered by repeated strings of ``passage``
    bytes that touch more words than ``passage_words``, whether removed or not.

    Counts and digest are of bytes. ``kept_text`` keeps
    characters of which a range holds only a part. Null texts count as empty; texts
    below ``span`` bytes stay; equal texts of ``span`` bytes or more go whole, rows with
    one key included; an empty table gives an empty result; input columns with the
    names of new ones are replaced.
    """
    spans = repeated_spans(docs, key, text, tuple(sorted({span, passage or span})), hot)
    # the text crosses this join once, compressed
    rest = F.struct(F.lit(1).alias("_"), *[c for c in docs.columns if c != text])
    packed = docs.select(rest.alias("_row"), F.col(text).isNull().alias("_none"), packed_bytes(_raw(F.col(text))).alias("_text"), F.col(key).alias("_key"), F.xxhash64(_raw(F.col(text))).alias("_tk"))
    joined = packed.join(spans, packed["_key"].eqNullSafe(spans["_key"]) & (packed["_tk"] == spans["_tk"]), "left").select("_row", "_none", "_text", "spans")
    out = T.StructType([
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])
    if passage:
        out = out.add("n_passages", T.LongType()).add("passage_bytes", T.LongType())

    @F.pandas_udf(out)
    def remove(raws, ranges):
        import pandas as pd

        def runs(data, found, of, words):
            whole = merged([(int(x["s"]), int(x["e"])) for x in found if x["span"] == of]) if found is not None else []
            return [(s, e) for s, e in whole if len(data[s:e].split()) > words] if words else whole

        rows = []
        unpack = zstandard.ZstdDecompressor().decompress
        for data, found in zip(raws, ranges):
            data = unpack(data)
            spans = runs(data, found, span, more_words_than)
            row = [len(data), sum(e - s for s, e in spans), len(spans), hashlib.sha256(_without(data, spans)).hexdigest(),
                   _without(data, whole_characters(data, spans)).decode("utf-8", "replace")]
            if passage:
                seen = runs(data, found, passage, passage_words)
                row += [len(seen), sum(e - s for s, e in seen)]
            rows.append(row)
        return pd.DataFrame(rows, columns=out.names)

    done = joined.withColumn("_d", remove("_text", "spans"))
    own = F.when(~F.col("_none"), unpacked_text("_text")).cast(docs.schema[text].dataType).alias(text)
    kept = [own if c == text else F.col("_row")[c].alias(c) for c in docs.columns if c not in out.names]
    return done.select(*kept, *[F.col("_d")[c].alias(c) for c in out.names])


@F.pandas_udf(T.BinaryType())
def packed_bytes(raws):
    pack = zstandard.ZstdCompressor(level=3).compress
    return raws.map(pack)


@F.pandas_udf(T.StringType())
def unpacked_text(packed):
    unpack = zstandard.ZstdDecompressor().decompress
    return packed.map(lambda x: unpack(x).decode())


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in spans:
        parts.append(data[at:s])
        at = e
    parts.append(data[at:])
    return b"".join(parts)
