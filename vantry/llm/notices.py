"""License scans: short notices found with a bounded number of edits.

A notice with at most k edits holds one of any k + 1 pieces of it unchanged
(pigeonhole). The pieces are seeds of one automaton; a seed met in a text names a
window, and only windows are held against the notice by the regex library's
bounded-error matching.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, word_bytes


class Notice(NamedTuple):
    label: str
    words: str  # lower-case words with one space between
    edits: int  # inserted, deleted or changed letters allowed; 0 asks for the very words


# Phrases that the contract of the query names.
PHRASES = [
    Notice("gpl", "gnu general public license", 0),
    Notice("apache", "apache license", 0),
    Notice("cc-by", "cc by", 0),
    Notice("mit", "mit license", 0),
]
# Short notices of public licenses. Up to one letter in ten may differ, and four at most.
NOTICES = [
    Notice("agpl", "gnu affero general public license", 3),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("apache", "unless required by applicable law or agreed to in writing", 4),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("cc-by", "licensed under cc by", 1),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc0", "dedicated to the public domain", 3),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("gpl", "free software you can redistribute it and or modify it", 4),
    Notice("isc", "permission to use copy modify and or distribute this software", 4),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("mpl", "subject to the terms of the mozilla public license", 4),
    Notice("proprietary", "all rights reserved", 1),
    Notice("unlicense", "this is free and unencumbered software", 3),
]
BATCH = 4_000_000  # bytes of text scanned together, about


def nearest(words: str, window: str) -> int:
    """Fewest edits between the notice and any part of the window (bit-parallel, one step a letter).

    It rules out windows in time linear in their length, which a backtracking match does not.
    """
    masks: dict[str, int] = {}
    for k, c in enumerate(words):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << len(words)) - 1, 1 << (len(words) - 1)
    up, down, now = full, 0, len(words)
    best = now
    for c in window:
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        above = down | ~(diagonal | up) & full
        below = up & diagonal
        if above & top:
            now += 1
        elif below & top:
            now -= 1
        above, below = above << 1 & full, below << 1 & full
        up, down = below | ~(diagonal | above) & full, above & diagonal
        best = min(best, now)
    return best


def pieces(words: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): ``edits`` + 1 pieces of nearly equal length."""
    at = [len(words) * k // (edits + 1) for k in range(edits + 2)]
    return [(s, words[s:e]) for s, e in zip(at, at[1:])]


class Scanner:
    """Seeds of all notices in one automaton; its size is that of the list of notices."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        # a notice starts and ends between words; the search wants the fewest edits in a window
        self.patterns = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.edits}}}(?= )") for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            parts = pieces(n.words, n.edits) if n.edits else [(-1, f" {n.words} ")]
            for at, piece in parts:
                seeds.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if seeds:
            self.automaton.make_automaton()

    def find(self, padded: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in words joined and surrounded by one space.

        Every place of the very words is found. Of overlapping finds of one notice
        with edits, that with fewest edits stays, then the first.
        """
        windows: set[tuple[int, int, int]] = set()
        found: list[tuple[int, int, int, int]] = []
        if not self.notices:
            return found
        for last, (size, uses) in self.automaton.iter(padded):
            first = last - size + 1
            for k, at in uses:
                n = self.notices[k]
                if n.edits:
                    low = first - at - n.edits - 1
                    windows.add((k, max(0, low), min(len(padded), low + len(n.words) + 2 * n.edits + 2)))
                else:
                    found.append((k, first + 1, last, 0))
        near: dict[int, set[tuple[int, int, int]]] = {}
        for k, low, high in windows:
            n = self.notices[k]
            match = nearest(n.words, padded[low:high]) <= n.edits and self.patterns[k].search(padded, low, high)
            if match:
                near.setdefault(k, set()).add((sum(match.fuzzy_counts), match.start(), match.end()))
        for k, places in near.items():
            kept: list[tuple[int, int]] = []
            for edits, start, end in sorted(places):
                if all(end <= s or e <= start for s, e in kept):
                    kept.append((start, end))
                    found.append((k, start, end, edits))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


@functools.lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


FOUND = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("notice", T.IntegerType()), T.StructField("edits", T.IntegerType()),
    T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def scan(docs: DataFrame, notices: list[Notice] | None = None, text: str = "text") -> DataFrame:
    """All columns with ``n_words`` and ``found``, the notices of each text in order of place.

    Letters A-Z count as small, words are runs of ASCII letters, digits and all other
    characters beyond ASCII, and a notice matches words joined by one space, so
    line breaks and punctuation cost no edits. An entry of ``found`` has the label,
    the notice's place in the list, its edits, similarity (1 - edits / letters), first
    and last word (from 0), and start and end of the original text (code points,
    end exclusive). A notice without edits is found at every place its words stand; one with
    edits once where its finds overlap.

    Whole texts are scanned where they lie, without shuffle. The list of notices is
    given in code, so what tasks receive does not grow with the data. Null and empty texts have no
    words and nothing found; repeated rows are scanned one by one; an empty table gives
    an empty result; columns named like the new ones are replaced.
    """
    given = tuple(Notice(*n) for n in (PHRASES + NOTICES if notices is None else notices))
    kept = [c for c in docs.columns if c not in ("n_words", "found")]
    new = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("found", T.ArrayType(FOUND))])
    rows = docs.select(*kept, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = scanner(given)
        for whole in batches:
            for batch in by_bytes(whole, "_text", BATCH):
                counts, lists = [], []
                for value in batch.column("_text"):
                    original = value.as_py()
                    words = word_bytes(original)
                    counts.append(len(words))
                    padded = f" {b' '.join(words).decode()} " if words else ""
                    places = search.find(padded)
                    lists.append(_entries(search, padded, places, original) if places else [])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(counts, pa.int64()), pa.array(lists, ARROW_FOUND)], names=[*kept, *new.names])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], *new.fields]))


ARROW_FOUND = pa.list_(pa.struct([
    ("label", pa.string()), ("notice", pa.int32()), ("edits", pa.int32()), ("similarity", pa.float64()),
    ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _entries(search: Scanner, padded: str, places: list[tuple[int, int, int, int]], original: str) -> list[dict]:
    spans = [m.span() for m in _WORD.finditer(original)]
    gaps = np.flatnonzero(np.frombuffer(padded.encode("utf-32-le"), np.uint32) == 32)  # the space before each word
    out = []
    for k, start, end, edits in places:
        first = int(np.searchsorted(gaps, start)) - 1
        last = max(first, int(np.searchsorted(gaps, end)) - 1)
        n = search.notices[k]
        out.append({
            "label": n.label, "notice": k, "edits": edits, "similarity": 1 - edits / len(n.words),
            "first_word": first, "last_word": last, "start": spans[first][0], "end": spans[last][1]})
    return out


def digest(scanned: DataFrame, phrases: int = len(PHRASES)) -> DataFrame:
    """Columns of the query from ``found``; the first ``phrases`` notices are its base."""
    base = F.filter("found", lambda x: x["notice"] < phrases)
    places = F.transform("_base", lambda x: x["first_word"])
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
    return scanned.withColumn("_base", base).select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(F.col("_base")).alias("base_labels"), joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["similarity"])), F.lit(0.0)).alias("score"))
