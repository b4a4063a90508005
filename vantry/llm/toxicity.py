"""Toxicity: class-conditional Kneser-Ney models of letters, compared per unit of length."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

ORDER = 5  # bytes of an n-gram, its last one predicted from the others
DISCOUNT = 0.75
STRENGTH = 20.0  # observations that the shared distribution counts for in a context of one class
PASSAGES = (1, 4, 24)  # words of the passages whose likelihoods are compared
MARGIN = 4  # bytes added to the length of a passage, so that very short ones don't stand out
THRESHOLD = 0.3
MODEL_BOUND = 1 << 20  # distinct n-grams of a model that may be broadcast, counted first; more are joined by shuffle
HELD = 1 << 20  # bytes of distinct words that a counting task holds before it gives their n-grams on
LABEL_BOUND = 2_000_000  # label rows that may be broadcast, counted first; more are joined by shuffle
FIT_BOUND = 20_000  # labelled documents, by hash of the key, to which the calibration is fitted
UNITS = float(1 << 32)  # parts of one in which ratios of joined n-grams are added
START, END = 2, 3  # bytes around a word; never part of one
TOP = 3  # single words whose ratios are averaged
FEATURES = len(PASSAGES) + 3
_SPLIT = bytes(32 if i < 128 and not chr(i).isalpha() else i for i in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words as UTF-8; ASCII other than letters parts them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def cell(keys: np.ndarray) -> np.ndarray:
    """Place of n-grams in a ``Table``: their own bytes, so that no two share one."""
    return keys.astype(np.int64)


class Table:
    """Values of exact keys; a key that was never learnt has ``missing``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values, self.missing = keys[order].astype(np.int64), values[order].astype(np.float32), np.float32(missing)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(np.shape(keys), self.missing)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.missing)[()]


def ngrams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of every letter and end of the words, and the word of each.

    The last byte is the predicted one; contexts reach back ORDER - 1 bytes but not
    beyond the start mark of the word.
    """
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    flat = np.frombuffer(b"".join(w + b"\x03" for w in found), np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(found)), sizes)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = flat.copy()
    for back in range(1, ORDER):
        before = np.roll(flat, back)
        before = np.where(offset >= back, before, np.where(offset == back - 1, START, 0))
        keys |= before << (8 * back)
    return keys, word


def _shorter(keys: np.ndarray) -> np.ndarray:
    """N-grams without their first byte."""
    out = np.zeros_like(keys)
    for size in range(2, ORDER + 1):
        at = (keys >> (8 * (size - 1))) > 0
        out = np.where(at, keys & ((1 << (8 * (size - 1))) - 1), out)
    return out


def _shared(keys: np.ndarray) -> np.ndarray:
    """Backoff probability of distinct n-grams: Kneser-Ney over continuation counts, one for both classes."""
    if not keys.any():
        return np.full(len(keys), 1 / 256)
    lower, place, count = np.unique(_shorter(keys), return_inverse=True, return_counts=True)
    if not lower.any():
        return np.full(len(keys), 1 / 256)
    _, context = np.unique(lower >> 8, return_inverse=True)
    total, kinds = np.bincount(context, count), np.bincount(context)
    p = np.maximum(count - DISCOUNT, 0) / total[context] + DISCOUNT * (kinds / total)[context] * _shared(lower)
    return p[place]


def likelihood_ratios(keys: np.ndarray, toxic: np.ndarray, plain: np.ndarray) -> tuple[Table, Table]:
    """Tables of log P(byte | context, toxic) - log P(byte | context, ordinary).

    The first has the n-grams seen, the second the contexts, for bytes never seen
    after them, where the shared backoff cancels. A class that never saw a context
    takes the backoff as it is.
    """
    if not len(keys):
        return Table(keys, keys, np.nan), Table(keys, keys, 0)
    contexts, at = np.unique(keys >> 8, return_inverse=True)
    both = toxic + plain
    total, kinds = np.bincount(at, both), np.bincount(at)
    backoff = np.maximum(both - DISCOUNT, 0) / total[at] + DISCOUNT * (kinds / total)[at] * _shared(keys)
    logs, left = [], []
    for counts in (toxic, plain):
        total, kinds = np.bincount(at, counts), np.bincount(at, counts > 0)
        weight = (DISCOUNT * kinds + STRENGTH) / (total + STRENGTH)
        own = np.maximum(counts - DISCOUNT, 0) / (total + STRENGTH)[at]
        logs.append(np.log(own + weight[at] * backoff))
        left.append(np.log(weight))
    return Table(cell(keys), logs[0] - logs[1], np.nan), Table(cell(contexts), left[0] - left[1], 0)


def _shorter_key(key: Column) -> Column:
    """``_shorter`` of a column."""
    out = F.lit(0).cast("long")
    for size in range(2, ORDER + 1):
        bits = 8 * (size - 1)
        out = F.when(F.shiftright(key, bits) > 0, key.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))).otherwise(out)
    return out


def grouped_ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``likelihood_ratios`` by grouped aggregates: rows (key, ratio) of n-grams and (context, rest) of contexts.

    ``counts`` has (key, toxic, plain), one row per n-gram; nothing of it reaches the driver.
    """
    context, discount = F.shiftright("key", 8).alias("context"), F.lit(DISCOUNT)
    lower = _shorter_key(F.col("key"))
    levels, above = [], counts
    while True:  # n-grams without their first byte, until none has a byte left
        above = cut(above.groupBy(lower.alias("key")).agg(F.count("*").cast("double").alias("n")))
        if not above.agg(F.max("key")).first()[0]:
            break
        levels.append(above)
    below = None
    for level in reversed(levels):
        totals = level.groupBy(context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        rows = level.select("key", "n", context, lower.alias("lower")).join(totals, "context")
        rows = rows.withColumn("q", F.lit(1 / 256)) if below is None else rows.join(below, "lower")
        p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + discount * (F.col("kinds") / F.col("total")) * F.col("q")
        below = cut(rows.select(F.col("key").alias("lower"), p.alias("q")))
    both = F.col("toxic") + F.col("plain")
    totals = counts.groupBy(context).agg(
        F.sum(both).alias("total"), F.count("*").alias("kinds"),
        *[F.sum(c).alias(f"{c}_total") for c in ("toxic", "plain")], *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("toxic", "plain")])
    weight = lambda c: (discount * F.col(f"{c}_kinds") + STRENGTH) / (F.col(f"{c}_total") + STRENGTH)
    rows = counts.select("*", context, lower.alias("lower")).join(totals, "context")
    rows = rows.withColumn("q", F.lit(1 / 256)) if below is None else rows.join(below, "lower")
    backoff = F.greatest(both - discount, F.lit(0.0)) / F.col("total") + discount * (F.col("kinds") / F.col("total")) * F.col("q")
    log = lambda c: F.log(F.greatest(F.col(c) - discount, F.lit(0.0)) / (F.col(f"{c}_total") + STRENGTH) + weight(c) * F.col("backoff"))
    seen = rows.withColumn("backoff", backoff).select("key", (log("toxic") - log("plain")).cast("float").alias("ratio"))
    unseen = totals.select("context", (F.log(weight("toxic")) - F.log(weight("plain"))).cast("float").alias("rest"))
    return cut(seen), cut(unseen)


class Scorer:
    """Features of texts under one model; remembers the words of recent texts."""

    KEPT = 200_000

    def __init__(self, seen: Table, unseen: Table):
        self.seen, self.unseen = seen, unseen
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.ratio, self.length = np.zeros(0), np.zeros(0)

    def _learn(self, fresh: list[bytes]) -> None:
        keys, word = ngrams(fresh)
        ratio = self.seen[cell(keys)]
        ratio = np.where(np.isnan(ratio), self.unseen[cell(keys >> 8)], ratio)
        self.ratio = np.concatenate([self.ratio, np.bincount(word, ratio, len(fresh))])
        self.length = np.concatenate([self.length, np.bincount(word, minlength=len(fresh))])

    def features(self, text: str | None) -> tuple[float, ...]:
        """Ratio per byte of the whole text, of its most toxic passages and of its TOP words, and the log length."""
        found = tokens(text)
        if not found:
            return (0.0,) * FEATURES
        if len(self.ids) > self.KEPT:
            self._clear()
        fresh = [w for w in dict.fromkeys(found) if w not in self.ids]
        if fresh:
            self.ids.update(zip(fresh, range(len(self.ids), len(self.ids) + len(fresh))))
            self._learn(fresh)
        at = np.fromiter(map(self.ids.__getitem__, found), np.int64, len(found))
        return _summary(self.ratio[at], self.length[at])


def _summary(ratios: np.ndarray, lengths: np.ndarray) -> tuple[float, ...]:
    """Features of a text from the ratio and length of each of its words."""
    ratio, length = np.concatenate([[0], np.cumsum(ratios)]), np.concatenate([[0], np.cumsum(lengths)])
    best = []
    for width in (min(p, len(ratios)) for p in PASSAGES):
        best.append(float(((ratio[width:] - ratio[:-width]) / (length[width:] - length[:-width] + MARGIN)).max()))
    word = np.sort(ratios / (lengths + MARGIN))[-TOP:]
    return ratio[-1] / length[-1], *best, float(word.sum() / TOP), float(np.log(len(ratios)))


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _name(word: bytes) -> bytes:
    """A word as a key: itself, or its SHA-256 where it is as long as that or longer."""
    return word if len(word) < 32 else hashlib.sha256(word).digest()


def _packed(rows: Iterator[tuple], columns: list[str], most: int = HELD) -> Iterator[pd.DataFrame]:
    """Frames of many rows, of at most about ``most`` bytes in their last column."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += len(row[-1]) + 64
        if held > most:
            yield pd.DataFrame(some, columns=columns)
            some, held = [], 0
    if some:
        yield pd.DataFrame(some, columns=columns)


def joined_features(texts: DataFrame, seen: DataFrame, unseen: DataFrame) -> DataFrame:
    """(h, x) of every distinct ``text``: its ``text_hash`` and features, under a model too large to send.

    N-grams of the distinct words meet the model by exact key, words meet the texts
    that hold them. Python sees frames of many words; n-grams carry the name of
    their word, never a long word itself, and its ratio is a sum of whole numbers
    that combines before the shuffle, so that it is the same in every order.
    """
    lines = cut(texts.select(text_hash(F.col("text")).alias("h"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["h"]))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = ((h, _name(w), w) for h, text in zip(batch["h"], batch["text"]) for w in dict.fromkeys(tokens(text)))
            yield from _packed(each, ["h", "name", "word"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _packed(zip(batch["name"], batch["word"]), ["name", "word"]):
                keys, at = ngrams([bytes(w) for w in part["word"]])
                names = part["name"].to_numpy()
                for k in range(0, len(keys), 100_000):
                    yield pd.DataFrame({"name": names[at[k : k + 100_000]], "key": keys[k : k + 100_000]})

    held = cut(lines.mapInPandas(spread, "h string, name binary, word binary"))
    grams = held.select("name", "word").dropDuplicates(["name"]).mapInPandas(split, "name binary, key long")
    found = grams.join(seen, "key", "left").withColumn("context", F.shiftright("key", 8)).join(unseen, "context", "left")
    each = F.round(F.coalesce("ratio", "rest", F.lit(0.0)).cast("double") * UNITS).cast("long")
    words = found.groupBy("name").agg((F.sum(each) / UNITS).alias("ratio"), F.count("*").alias("length"))
    by_text = held.select("h", "name").join(words, "name").groupBy("h").agg(F.collect_list(F.struct("name", "ratio", "length")).alias("w"))

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series, names: pd.Series, ratios: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for text, own, ratio, length in zip(texts, names, ratios, lengths):
            order = tokens(text)
            if order:
                place = {bytes(w): k for k, w in enumerate(own)}
                at = np.fromiter((place[_name(w)] for w in order), np.int64, len(order))
            out.append(list(_summary(np.asarray(ratio)[at], np.asarray(length)[at])) if order else [0.0] * FEATURES)
        return pd.Series(out)

    return lines.join(by_text, "h", "left").select("h", features("text", "w.name", "w.ratio", "w.length").alias("x"))


def _ngram_counts(labelled: DataFrame) -> DataFrame:
    """(key, toxic, plain, toxic_fit, plain_fit) from rows (text, toxic, fits): one row per distinct n-gram.

    The last two leave out the rows that ``fits`` marks for the calibration. A task sums over the words it holds, at most about HELD bytes, and gives their
    n-grams on; rows of one n-gram meet in a grouped sum, however many there are.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: tuple[dict[bytes, int], ...] = ({}, {}, {}, {})
        held = 0
        for batch in batches:
            for text, label, fits in zip(batch["text"], batch["toxic"], batch["fits"]):
                own = words[label + 2 * bool(fits)]
                for w in set(tokens(text)):
                    n = own.get(w, 0)
                    own[w] = n + 1
                    held += 0 if n else len(w) + 1
                if held > HELD:
                    yield from summed(words)
                    words, held = ({}, {}, {}, {}), 0
        yield from summed(words)

    def summed(words: tuple[dict[bytes, int], ...]) -> Iterator[pd.DataFrame]:
        for kind, own in enumerate(words):
            if own:
                label, other = kind % 2, kind < 2
                keys, word = ngrams(list(own))
                keys, at = np.unique(keys, return_inverse=True)
                n = np.bincount(at, np.fromiter(own.values(), np.float64, len(own))[word])
                for k in range(0, len(keys), 50_000):
                    some = n[k : k + 50_000]
                    toxic, plain = some * label, some * (1 - label)
                    yield pd.DataFrame({"key": keys[k : k + 50_000], "toxic": toxic, "plain": plain, "toxic_fit": toxic * other, "plain_fit": plain * other})

    names = ("toxic", "plain", "toxic_fit", "plain_fit")
    rows = labelled.mapInPandas(count, "key long, " + ", ".join(f"{n} double" for n in names))
    return rows.groupBy("key").agg(*[F.sum(n).alias(n) for n in names])


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


SCALE = np.array([20.0, 2.0, 4.0, 16.0, 2.0, 0.25])  # brings the features to like size


def _score(weights: np.ndarray, features: list) -> np.ndarray:
    x = np.array(features, np.float64).reshape(-1, FEATURES) * SCALE
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -700, 700)))


def _under(counts: DataFrame, broadcast_most: int) -> tuple[Callable, Callable]:
    """Features of rows (text, toxic), and scored documents, under the model of ``counts``."""
    names = [f"x{i}" for i in range(FEATURES)]
    if counts.count() > broadcast_most:
        seen, unseen = grouped_ratios(counts)

        def with_features(rows: DataFrame) -> DataFrame:
            x = joined_features(rows, seen, unseen)
            return rows.join(x, text_hash(F.col("text")) == F.col("h")).select(*[F.col("x")[i].alias(n) for i, n in enumerate(names)], F.col("toxic").alias("y"))

        def scored(docs: DataFrame, text: str, weights: np.ndarray, held_out: Callable) -> DataFrame:
            x = joined_features(docs.select(F.col(text).alias("text")), seen, unseen)
            score = F.pandas_udf(lambda xs: pd.Series(_score(weights, xs.tolist())), "double")
            rows = docs.select(F.struct("*").alias("_row"), text_hash(F.col(text)).alias("h")).join(x.select("h", score("x").alias("s")), "h")
            row = F.col("_row")
            row = row.withField("held_out", held_out(row)).withField("score", F.col("s")).withField("predicted", (F.col("s") >= THRESHOLD).cast("int"))
            return rows.select(row.alias("_row")).select("_row.*")

        return with_features, scored

    counted = counts.toPandas()
    model = counts.sparkSession.sparkContext.broadcast(likelihood_ratios(*(counted[c].to_numpy() for c in ("key", "toxic", "plain"))))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*model.value)
        for batch in batches:
            x = [scorer.features(t) for t in batch["text"]]
            yield pd.DataFrame(x, columns=names).assign(y=batch["toxic"].to_numpy())

    def with_features(rows: DataFrame) -> DataFrame:
        return rows.mapInPandas(learn, ", ".join(f"{n} double" for n in names) + ", y int")

    def scored(docs: DataFrame, text: str, weights: np.ndarray, held_out: Callable) -> DataFrame:
        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            scorer = Scorer(*model.value)
            for batch in batches:
                yield pd.Series(_score(weights, [scorer.features(t) for t in batch]))

        out = docs.withColumn("held_out", held_out(docs)).withColumn("score", score(F.col(text)))
        return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

    return with_features, scored


def fold(key):
    """0 to 3 by the checksum of the key as text; null keys fall where the empty text does."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", broadcast_most: int = MODEL_BOUND) -> DataFrame:
    """All columns of every document with ``held_out``, ``score`` (0 to 1) and ``predicted``.

    All labelled rows outside the held-out fold teach the n-gram counts (by Spark).
    The calibration is fitted to at most about FIT_BOUND rows, by hash, of one of these
    folds, with features under a model of the other two, so that no row is judged by
    its own counts. Each class has a Kneser-Ney model over letters; what a class saw rarely
    or never falls back on continuation counts that both share. A score compares the
    log-likelihoods under both, per byte, of the whole text, of its most toxic
    passages and of its most toxic words, so that a long text hides nothing. A word
    counts once a document, else one text that repeats itself would speak for its
    class. The model holds every distinct n-gram under its own key and grows with the
    input: up to ``broadcast_most`` n-grams are sent to all tasks, more are joined
    with those of the documents.

    Null and empty texts have no letters and score as their features of zero do; null
    labels teach nothing; a key labelled twice takes the larger label; without any
    label of one class every score is the share of toxic labels; an empty table gives
    an empty result; columns named like the new ones are replaced.
    """
    known = (
        labels.where(F.col(toxic).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key)) != 2))
        .groupBy(F.col(key).alias("_key")).agg((F.max(F.col(toxic)) > 0).cast("int").alias("toxic"))
    )
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text"))
    small = known.count() <= LABEL_BOUND
    taught = rows.join(F.broadcast(known) if small else known, F.col("_id") == F.col("_key"))
    fits = fold(F.col("_id")) == 3
    counts = cut(_ngram_counts(taught.select("text", "toxic", fits.alias("fits"))))
    others = counts.select("key", F.col("toxic_fit").alias("toxic"), F.col("plain_fit").alias("plain")).where(F.col("toxic") + F.col("plain") > 0)
    with_features, _ = _under(others, broadcast_most)
    _, scored = _under(counts.select("key", "toxic", "plain"), broadcast_most)

    third = known.where(fold(F.col("_key")) == 3)
    step = max(1, -(-third.count() // FIT_BOUND))
    fit = taught.where(fits & (F.pmod(F.xxhash64("_id"), F.lit(step)) == 0)).select("text", "toxic")
    sample = with_features(fit).toPandas()
    y = sample["y"].to_numpy(np.float64)
    if len(set(y)) < 2:
        base = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        weights = np.array([np.log(base / (1 - base)) if 0 < base < 1 else -30.0, *[0.0] * FEATURES])
    else:
        sample = sample.sort_values(list(sample.columns))  # so that reruns add in the same order
        weights = _calibrate(sample.to_numpy(np.float64)[:, :FEATURES] * SCALE, sample["y"].to_numpy(np.float64))

    return scored(docs, text, weights, lambda row: fold(row[key]) == 2)


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents not predicted toxic, with their own columns."""
    scored = toxicity(docs.select(F.struct("*").alias("_row"), F.col(key).alias(key), F.col(text).alias(text)), labels, key, text)
    return scored.where(F.col("predicted") == 0).select("_row.*")
