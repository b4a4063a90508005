"""Quality rules: a table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

# Frequent function words of four languages (chosen for this operator).
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he",
    "this", "are", "or", "at", "from",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "dans", "en", "pour", "par", "sur", "au",
    "avec", "est", "pas", "ne", "ce",
    "der", "die", "das", "und", "den", "mit", "von", "für", "auf", "ist", "im", "nicht", "ein", "eine", "sich", "dem",
    "el", "los", "las", "del", "y", "una", "con", "no", "para", "se", "al", "su", "lo",
]


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures must lie in [low, high] once the text has ``from_words`` words."""

    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = [
    Rule("mean_word_length", "word_chars", "n_words", low=2.0, high=15.0, from_words=10),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("stop_word_share", "n_stop_words", "n_words", low=0.06, from_words=30),
    Rule("repeated_line_share", "n_dup_lines", "n_lines", high=0.4),
    Rule("ended_line_share", "n_ended_lines", "n_lines", low=0.5),
]


def _repeated_window_words(found: Column, width: int) -> Column:
    """Words lying in windows of ``width`` words that occur twice or more in the array."""

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

        def union(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width)))),
                F.lit(0), lambda total, x: total + x,
            )

        return let(let(ordered, places), union)

    def count(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - width),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]),
        )
        return F.when(F.size(w) <= width, F.lit(0)).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        )

    return let(found, count)


def measures(t: Column, w: Column) -> dict[str, Column]:
    """Counts from which the rules take their ratios, of a text and the array of its words."""
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeated_window_words(w, 5),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))),
        "n_ended_lines": F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;\"»”…)][\x20\x09-\x0D]*\z"))),
    }


def verdict(rules: list[Rule]) -> Column:
    """The threshold table as one boolean column; measures with an empty bottom pass."""
    passed = F.lit(True)
    for r in rules:
        top, bottom = F.col(r.top).cast("double"), F.col(r.bottom).cast("double")
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (top >= r.low * bottom)
        if r.high is not None:
            ok = ok & (top <= r.high * bottom)
        passed = passed & (ok if not r.from_words else (F.col("n_words") < r.from_words) | ok)
    return passed


def quality(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Measures and verdict of every whole text, without shuffle and without user functions.

    Columns: the key, the measures, ``base_failed`` (under 10 words, or over a fifth
    of the words in repeated five-word windows) and ``kept`` (base passed and every
    rule holds). Null and empty texts have no words and fail; repeated rows are
    judged one by one; an empty table gives an empty result; further columns of the
    input are left out, whatever their names.
    """
    split = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"), words(F.col(text)).alias("_w"))
    counts = split.select(F.col(key), *[m.cast("long").alias(n) for n, m in measures(F.col("_t"), F.col("_w")).items()])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(RULES if rules is None else rules))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 4)) AS i, w FROM d WHERE len(w) >= 6),
keyed AS (SELECT doc_id, i, w[i:i+4] AS k FROM win),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest([0, 1, 2, 3, 4]) AS j) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: list_contains({stop}, lower(x))))::BIGINT AS n_stop_words,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[.!?:;"»”…)][\x20\x09-\x0D]*\z')))::BIGINT AS n_ended_lines
  FROM d LEFT JOIN cover USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed
  AND (n_words < 10 OR (word_chars >= 2.0 * n_words AND word_chars <= 15.0 * n_words))
  AND n_symbols::DOUBLE <= 0.1::DOUBLE * n_words
  AND (n_words < 30 OR n_stop_words::DOUBLE >= 0.06::DOUBLE * n_words)
  AND n_dup_lines::DOUBLE <= 0.4::DOUBLE * n_lines
  AND n_ended_lines::DOUBLE >= 0.5::DOUBLE * n_lines AS kept
FROM v
""".replace("{stop}", str(STOP_WORDS))
