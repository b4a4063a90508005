"""Quality measures against plain counting."""

import random
import re
from collections import Counter

from vantry.llm import quality_rules as Q


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_against_plain(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\x0b\x0c\r\n", "a", "a b c d e", "a b c d e f", "x " * 5, "x " * 6, "x " * 30_000, "\x85 \u00a0 b", "😀 é #|<", "a\nb\na\n\n a\na"]
    for _ in range(250):
        texts.append("".join(rng.choice(["a", "b", "c", " ", " ", " ", "\n", "#", "the "]) for _ in range(rng.randint(1, 120))))
    df = spark.createDataFrame([(k, t, 5, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    for r in Q.quality(df).collect():
        n, chars, symbols, dup, rep = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), texts[r.doc_id]
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n) and not (r.kept and r.base_failed)
    assert Q.quality(df.limit(0)).count() == 0


def test_one_stage_without_python(spark):
    plan = Q.quality(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas", plan)


def test_rules_are_data(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten. "), (2, "the " + "#a " * 12 + ".")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in Q.quality(df).collect()} == {1: True, 2: False}
    strict = [Q.Rule("long", "word_chars", "n_words", low=9.0)]
    assert {r.kept for r in Q.quality(df, strict).collect()} == {False}
