"""License scans against plain loops and edit distances."""

import random
import re

import pytest

from vantry.llm import notices as N

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    words = words_of(text)
    found = []
    for n in N.PHRASES:
        phrase = n.words.split(" ")
        found += [(i, n.label) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    return len(words), found


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def fewest(text, notice):
    """Fewest edits of any run of whole words, or None beyond the bound."""
    words, best = words_of(text), None
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            part = " ".join(words[i:j])
            if len(part) > len(notice.words) + notice.edits:
                break
            if len(part) >= len(notice.words) - notice.edits:
                d = distance(part, notice.words)
                if d <= notice.edits and (best is None or d < best):
                    best = d
    return best


SHORT = [N.Notice("mit", "released under the mit license", 3), N.Notice("arr", "all rights reserved", 1), N.Notice("cc", "licensed under cc by", 2)]


def damaged(rng, words, edits):
    s = list(words)
    for _ in range(edits):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice("abc xyz")
        elif kind == 1:
            s.insert(at, rng.choice("abc xyz"))
        else:
            del s[at]
    return "".join(s)


def fixture():
    rng = random.Random(4)
    texts = []
    for k in range(260):
        filler = lambda: " ".join(rng.choice(["the", "under", "license", "all", "rights", "is", "reserved", "mit", "by", "cc"]) for _ in range(rng.randint(0, 6)))
        n = rng.choice(SHORT)
        t = f"{filler()} {damaged(rng, n.words, rng.randint(0, n.edits + 2))} {filler()}"
        texts.append(t.upper() if k % 5 == 0 else t.replace(" ", " \n- ") if k % 7 == 0 else t)
    return texts


def test_fewest_edits_of_every_notice(spark):
    texts = fixture()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = 0
    for r in N.scan(df, SHORT).collect():
        for k, n in enumerate(SHORT):
            found = [f.edits for f in r.found if f.notice == k]
            want = fewest(texts[r.doc_id], n)
            assert (min(found) if found else None) == want, (texts[r.doc_id], n)
            hits += want is not None
        for f in r.found:
            part = words_of(texts[r.doc_id])[f.first_word : f.last_word + 1]
            assert distance(" ".join(part), SHORT[f.notice].words) == f.edits
            assert words_of(texts[r.doc_id][f.start : f.end]) == part
    assert hits > 120


def test_query_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts |= {10**6: "MIT License. Apache-License; cc by cc BY! gnu general\npublic license mit licenses amit license", 10**6 + 1: "released under teh MIT licence", 10**6 + 2: None, 10**6 + 3: "Ünder cc by—by é"}
    rows = N.digest(N.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, found = base(texts[r.doc_id])
        places, labels = [i for i, _ in found], sorted({x for _, x in found})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(found), min(places, default=None), max(places, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) - {""} and 0 <= r.score <= 1 and (r.score == 1 or not found)
    got = {r.doc_id: r for r in rows}
    assert got[10**6].n_base == 5 and got[10**6 + 1].labels == "mit" and got[10**6 + 1].base_labels == "" and got[10**6 + 1].score < 1


def test_nearest_part_of_a_window():
    rng = random.Random(6)
    for _ in range(300):
        words, window = ("".join(rng.choice("ab ") for _ in range(n)) for n in (rng.randint(1, 12), rng.randint(0, 20)))
        parts = [window[i:j] for i in range(len(window) + 1) for j in range(i, len(window) + 1)]
        assert N.nearest(words, window) == min(distance(p, words) for p in parts)


def test_pieces_cover_the_notice():
    for n in N.NOTICES:
        parts = N.pieces(n.words, n.edits)
        assert len(parts) == n.edits + 1 and "".join(p for _, p in parts) == n.words and min(len(p) for _, p in parts) >= 7


@pytest.mark.parametrize("notices", [None, []])
def test_odd_rows(spark, notices):
    rows = [(1, None, "a"), (1, None, "a"), (None, "", "b"), (2, "mit license " * 30_000, "c"), (3, "\x00 \x7f--", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = N.scan(df, notices).collect()
    assert len(got) == 5 and sorted(r.n_words for r in got) == [0, 0, 0, 0, 60_000]
    assert max(len(r.found) for r in got) == (30_000 if notices is None else 0)
    assert N.scan(df.limit(0), notices).count() == 0
