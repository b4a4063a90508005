"""Pieces against the public tokenizer library, unigram paths against all paths, and round trips."""

import itertools
import random

import pytest

from vantry.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def texts():
    rng = random.Random(1)
    letters = "abcdefgh eé漢字▁ \n\t<>0123456789AZ😀ßñ'.,tion the in of"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    out += [" " * k + "a" + " " * k for k in range(20)] + ["a" * k for k in range(60)] + ["", " ", "\n\n", "=" * 90, "the" * 40, "\x00a", "<s> </s> <0x41>"]
    return out


def test_library_agrees(spark, library, folder):
    given = texts() + [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encode(df).collect()}
    for k, t in enumerate(given):
        assert got[k].ids == library.encode(t), t[:60]
        assert got[k].round_trip == (library.decode(got[k].ids) == t)
        assert got[k].n_pieces == len(got[k].ids) and got[k].n_bytes == sum(library.is_byte(i) for i in got[k].ids)


def test_decode_column(spark, library):
    rng = random.Random(2)
    ids = [library.encode(t) for t in texts()[:80]] + [[rng.randrange(3, 32000) for _ in range(9)] for _ in range(40)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(ids)] + [(-1, None)], "k long, ids array<int>")
    got = {r.k: r.text for r in pieces.decode(df).collect()}
    assert got.pop(-1) == ""
    # stray byte pieces decode to replacement characters, whose number is the decoder's own choice
    for k, x in enumerate(ids):
        if "�" not in library.decode(x):
            assert got[k] == library.decode(x)


def test_unigram_takes_the_least_path():
    rng = random.Random(6)
    made = [("<unk>", 0.0, pieces.UNKNOWN), *[(c, -rng.uniform(3, 6), pieces.NORMAL) for c in "▁ab"]]
    names = {"".join(p) for n in (2, 3) for p in itertools.product("▁ab", repeat=n) if "▁" not in p[1:]}
    made += [(p, -rng.uniform(1, 9), pieces.NORMAL) for p in sorted(names)]
    machine = pieces.Transducer(made, pieces.UNIGRAM)
    score = {p: s for p, s, kind in made if kind == pieces.NORMAL}

    def best(s):
        if not s:
            return 0.0
        return max(score[s[:n]] + best(s[n:]) for n in range(1, min(3, len(s)) + 1) if s[:n] in score)

    for _ in range(40):
        t = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9)))
        ids = machine.encode(t)
        assert sum(made[i][1] for i in ids) == pytest.approx(best("▁" + t.replace(" ", "▁")))
        assert machine.decode(ids) == t
    assert machine.encode("aca").count(0) == 1


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 3), (1, None, 3), (2, "", 4), (None, "long " * 60_000, 5)], "doc_id long, text string, ids int")
    got = pieces.encode(df).collect()
    assert sorted(r.n_pieces for r in got)[:3] == [0, 0, 0] and max(r.n_pieces for r in got) >= 60_000
    assert all(r.round_trip for r in got) and got[0].asDict().keys() == {"doc_id", "text", "ids", "n_pieces", "n_bytes", "round_trip"}
    assert pieces.encode(df.limit(0)).count() == 0
