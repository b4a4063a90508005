"""The pipeline against plain Python, stage by stage."""

from collections import Counter

import corpus_pipeline
from tests.llm import plain
from tests.llm.test_mixing import rounds
from vantry.llm import mixing, pieces, toxicity
from vantry.llm.common import read


def test_stages_against_plain(spark, folder):
    docs, outs = read(spark, folder, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        outs.append(docs.collect())
        if name != "sentencepiece":
            assert docs.columns == columns
    clean, single, cut, mixed, encoded = outs

    scored = toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels")).collect()
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in scored if not r.predicted)

    _, names = plain.near_copies([(r.doc_id, r.text) for r in clean])
    assert sorted(r.doc_id for r in single) == sorted(set(names.values()))

    gone = plain.repeats([(r.doc_id, r.text) for r in single], 256)  # passages of over 50 words
    before = {r.doc_id: r for r in single}
    assert sorted(r.doc_id for r in cut) == sorted(before)
    for r in cut:
        raw = before[r.doc_id].text.encode()
        spans = [(a, b) for a, b in plain.runs(gone[r.doc_id][4]) if len(raw[a:b].split()) > 50]
        covered = {i for a, b in spans for i in range(a, b)}
        rest = bytes(b for i, b in enumerate(raw) if i not in covered).decode("utf-8", "ignore")
        assert r.n_chars == len(r.text) and abs(len(r.text) - len(rest)) <= 2 * len(spans)
        assert r.text == before[r.doc_id].text if not covered else len(r.text) < len(before[r.doc_id].text)

    copies = Counter(r.doc_id for r in mixed)
    sizes, taken, largest = Counter(), Counter(), 0
    for r in cut:
        n = len(plain.WORD.findall(r.text))
        sizes[r.source] += n
        taken[r.source] += n * copies[r.doc_id]
        largest = max(largest, n)
        assert copies[r.doc_id] <= 2
    for s, t in rounds(dict(sizes)).items():
        assert abs(taken[s] - t) <= largest / 2
    assert all(dict(r.asDict()) in [x.asDict() for x in cut] for r in mixed[:20])

    machine = pieces.Transducer.load()
    text = {r.doc_id: r.text for r in mixed}
    assert Counter(r.doc_id for r in encoded) == copies
    assert all(machine.decode(r.ids) == text[r.doc_id] for r in encoded if r.round_trip)
    assert all(r.round_trip or "▁" in text[r.doc_id] for r in encoded)


def test_empty_and_odd_documents(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        assert docs.count() >= 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "mixing", "sentencepiece"]
    assert mixing.SHARE == 1.5 and corpus_pipeline.ORACLE_SQL is None


def test_null_and_repeated_ids(spark, folder):
    long = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [
        (None, long("a"), "en", "s", 1), (None, long("b"), "en", "s", 1), (None, long("b"), "en", "s", 1), (None, long("c"), "en", "s", 1),
        (4, long("c"), "en", "s", 1), (5, long("d"), "en", "s", 1), (5, long("c"), "en", "s", 1), (5, long("d"), "en", "t", 1), (6, long("e"), "en", "s", 1), (6, long("e"), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text[0]) for r in corpus_pipeline.drop_near_copies(spark, docs, folder).collect())
    assert got == Counter([(None, "a"), (None, "b"), (4, "c"), (5, "d"), (6, "e")])


def test_mix_of_ids_in_two_sources(spark, folder):
    rows = [(k, "w " * 9, "en", s, 18) for k in range(40) for s in "abc"] + [(None, "w " * 9, "en", "a", 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert Counter((r.doc_id, r.source) for r in corpus_pipeline.mix_sources(spark, docs, folder).collect()) == want
