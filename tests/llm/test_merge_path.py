"""Alignment against token-by-token loops and the tokenizers' own output."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vantry.llm import merge_path as M

SPECIAL = ["<|endoftext|> </s> <s><unk>", "a\x00b", "▁mark", " lead", "tail \n\t ", "日本語テキスト, 🙂🙂é", "x" * 3000, " " * 5000, "'s 'll don't  1234567 \r\n", "<0x41>"]


def tokenize(texts):
    a = Tokenizer.from_file(M.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=M.PIECE_BPE)
    letters = M._letters()
    for t in texts:
        ids = a.encode(" " + (t or ""), add_special_tokens=False).ids
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids]
        pieces = b.encode(t or "")
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        want = b" " + (t or "").encode()
        yield ((ids, raw_a), (pieces, raw_b)) if t and b"".join(raw_a) == want == b"".join(raw_b) else (([], []), ([], []))


def plain(docs):
    parts = []
    for d, ((a, raw_a), (b, raw_b)) in zip([d for d, _ in docs], tokenize([t for _, t in docs])):
        ends_a = np.cumsum([len(x) for x in raw_a], dtype=int).tolist()
        ends_b = np.cumsum([len(x) for x in raw_b], dtype=int).tolist()
        shared = sorted(set(ends_a) & set(ends_b))
        groups, links, i, j = [], [], 0, 0
        for end in shared:
            i2, j2 = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(f"{','.join(map(str, a[i:i2]))}|{','.join(map(str, b[j:j2]))}")
            links.append((a[i2 - 1], b[j2 - 1]))
            i, j = i2, j2
        parts.append((d, len(a), len(b), groups, links))
    counts = Counter(x for p in parts for x in p[4])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (d, na, nb, len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "")
        for d, na, nb, g, links in parts]


def test_whole_table(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10**6 + k, t) for k, t in enumerate([*SPECIAL, None, "", SPECIAL[5], SPECIAL[5]])] + [(None, "null id"), (3, "same id")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_a int").repartition(5)
    got = M.link_counts(df)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = plain(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[3] > 10 for w in want) > 100 and sum(w[1] == 0 for w in want) >= 3
    assert M.link_counts(df.limit(0)).count() == 0


@pytest.mark.parametrize("steps", [1, 3, 64])
def test_merge_of_any_piece_size(steps):
    rng = random.Random(steps)
    for _ in range(60):
        total = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, total + 1), rng.randint(1, total)), total})) for _ in range(2))
        at = M.cuts(a, b, steps)
        merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        assert [(i, j) for i, j in zip(at.a.tolist(), at.b.tolist())] == [
            (sum(not s for _, s in merged[:d]), sum(s for _, s in merged[:d])) for d in range(0, len(merged), steps)]
        start = lambda ends, k: int(ends[k - 1]) if k else 0
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(start(a, i), start(b, j)) < min(a[i], b[j])]
        m = M.merge(a, b, steps)
        assert list(zip(m.a.tolist(), m.b.tolist())) == want
        shared = sorted(set(a.tolist()) & set(b.tolist()))
        assert m.group.tolist() == [sum(e <= start(a, i) for e in shared if e <= start(b, j)) for i, j in want]
        assert m.ends.tolist() == [a[i] == b[j] for i, j in want]


def test_aligned_lists(spark):
    docs = [(k, t) for k, t in enumerate([*SPECIAL, "Some words, aligned twice.", None])]
    got = {r.doc_id: r for r in M.align(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()}
    for (d, t), ((a, raw_a), (b, raw_b)) in zip(docs, tokenize([t for _, t in docs])):
        r = got[d]
        assert (r.a_ids, r.b_ids) == (a, b)
        raw = b" " + (t or "").encode()
        for g in r.groups:
            assert b"".join(raw_a[g.a_from : g.a_to]) == b"".join(raw_b[g.b_from : g.b_to]) == raw[g.byte_from : g.byte_to]
        if a:
            assert [g.byte_from for g in r.groups] == [0] + [g.byte_to for g in r.groups[:-1]] and r.groups[-1].byte_to == len(raw)
            assert {o.a for o in r.overlaps} == set(range(len(a))) and {o.b for o in r.overlaps} == set(range(len(b)))


def test_bound_of_pairs():
    a, b = [b"a", b"ba", b""], [b"a", b"ba", b"cba", b"a"]
    assert M.most_pairs(a, b) == sum(bool(x) and bool(y) and (x.endswith(y) or y.endswith(x)) for x in a for y in b)
    use = M.load(open(M.BYTE_BPE, "rb").read(), open(M.PIECE_BPE, "rb").read())
    assert use.fast is not None and M.most_pairs(use.a, use.b) < 1_000_000
