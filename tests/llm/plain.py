"""Plain Python versions of the operators, for comparison on small inputs."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def simhash(text):
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(keys, linked):
    """Smallest key reachable, by walking all pairs."""
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {k: root(k) for k in keys}


def near_copies(docs):
    prints = {d: simhash(t) for d, t in docs}
    return prints, groups(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)


def repeats(docs, span):
    """doc: (bytes, removed, runs, digest of the rest, covered positions)."""
    places = {}
    raws = {d: (t or "").encode() for d, t in docs}
    for d, raw in raws.items():
        for i in range(len(raw) - span + 1):
            places.setdefault(raw[i : i + span], []).append((d, i))
    gone = {d: set() for d in raws}
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d].update(range(i, i + span))
    return {
        d: (len(raw), len(gone[d]), sum(i - 1 not in gone[d] for i in gone[d]),
            hashlib.sha256(bytes(b for i, b in enumerate(raw) if i not in gone[d])).hexdigest(), gone[d])
        for d, raw in raws.items()
    }


def runs(covered):
    """Maximal ranges of a set of positions."""
    starts = sorted(i for i in covered if i - 1 not in covered)
    ends = sorted(i + 1 for i in covered if i + 1 not in covered)
    return list(zip(starts, ends))
