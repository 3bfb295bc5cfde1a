"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import re
import zlib

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def low(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def simhash(text, size):
    w = WORD.findall(low(text))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def sizes_allow(a, b, equal, similarity):
    low, high = sorted((a, b))
    return low >= similarity * high and (equal or low < high or low - 1 >= similarity * (low + 1))


def shingles(text, size):
    n = len(words(text))
    return max(n - size + 1, 1) if n else 0


def components(fps, most, sizes=None, similarity=None):
    """{id: smallest id reachable} of {id: fingerprint}."""
    ids = sorted(fps)
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= most and (sizes is None or sizes_allow(sizes[i], sizes[j], fps[i] == fps[j], similarity)):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: root(i) for i in ids}


def kept_words(docs, window=13):
    """{id: (words, kept words)} of {id: text}."""
    first = {}
    for i in sorted(docs):
        w = words(docs[i])
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, text in docs.items():
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (w, [x for k, x in enumerate(w) if k not in gone])
    return out


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
