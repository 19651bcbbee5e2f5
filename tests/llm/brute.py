"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NO_ITEMS = hashlib.sha256(b"").hexdigest()


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def contamination(docs, items):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows = {}
    for item, text in items:
        w = alnum_words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w = alnum_words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i:i + n]))
                if names:
                    hit.update(range(i, i + n))
                    found |= names
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def shingles(text):
    w = spaced_words(text)
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard_components(docs):
    """{doc_id: (n_shingles, component_id)}, every pair that shares a shingle compared."""
    sets = {d: shingles(t) for d, t in docs}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    shared = {}
    for d, s in sorted(sets.items()):
        for x in s:
            for e in holders[x]:
                if e > d:
                    shared[d, e] = shared.get((d, e), 0) + 1
    u = Union()
    for (d, e), n in shared.items():
        if 100 * n >= 80 * (len(sets[d]) + len(sets[e]) - n):
            u.join(d, e)
    return {d: (len(s), u.find(d)) for d, s in sets.items()}
