"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np


def top_k(rows, k=20, every=20, scale=64):
    """(query_id, rank, vec_id, score) by comparing everything."""
    good = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(set(out))


def top_k_by_id(rows, k=20, every=20, scale=64):
    """The same with repeated query ids: each different vector of an id asks, and the id's best answers of all count."""
    good = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        asks = {tuple(v) for i, v in good if i == q}
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for a in asks for i, b in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def dedup(rows, window=50):
    """[(doc_id, n_words, n_removed, kept)] of (doc_id, text) rows."""
    least: dict[tuple, int] = {}
    words = [(i, [] if t is None else t.encode().split()) for i, t in rows]
    for i, w in words:
        if i is not None:
            for p in range(len(w) - window + 1):
                key = tuple(w[p : p + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        if i is not None:
            for p in range(len(w) - window + 1):
                if least[tuple(w[p : p + window])] < i:
                    keep[p : p + window] = [False] * window
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((i, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return out


def shingles(text, size=5):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = raw.split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[p : p + size]) for p in range(len(w) - size + 1)) or frozenset([tuple(w)])


def jaccard_components(rows, percent=75):
    """[(doc_id, n_shingles, component_id)] of (doc_id, text) rows."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        if i is None:
            continue
        shared = Counter(o for t in s for o in holders[t])
        for o, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[o][1]) - k):
                parent[root(n)] = root(o)
        for t in s:
            holders[t].append(n)
    least: dict[int, int] = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            least[root(n)] = min(least.get(root(n), i), i)
    return [(i, len(s), None if i is None else least[root(n)]) for n, (i, s) in enumerate(sets)]


def sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
