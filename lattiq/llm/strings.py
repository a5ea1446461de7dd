"""Edit distance over many pairs at once, and a BK-tree that is searched for many strings at once.

The distance is Levenshtein's, a true metric, by Myers' bit-parallel recurrence over numpy arrays: one machine word per
pair, one step per character of the longer side. Strings beyond 64 characters go through a plain table, one by one.
"""

from __future__ import annotations

import numpy as np

_WORD = 64


def _plain(a: str, b: str) -> int:
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y)))
        previous = row
    return previous[-1]


class Strings:
    """Strings as an array of code numbers (0: none), shared alphabet, for distances()."""

    def __init__(self, texts: list[str], alphabet: dict[str, int] | None = None):
        self.texts = texts
        self.alphabet = {} if alphabet is None else alphabet
        self.lengths = np.array([len(t) for t in texts], np.int64)
        width = min(_WORD, int(self.lengths.max(initial=0)))
        self.codes = np.zeros((len(texts), width), np.int32)
        for i, t in enumerate(texts):
            if len(t) <= _WORD:
                self.codes[i, : len(t)] = [self.alphabet.setdefault(c, len(self.alphabet) + 1) for c in t]


def distances(a: Strings, ia: np.ndarray, b: Strings, ib: np.ndarray) -> np.ndarray:
    """Edit distance of a.texts[ia[k]] and b.texts[ib[k]] for each k; a and b must share one alphabet."""
    la, lb = a.lengths[ia], b.lengths[ib]
    out = np.empty(len(ia), np.int64)
    long = (la > _WORD) | (lb > _WORD)
    for k in np.flatnonzero(long):
        out[k] = _plain(a.texts[ia[k]], b.texts[ib[k]])
    short = np.flatnonzero(~long)
    if not len(short):
        return out
    pattern, text, m, n = a.codes[ia[short]], b.codes[ib[short]], la[short], lb[short]
    one = np.uint64(1)
    top = one << (np.maximum(m, 1) - 1).astype(np.uint64)
    vp, vn, score = np.full(len(short), ~np.uint64(0)), np.zeros(len(short), np.uint64), m.copy()
    weights = one << np.arange(pattern.shape[1], dtype=np.uint64)
    for j in range(int(n.max(initial=0))):
        live = j < n
        eq = ((pattern == text[:, j : j + 1]) * weights).sum(axis=1, dtype=np.uint64)
        x = eq | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hn, hp = vp & d0, vn | ~(vp | d0)
        score += np.where(live, ((hp & top) != 0).astype(np.int64) - ((hn & top) != 0).astype(np.int64), 0)
        hp = (hp << one) | one
        vp_next = (hn << one) | ~(d0 | hp)
        vn_next = d0 & hp
        vp, vn = np.where(live, vp_next, vp), np.where(live, vn_next, vn)
    out[short] = np.where(m == 0, n, score)
    return out


class BKTree:
    """Burkhard-Keller tree over distinct strings. Node 0 is the root; children hang at their distance to the parent."""

    def __init__(self, texts: list[str]):
        self.nodes = Strings(sorted(set(texts)))
        n = len(self.nodes.texts)
        # built level by level: every string not yet placed goes below the node it last met, by its distance to it
        parent, at = np.full(n, -1), np.zeros(n, np.int64)
        rest = np.arange(1, n)
        below = np.zeros(len(rest), np.int64)
        while len(rest):
            d = distances(self.nodes, rest, self.nodes, below)
            order = np.lexsort((rest, d, below))
            rest, below, d = rest[order], below[order], d[order]
            first = np.ones(len(rest), bool)
            first[1:] = (below[1:] != below[:-1]) | (d[1:] != d[:-1])
            parent[rest[first]], at[rest[first]] = below[first], d[first]
            heads = rest[first][np.cumsum(first) - 1]
            rest, below = rest[~first], heads[~first]
        order = np.argsort(parent, kind="stable")
        self.child, self.edge = order[parent[order] >= 0], at[order[parent[order] >= 0]]
        owners = parent[self.child]
        self.start, self.end = np.searchsorted(owners, np.arange(n), "left"), np.searchsorted(owners, np.arange(n), "right")

    def within(self, texts: list[str], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in texts, node, distance) of every node within threshold of each text; subtrees are pruned by the triangle inequality."""
        queries = Strings(texts, self.nodes.alphabet)
        if not len(texts) or not len(self.nodes.texts):
            return (np.empty(0, np.int64),) * 3
        found = []
        q, v = np.arange(len(texts)), np.zeros(len(texts), np.int64)
        while len(q):
            d = np.concatenate([distances(queries, q[i : i + 65536], self.nodes, v[i : i + 65536]) for i in range(0, len(q), 65536)])
            hit = d <= threshold
            found.append((q[hit], v[hit], d[hit]))
            n = self.end[v] - self.start[v]
            slot = np.repeat(self.start[v], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, d, v, edge = np.repeat(q, n), np.repeat(d, n), self.child[slot], self.edge[slot]
            keep = np.abs(edge - d) <= threshold
            q, v = q[keep], v[keep]
        return tuple(np.concatenate(x) for x in zip(*found))
