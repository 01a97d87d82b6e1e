"""BK-trees over short binary codes: children keyed by integer Hamming distance to the parent."""

from __future__ import annotations

import numpy as np

#: A subtree of at most so many codes is kept as one array and compared at once.
LEAF = 6


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unsigned codes; the shapes broadcast."""
    return np.bitwise_count(a ^ b).astype(np.int16)


class BKTree:
    """A tree over the rows of an array of different codes. Its first row is the pivot; the others hang below it by
    distance. compared counts the comparisons of searches, of the whole tree at its root."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray | None = None):
        self.codes, self.compared = codes, 0
        self.rows = np.arange(len(codes)) if rows is None else rows
        self.children: dict[int, BKTree] = {}
        self.leaf = len(self.rows) <= LEAF
        if not self.leaf:
            away = hamming(codes[self.rows[1:]], codes[self.rows[0]])
            for d in np.unique(away):
                self.children[int(d)] = BKTree(codes, self.rows[1:][away == d])

    def search(self, queries: np.ndarray, radius: int, which: np.ndarray | None = None, top: BKTree | None = None):
        """Yields (positions in queries, rows of the tree) of everything within radius. All queries that reach a node
        are compared with its pivot at once, and each goes on along the edges d with |d - distance| <= radius only."""
        top = top or self
        which = np.arange(len(queries)) if which is None else which
        if not len(which):
            return
        if self.leaf:
            top.compared += len(which) * len(self.rows)
            for at in range(0, len(which), 65536):
                some = which[at : at + 65536]
                q, r = np.nonzero(hamming(queries[some][:, None], self.codes[self.rows][None, :]) <= radius)
                yield some[q], self.rows[r]
            return
        top.compared += len(which)
        away = hamming(queries[which], self.codes[self.rows[0]])
        near = which[away <= radius]
        yield near, np.full(len(near), self.rows[0])
        for d, child in self.children.items():
            yield from child.search(queries, radius, which[np.abs(away - d) <= radius], top)


def _postings(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different codes, rows in order of code, where each code's rows begin, how many they are)."""
    order = np.argsort(codes, kind="stable")
    distinct, first, count = np.unique(codes[order], return_index=True, return_counts=True)
    return distinct, order, first, count


def _expand(q: np.ndarray, r: np.ndarray, left, right) -> tuple[np.ndarray, np.ndarray]:
    """All (row of left, row of right) behind pairs of different codes."""
    (_, lo, lf, lc), (_, ro, rf, rc) = left, right
    n = lc[q] * rc[r]
    pair = np.repeat(np.arange(len(q)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    width = rc[r][pair]
    return lo[lf[q][pair] + k // width], ro[rf[r][pair] + k % width]


def _near(queries: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    found = list(BKTree(codes).search(queries, radius))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def pairs_within(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of rows (first < second) within radius of each other; equal codes are one node of the tree."""
    own = _postings(codes)
    q, r = _near(own[0], own[0], radius)
    a, b = _expand(q, r, own, own)
    return a[a < b], b[a < b]


def pairs_across(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Every (row of left, row of right) within radius; the tree is of the left codes."""
    if not len(left) or not len(right):
        return np.zeros(0, int), np.zeros(0, int)
    own, other = _postings(left), _postings(right)
    q, r = _near(other[0], own[0], radius)
    b, a = _expand(q, r, other, own)
    return a, b
