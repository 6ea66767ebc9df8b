"""Exact top-k by inner product over a bit-sliced index.

The index keeps, for each block of rows, one bitmap for every bit of every quantised attribute. A query's score is the weighted sum of those
bitmaps, added with carry-save bitmap arithmetic; the sum is itself bit-sliced, so the k-th best value is found from the most significant slice
downward. Quantisation leaves a proven error bound: rows whose sum lies within it of the k-th are the boundary, resolved with exact integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from kinelake.llm.blocks import clean, searched
from kinelake.llm.common import Scratch, ship

ship(__name__)

#: Most slices kept of an attribute; beyond LARGE the boundary's scores are added as integers of any size; components from HUGE on are no 64-bit integers.
SLICES, LARGE, HUGE = 6, 1 << 27, 1 << 61


class BitSlices:
    """x: integers, rows by attributes."""

    def __init__(self, x: np.ndarray):
        n, d = x.shape
        u = x - x.min(0)
        top = int(u.max()).bit_length() if u.size else 0
        self.bits, self.shift = max(1, min(top, SLICES)), max(0, top - SLICES)
        u >>= self.shift
        words = -(-n // 64)
        planes = np.zeros((2, d, self.bits, words * 8), np.uint8)
        for b in range(self.bits):
            planes[0, :, b, : -(-n // 8)] = np.packbits(((u >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        valid = np.zeros(words * 8, np.uint8)
        valid[: -(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
        self.valid = valid.view(np.uint64)
        self.planes = planes.view(np.uint64)
        self.planes[1] = ~self.planes[0] & self.valid
        self.flat, self.n = self.planes.reshape(-1, words), n

    def total(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of the sum of |q| times the attribute, or its complement where q is negative."""
        d = len(q)
        size = np.abs(q)
        b = np.arange(self.bits)
        plane = ((q < 0)[:, None] * d + np.arange(d)[:, None]) * self.bits + b
        levels: dict[int, list] = {}
        for c in range(int(size.max()).bit_length()):
            own = plane[(size >> c) & 1 == 1]
            for j in b:
                levels.setdefault(int(j) + c, []).append(own[:, j])
        out, carried, w = [], [], 0
        while w <= max(levels, default=-1) or carried:
            p = self.flat[np.concatenate(levels[w])] if w in levels else self.flat[:0]
            if carried:
                p = np.concatenate([p, *carried])
            carried = []
            while len(p) > 2:
                t = len(p) // 3
                x, y, z = p[:t], p[t : 2 * t], p[2 * t : 3 * t]
                xy = x ^ y
                carried.append((x & y) | (xy & z))
                p = np.concatenate([xy ^ z, p[3 * t :]])
            if len(p) == 2:
                carried.append((p[0] & p[1])[None])
                p = (p[0] ^ p[1])[None]
            out.append(p[0] if len(p) else np.zeros_like(self.valid))
            w += 1
        return out

    def boundary(self, q: np.ndarray, k: int) -> np.ndarray:
        """Positions of a superset of the k best rows."""
        if self.n <= k:
            return np.arange(self.n)
        sums = self.total(q)
        left, need, value = self.valid, k, 0
        for i in reversed(range(len(sums))):
            x = left & sums[i]
            c = int(np.bitwise_count(x).sum())
            if c >= need:
                left, value = x, value | 1 << i
            else:
                need, left = need - c, left & ~sums[i]
        slack = sum(map(abs, q.tolist())) * ((1 << self.shift) - 1)
        least = max(0, value - -(-slack // (1 << self.shift)))
        above, equal = np.zeros_like(self.valid), self.valid
        for i in reversed(range(len(sums))):
            if least >> i & 1:
                equal = equal & sums[i]
            else:
                above, equal = above | equal & sums[i], equal & ~sums[i]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little")[: self.n])


def searcher(scale: float, k: int):
    def whole(x: np.ndarray) -> np.ndarray:
        """floor(scale * x) as integers; such as are no 64-bit integers stay Python's."""
        x = np.floor(x * scale)
        return x.astype(np.int64) if not x.size or np.abs(x).max() < HUGE else np.array([[int(v) for v in r] for r in x], object)

    def scores(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        if x.dtype != object and r.dtype != object and max(np.abs(x).max(initial=0), np.abs(r).max(initial=0)) <= LARGE:
            return x @ r
        r = [int(v) for v in r]
        return np.array([sum(int(a) * b for a, b in zip(y, r)) for y in x], object)

    def search(x, xv):
        xi = whole(xv)
        index = BitSlices(xi) if xi.dtype != object else None

        def find(q, qv):
            qi = whole(qv)
            for a, r in zip(q, qi):
                at = np.arange(len(x))
                if index and qi.dtype != object:
                    at = index.boundary(r, k + int((x == a).sum()))  # the query's own rows take places too
                at = at[x[at] != a]
                s = scores(xi[at], r)
                if s.dtype == object:
                    if any(abs(v) >> 63 for v in s) and len(at) < len(x):  # scores held at a long's ends are ties, which may lie beyond the boundary
                        at = np.flatnonzero(x != a)
                        s = scores(xi[at], r)
                    s = np.array([max(-(1 << 63) + 1, min((1 << 63) - 1, int(v))) for v in s], np.int64)
                order = np.lexsort((x[at], -s))[:k]
                yield int(a), x[at][order], s[order]

        return find

    return search


def top_k(scratch: Scratch, vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the largest inner product with each row of `queries`, components as floor(scale * x).

    A query's own id is no candidate; ties go to the smaller id; fewer than k candidates give fewer rows. Vectors that are null or empty, or hold a null or
    non-finite component, and rows without id take no part; an empty table gives no rows; other columns are ignored. Rows that share an id are candidates
    each, and repeated query ids are one query. Scores beyond a long's range are held at its ends, -(2**63 - 1) and 2**63 - 1, and tie there; components of 2**61 and more after scaling are scored without the index.
    """
    return searched(scratch, clean(vectors, id_col, vec_col), clean(queries, id_col, vec_col), searcher(scale, k), k, "long")
