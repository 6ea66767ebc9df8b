"""Approximate nearest neighbours by cosine over a permutation index.

A vector is represented by its nearest pivots in order. Each pivot's inverted file posts the vectors that hold it, with its position there. A query
walks the files of its own pivots and adds up the footrule distance between the two truncated orders; the nearest by footrule are reranked exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.blocks import clean, matrices, searched
from kinelake.llm.common import Scratch, ship

ship(__name__)

#: Pivots (the bounded sample that the index is fitted on), pivots kept in a vector's order, and the share of a block's rows that is reranked.
PIVOTS, PREFIX, SHARE, LEAST = 256, 48, 0.2, 64


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very large or small components keep their direction."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class PermutationIndex:
    def __init__(self, x: np.ndarray, pivots: np.ndarray, prefix: int):
        self.pivots, self.s, self.n = pivots, min(prefix, len(pivots)), len(x)
        order = self.order(x)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.row, self.place = (by // self.s).astype(np.int32), (by % self.s).astype(np.int32)
        self.edge = np.searchsorted(flat[by], np.arange(len(pivots) + 1))

    def order(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-(unit(x) @ self.pivots.T), axis=1, kind="stable")[:, : self.s]

    def near(self, order: np.ndarray, most: int) -> np.ndarray:
        """Positions of the `most` rows nearest by footrule. A shared pivot at places i and j lowers the distance s(s+1) of disjoint orders by 2(s - max(i, j))."""
        if most >= self.n:
            return np.arange(self.n)
        gain = np.zeros(self.n, np.int32)
        for i, p in enumerate(order):
            a, b = self.edge[p], self.edge[p + 1]
            gain[self.row[a:b]] += self.s - np.maximum(self.place[a:b], i)
        return np.argpartition(-gain, most - 1)[:most]


def searcher(pivots: dict[int, np.ndarray], k: int, prefix: int, share: float, least: int):
    def search(x, xv):
        own = pivots.get(xv.shape[1])
        index = PermutationIndex(xv, own, prefix) if own is not None else None
        ux, most = unit(xv), max(least, int(np.ceil(share * len(x))))

        def find(q, qv):
            for a, u, order in zip(q, unit(qv), index.order(qv) if index else qv):
                at = index.near(order, most + int((x == a).sum())) if index else np.arange(len(x))
                at = at[x[at] != a]
                s = np.clip((ux[at] * u).sum(1), -1.0, 1.0)
                best = np.lexsort((x[at], -s))[:k]
                yield int(a), x[at][best], s[best]

        return find

    return search


def neighbours(scratch: Scratch, vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries`, the k rows of `vectors` found nearest by cosine, which is exact for every row returned.

    Every row is searched; the pivots are a sample of at most `pivots` rows of each of the 16 commonest vector lengths (the smallest hashes of their ids), and vectors of
    other lengths are compared with all rows of their block. Blocks are of about 8192 rows, so of a small table `least` rows of a block are reranked at least. A query's
    own id is no candidate; repeated query ids are one query; ties go to the smaller id; fewer than k candidates are all returned. Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows without id take no part; an empty table gives no rows; other columns are ignored.
    """
    some = lambda df: clean(df, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    v = some(vectors)
    kinds = [r["d"] for r in v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(16).collect()]
    fitted = {}
    for d in kinds:
        rows = v.where(F.size("v") == d).orderBy(F.xxhash64("id"), "id", "v").limit(pivots).select("v").collect()
        fitted[d] = unit(np.array([r["v"] for r in rows]))
    return searched(scratch, v, some(queries), searcher(fitted, k, prefix, share, least), k, "double")
