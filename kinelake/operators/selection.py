"""Deduplication, diversity and selection of results.

What depends on every choice before it (non-maximum suppression, quotas, tours) runs as a greedy scan of one group in one task. Callers group by what bounds
the scan: an unordered pair of sources, a frame, an identity.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def family_pairs(rows: DataFrame, a: str, b: str, order: list) -> DataFrame:
    """The first row of each unordered pair of families; rows within one family go; rows with an unknown family all stay."""
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(*order)
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    x = rows.where(~known | (F.col(a) != F.col(b))).withColumn("__n", F.row_number().over(w)).withColumn("__k", known)
    return x.where("NOT __k OR __n = 1").drop("__n", "__k")


def nms_keep(s: np.ndarray, e: np.ndarray, score: np.ndarray, key: np.ndarray, overlap: float, near: float) -> np.ndarray:
    """Greedy temporal suppression, best first (ties by key): drops what covers a kept one by `overlap` of the shorter, or starts within `near` seconds of it."""
    kept: list[int] = []
    for i in np.lexsort((key, -score)):
        ok = True
        for k in kept:
            short = min(e[i] - s[i], e[k] - s[k])
            shared = min(e[i], e[k]) - max(s[i], s[k])
            if abs(s[i] - s[k]) <= near or (short > 0 and shared / short >= overlap):
                ok = False
                break
        if ok:
            kept.append(int(i))
    out = np.zeros(len(s), bool)
    out[kept] = True
    return out


def suppressed(rows: DataFrame, group: str, overlap: float = 0.35, near: float = 1.5) -> DataFrame:
    """rows (group, id, s, e, score) that survive temporal non-maximum suppression within their group."""

    def run(p):
        return p[nms_keep(p.s.to_numpy(), p.e.to_numpy(), p.score.to_numpy(), p.id.to_numpy(), overlap, near)]

    return rows.groupBy(group).applyInPandas(run, rows.schema)


def pair_nms_keep(rows: np.ndarray, score: np.ndarray, overlap: float = 0.35, near: float = 1.5) -> np.ndarray:
    """The same over pairs of ranges (ls, le, rs, re): a pair falls to a kept one that covers it on both sides, in the same or in swapped order."""

    def same(a, b):
        short = min(a[1] - a[0], b[1] - b[0])
        return abs(a[0] - b[0]) <= near or (short > 0 and (min(a[1], b[1]) - max(a[0], b[0])) / short >= overlap)

    kept: list[int] = []
    for i in np.lexsort((np.arange(len(score)), -score)):
        l, r = rows[i][:2], rows[i][2:]  # noqa: E741
        if not any((same(l, rows[k][:2]) and same(r, rows[k][2:])) or (same(l, rows[k][2:]) and same(r, rows[k][:2])) for k in kept):
            kept.append(int(i))
    out = np.zeros(len(score), bool)
    out[kept] = True
    return out


def quota_select(left: list, right: list, quota: int) -> list[int]:
    """Positions of pairs (best first) accepted while each side has been used fewer than `quota` times; with a quota of one, an unused side is won by re-pairing
    along an augmenting path: A-B gives way to A-C and B-D."""
    used: dict = {}
    chosen: list[int] = []
    for k, (a, b) in enumerate(zip(left, right)):
        if used.get(a, 0) < quota and used.get(b, 0) < quota:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            chosen.append(k)
    if quota == 1:
        # sides that are used stay used, so what can't be re-paired now can't be later, and a side's own rows are met once
        taken, at = {x for k in chosen for x in (left[k], right[k])}, {}
        for f, (a, b) in enumerate(zip(left, right)):
            if a != b:
                at.setdefault(a, []).append((f, b))
                at.setdefault(b, []).append((f, a))
        rows = {x: iter(r) for x, r in at.items()}
        heads: dict = {}

        def open_rows(x):
            """The rows of x whose other side is unused, in order; those that were passed are not looked at again."""
            heads[x] = [r for r in heads.get(x, ()) if r[1] not in taken]
            yield from heads[x]
            for r in rows.get(x, ()):
                if r[1] not in taken:
                    heads[x].append(r)
                    yield r

        kept, turn = [], 0
        while turn < len(chosen):
            a, b = left[chosen[turn]], right[chosen[turn]]
            p = next(open_rows(a), None)
            q = p and (next((r for r in open_rows(b) if r[1] != p[1]), None))
            if p and not q and (q := next(open_rows(b), None)):
                p = next((r for r in open_rows(a) if r[1] != q[1]), None)
            if p and q:
                chosen += [p[0], q[0]]
                taken |= {p[1], q[1]}
            else:
                kept.append(chosen[turn])
            turn += 1
        chosen = kept
    return sorted(chosen)


class _Quota:
    """One group's rows, taken in order as they come: what is chosen, and for re-pairing the rows of which one side is used and the other is not.

    A row whose sides are both used is not looked at again, so it isn't held; a row that neither side's use stops is chosen.
    """

    def __init__(self, quota: int):
        self.quota, self.used, self.full, self.held, self.n, self.most = quota, {}, [], [], 0, 1 << 18

    def ends(self, t) -> tuple[np.ndarray, np.ndarray]:
        """For each row, whether its left and its right side are used up."""
        return tuple(pc.is_in(t.column(c), value_set=pa.array(self.full, t.schema.field(c).type)).to_numpy(zero_copy_only=False) for c in "ij")

    def open(self, t: pa.Table) -> pa.Table:
        a, b = self.ends(t)
        return t.filter(pa.array(t.column("__chosen").to_numpy(zero_copy_only=False) | (a ^ b if self.quota == 1 else False)))

    def add(self, t: pa.Table) -> None:
        a, b = self.ends(t)
        chosen, free = np.zeros(t.num_rows, bool), np.flatnonzero(~(a | b))
        for k, x, y in zip(free.tolist(), *(t.column(c).take(free).to_pylist() for c in "ij")):
            if self.used.get(x, 0) < self.quota and self.used.get(y, 0) < self.quota:
                self.used[x], self.used[y] = self.used.get(x, 0) + 1, self.used.get(y, 0) + 1
                self.full += [z for z in {x, y} if self.used[z] >= self.quota]
                chosen[k] = True
        t = self.open(t.append_column("__chosen", pa.array(chosen)))
        self.held.append(t)
        self.n += t.num_rows
        if self.n > self.most:
            self.shrink()
            self.most = 2 * self.n + (1 << 18)

    def shrink(self) -> None:
        for k, t in enumerate(self.held):
            self.held[k] = self.open(t)
        self.n = sum(t.num_rows for t in self.held)

    def result(self) -> pa.Table:
        self.shrink()
        t, self.held = pa.concat_tables(self.held), []
        own = t.column("__chosen").to_numpy(zero_copy_only=False)
        if self.quota == 1:  # a pair is given up for a row of each of its sides, so rows of a side whose partner has none can't win
            left, _ = self.ends(t)
            side = pc.if_else(pa.array(left), t.column("i"), t.column("j"))
            pairs, some = t.filter(pa.array(own)), pc.unique(side.filter(pa.array(~own)))
            both = pc.and_(pc.is_in(pairs.column("i"), value_set=some), pc.is_in(pairs.column("j"), value_set=some))
            live = pa.concat_arrays([x for c in "ij" for x in pairs.column(c).filter(both).cast(side.type).chunks] or [pa.array([], side.type)])
            t = t.filter(pc.or_(pa.array(own), pc.is_in(side, value_set=live)))
        return t.take(quota_select(t.column("i").to_pylist(), t.column("j").to_pylist(), self.quota)).drop_columns("__chosen")


def with_quota(rows: DataFrame, group: str, quota: int) -> DataFrame:
    """rows (group, i, j, score) under a quota for each endpoint, best first (ties by endpoints).

    Spark sorts the rows, on disk where they are many, and a group's rows pass one task a batch at a time: it holds the sides that are used and the rows that may re-pair, not the group.
    """

    def run(batches):
        groups, some, n = {}, [], 0

        def pass_on():
            t = pa.Table.from_batches(some)
            codes = t.column(group).combine_chunks().dictionary_encode(null_encoding="encode")
            codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            t, cuts = t.take(order), [0, *(np.flatnonzero(np.diff(codes[order])) + 1).tolist(), t.num_rows]
            for p, q in zip(cuts[:-1], cuts[1:]):
                key = t.column(group)[p].as_py()
                groups.setdefault(key if key == key else "nan", _Quota(quota)).add(t.slice(p, q - p))

        for b in batches:
            some.append(b)
            n += b.num_rows
            if n >= 1 << 16:
                pass_on()
                some, n = [], 0
        if n:
            pass_on()
        while groups:
            yield from groups.popitem()[1].result().to_batches()

    real = dict(rows.dtypes)["score"] in ("double", "float")
    best = F.when(~F.isnan("score"), F.col("score")) if real else F.col("score")
    x = rows.repartition(group).sortWithinPartitions(best.desc_nulls_last(), F.asc_nulls_last("i"), F.asc_nulls_last("j"))
    return x.mapInArrow(run, rows.schema)


def diverse_order(score: np.ndarray, families: list[tuple], penalty: float = 0.04) -> list[int]:
    """Greedy order: at each step the best score less `penalty` for each time a family of the row has been used; ties by position."""
    used: dict = {}
    left, out = list(range(len(score))), []
    while left:
        best = max(left, key=lambda k: (score[k] - penalty * sum(used.get(f, 0) for f in families[k] if f is not None), -k))
        out.append(best)
        left.remove(best)
        for f in families[best]:
            if f is not None:
                used[f] = used.get(f, 0) + 1
    return out


def diversified(rows: DataFrame, group: str, fam_a: str, fam_b: str) -> DataFrame:
    """rows (group, i, j, score, families) with place, their position in diverse order, 1 first."""
    from pyspark.sql.types import IntegerType, StructType

    def run(p):
        p = p.sort_values(["score", "i", "j"], ascending=[False, True, True]).reset_index(drop=True)
        order = diverse_order(p.score.to_numpy(), list(zip(p[fam_a], p[fam_b])))
        p["place"] = 0
        p.loc[order, "place"] = np.arange(1, len(p) + 1)
        return p.astype({"place": "int32"})

    return rows.groupBy(group).applyInPandas(run, StructType([*rows.schema.fields]).add("place", IntegerType()))


def continuity_order(x: np.ndarray) -> list[int]:
    """A greedy nearest-neighbour tour from the first row; a bound on the first coordinate leaves out rows that cannot be nearer."""
    left, out = set(range(1, len(x))), [0] if len(x) else []
    while left:
        here, best = x[out[-1]], (float("inf"), -1)
        for k in sorted(left):
            if abs(here[0] - x[k][0]) < best[0]:
                d = float(np.sqrt(((here - x[k]) ** 2).sum()))
                if d < best[0]:
                    best = (d, k)
        nxt = best[1] if best[1] >= 0 else min(left)
        out.append(nxt)
        left.remove(nxt)
    return out


def slot_reranked(rows: DataFrame, group: list[str], place: str, special, key: list) -> DataFrame:
    """rows with new_place: special rows are put in the order of `key` into the places that special rows hold; other rows keep theirs."""
    w = Window.partitionBy(*group, "__s")
    x = rows.withColumn("__s", special).withColumn("__slot", F.row_number().over(w.orderBy(place))).withColumn("__want", F.row_number().over(w.orderBy(*key)))
    slots = x.select(*group, "__s", F.col("__slot").alias("__want"), F.col(place).alias("new_place"))
    return x.drop("__slot").join(slots, [*group, "__s", "__want"]).drop("__s", "__want")


def evict(entries: DataFrame, limit: int, order: list) -> DataFrame:
    """entries (size, ...) to evict, in the order given, until what is left fits in `limit` bytes. One running sum over sizes per bucket and one over buckets keep it distributed."""
    w = Window.orderBy(*order)
    total = entries.agg(F.sum("size").alias("total"))
    x = entries.withColumn("__before", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    return x.join(F.broadcast(total)).where(F.col("total") - F.col("__before") > limit).drop("__before", "total")
