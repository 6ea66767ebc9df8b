"""Operators on timelines: as-of joins, interval and range joins, runs, shots, local windows.

A timeline is (source, t, ...) with t in seconds on the source's own clock; an interval is (source, s, e). Intervals of shots are half-open.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Keys of equal rows that meet others at once in range_pairs.
CHUNK = 1024


def asof_forward(requests: DataFrame, frames: DataFrame, within: float) -> DataFrame:
    """requests (source, t, ...) with frame_t: the source's first frame at or after t, no later than `within`; null if none.

    One sort a source instead of a join: both sides are united and the next frame is carried back.
    """
    cols = [c for c in requests.columns if c not in ("source", "t")]
    both = requests.select("source", "t", F.lit(0).alias("__f"), F.struct(*cols or [F.lit(0).alias("z")]).alias("__r")).unionByName(frames.select("source", "t", F.lit(1).alias("__f")), allowMissingColumns=True)
    w = Window.partitionBy("source").orderBy("t", "__f").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("__f") == 1, F.col("t")), ignorenulls=True).over(w)
    out = both.withColumn("frame_t", nxt).where("__f = 0")
    return out.select("source", "t", *[F.col(f"__r.{c}").alias(c) for c in cols], F.when(F.col("frame_t") - F.col("t") <= within, F.col("frame_t")).alias("frame_t"))


def asof_nearest(requests: DataFrame, frames: DataFrame, tolerance: float) -> DataFrame:
    """requests (source, t, ...) with frame_t: the nearest frame of the source within +-tolerance, the earlier of two equally near; null if none."""
    cols = [c for c in requests.columns if c not in ("source", "t")]
    both = requests.select("source", "t", F.lit(0).alias("__f"), F.struct(*cols or [F.lit(0).alias("z")]).alias("__r")).unionByName(frames.select("source", "t", F.lit(1).alias("__f")), allowMissingColumns=True)
    at = F.when(F.col("__f") == 1, F.col("t"))
    w = Window.partitionBy("source")
    nxt = F.first(at, ignorenulls=True).over(w.orderBy("t", "__f").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    prv = F.last(at, ignorenulls=True).over(w.orderBy("t", F.desc("__f")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumn("__n", nxt).withColumn("__p", prv).where("__f = 0")
    best = F.when(F.col("__n").isNull() | (F.col("t") - F.col("__p") <= F.col("__n") - F.col("t")), F.col("__p")).otherwise(F.col("__n"))
    return out.withColumn("__b", best).select("source", "t", *[F.col(f"__r.{c}").alias(c) for c in cols], F.when(F.abs(F.col("__b") - F.col("t")) <= tolerance, F.col("__b")).alias("frame_t"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, slack: float, cell: float) -> DataFrame:
    """Joins points (source, t, ...) to intervals (source, s, e, ...) of their source with t in [s - slack, e + slack].

    An interval is posted to every cell of `cell` seconds that it touches, so the join is an equi-join on source and cell: a source with very many points is
    dealt over its cells. A pair meets in the point's cell alone.
    """
    i = intervals.withColumn("__cell", F.explode(F.sequence(F.floor((F.col("s") - slack) / cell), F.floor((F.col("e") + slack) / cell))))
    p = points.withColumn("__cell", F.floor(F.col("t") / cell))
    return p.join(i, ["source", "__cell"]).where((F.col("t") >= F.col("s") - slack) & (F.col("t") <= F.col("e") + slack)).drop("__cell")


def overlapping_pairs(intervals: DataFrame, cell: float) -> DataFrame:
    """Pairs (a_*, b_*) with a_id < b_id of one source's intervals (id, source, s, e) that overlap, and their overlap.

    Intervals meet in cells; a pair counts in the cell where its overlap starts, so it comes once.
    """
    x = intervals.select("id", "source", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / cell), F.floor(F.col("e") / cell))).alias("cell"))
    side = lambda k: x.select("source", "cell", *[F.col(c).alias(f"{k}_{c}") for c in ("id", "s", "e")])
    start = F.greatest("a_s", "b_s")
    out = side("a").join(side("b"), ["source", "cell"]).where((F.col("a_id") < F.col("b_id")) & (start < F.least("a_e", "b_e")) & (F.floor(start / cell) == F.col("cell")))
    return out.withColumn("overlap", F.least("a_e", "b_e") - start).drop("cell")


def range_pairs(rows: DataFrame, key: str, near: dict[str, float]) -> DataFrame:
    """Pairs (a, b) of keys, a < b, whose columns all differ by at most the given widths.

    Rows with equal columns travel and are compared as one, with their sorted keys in chunks of CHUNK; the keys of two chunks that are near are paired at the end, without a comparison for each pair.
    The first three columns are cut into cells a little wider than their widths; a chunk meets the chunks of its own cell and of half of the neighbouring ones, so two chunks meet once, by an
    equi-join on all cells, and the widths are residual predicates. Cells are dealt over all shuffle partitions, however few bytes they have, as their pairs are many.
    """
    cells = list(near)[:3]
    cell = [F.floor(F.col(c) / (near[c] * (1 + 1e-9))) for c in cells]
    ahead = [o for o in itertools.product((-1, 0, 1), repeat=len(cells)) if o >= (0,) * len(cells)]
    at = F.explode(F.array(*[F.struct(*[(x + F.lit(d)).alias(f"c{k}") for k, (x, d) in enumerate(zip(cell, o))], F.lit(not any(o)).alias("own")) for o in ahead]))
    # the keys are sorted, so chunks are the same whenever they are made again
    equal = rows.groupBy(*near).agg(F.sort_array(F.collect_list(key)).alias("keys")).where(F.size("keys") > 0)
    chunks = equal.select("*", F.explode(F.sequence(F.lit(0), F.size("keys") - 1, F.lit(CHUNK))).alias("part")).withColumn("keys", F.slice("keys", F.col("part") + 1, F.lit(CHUNK)))
    side = lambda k: [F.col("keys").alias(f"{k}_keys"), F.col("part").alias(f"{k}_part"), *[F.col(c).alias(f"{k}_{c}") for c in near]]
    n, on = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [f"c{k}" for k in range(len(cells))]
    x = chunks.select(*side("x"), at.alias("at")).select("*", "at.*").drop("at").repartition(n, *on)
    y = chunks.select(*side("y"), *[x.alias(f"c{k}") for k, x in enumerate(cell)]).repartition(n, *on)
    order = [F.struct(*[F.col(f"{k}_{c}") for c in near], F.col(f"{k}_part")) for k in "xy"]
    ok = ~F.col("own") | (order[0] <= order[1])
    for c, w in near.items():
        ok = ok & (F.abs(F.col(f"x_{c}") - F.col(f"y_{c}")) <= w)
    met = x.hint("merge").join(y, on).where(ok).withColumn("same", F.col("own") & (order[0] == order[1]))
    pairs = met.select("*", F.explode("x_keys").alias("x")).select("*", F.explode("y_keys").alias("y")).where((F.col("x") < F.col("y")) | (~F.col("same") & (F.col("x") > F.col("y"))))
    side = lambda f, k: [f("x", "y").alias(k), *[F.when((F.col("x") < F.col("y")) == (k == "a"), F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(f"{k}_{c}") for c in near]]
    return pairs.select(*side(F.least, "a"), *side(F.greatest, "b"))


def seen_together(rows: DataFrame, least: int) -> DataFrame:
    """(a, b, together, span) of sources a < b that share `least` slots or more, of distinct (source, slot) rows: how many, and from the first to the last of them.

    Sources are dealt to blocks by a hash, and a block with its slots travels as one row to each pair of blocks it belongs to. Shared slots are counted by a matrix product, the first
    and the last one found in words of 32 slots; there is no row of each meeting, only the pairs found.
    """
    rows = rows.select(F.col("source").cast("long").alias("source"), F.col("slot").cast("long").alias("slot")).where("source IS NOT NULL AND slot IS NOT NULL")
    n = rows.select("source").distinct().count()
    blocks = max(1, -(-n // 4096), min(16, -(-n // 512)))

    def pack(t: pa.Table) -> pa.Table:
        ids, who = np.unique(t.column("source").to_numpy(), return_inverse=True)
        slots, at = np.unique(t.column("slot").to_numpy(), return_inverse=True)
        order = np.argsort(who, kind="stable")
        kind = np.uint16 if len(slots) <= 1 << 16 else np.int32
        return pa.table({"block": t.column("block").slice(0, 1), "ids": [ids.tobytes()], "counts": [np.bincount(who, minlength=len(ids)).astype(np.int32).tobytes()], "slots": [slots.tobytes()], "at": [at[order].astype(kind).tobytes()]})

    b = rows.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(pack, "block int, ids binary, counts binary, slots binary, at binary")
    left = b.withColumn("q", F.explode(F.sequence("block", F.lit(blocks - 1)))).withColumnRenamed("block", "p")
    right = b.withColumn("p", F.explode(F.sequence(F.lit(0), "block"))).select("p", F.col("block").alias("q"), *[F.col(c).alias(f"{c}2") for c in ("ids", "counts", "slots", "at")])

    def marks(counts, slots, at, shared):
        counts = np.frombuffer(counts, np.int32)
        at = np.frombuffer(at, np.uint16 if len(at) == 2 * counts.sum() else np.int32)
        of = np.searchsorted(shared, slots)
        known = np.isin(slots, shared)
        m = np.zeros((len(counts), -(-len(shared) // 32) * 32), bool)
        who = np.repeat(np.arange(len(counts)), counts)
        m[who[known[at]], of[at[known[at]]]] = True
        return m, np.packbits(m, 1, "little").view(np.uint32)

    def run(batches):
        for t in batches:
            for k in range(t.num_rows):
                r = t.slice(k, 1).to_pylist()[0]
                i, j, s, s2 = (np.frombuffer(r[c], np.int64) for c in ("ids", "ids2", "slots", "slots2"))
                shared = np.intersect1d(s, s2)
                if not len(shared):
                    continue
                (m, w), (m2, w2) = marks(r["counts"], s, r["at"], shared), marks(r["counts2"], s2, r["at2"], shared)
                f2, w2 = m2.astype(np.float32).T, np.ascontiguousarray(w2.T)
                place = np.append(shared, [0] * 31)
                for u in range(0, len(i), 64):
                    together = m[u : u + 64].astype(np.float32) @ f2
                    lo, hi = np.zeros(together.shape, np.uint32), np.zeros(together.shape, np.uint32)
                    first, last = np.zeros(together.shape, np.int32), np.zeros(together.shape, np.int32)
                    for x in range(len(w2)):
                        both = w[u : u + 64, x, None] & w2[x]
                        some = both != 0
                        np.copyto(hi, both, where=some)
                        np.copyto(last, x, where=some)
                        some &= lo == 0
                        np.copyto(lo, both, where=some)
                        np.copyto(first, x, where=some)
                    ok = together >= least
                    if r["p"] == r["q"]:
                        ok &= i[u : u + 64, None] < j[None]
                    a, c = np.nonzero(ok)
                    lo, hi = lo[a, c], hi[a, c]
                    bit = lambda z: np.frexp(z.astype(np.float64))[1] - 1
                    span = place[32 * last[a, c] + bit(hi)] - place[32 * first[a, c] + bit(lo & (~lo + np.uint32(1)))]
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(i[u + a], j[c]), "b": np.maximum(i[u + a], j[c]), "together": together[a, c].astype(np.int64), "span": span})

    return left.join(right, ["p", "q"]).mapInArrow(run, "a long, b long, together long, span long")


def merged(intervals: DataFrame) -> DataFrame:
    """Each source's intervals (source, s, e) with those that overlap or touch as one: (source, s, e, n)."""
    w = Window.partitionBy("source").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = intervals.withColumn("__new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    x = x.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("source", "__island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).drop("__island")


def runs(points: DataFrame, value: str, gap: float, order: tuple = ("t",)) -> DataFrame:
    """Gaps and islands: (source, value, s, e, n) of runs of one value whose neighbours lie at most `gap` apart."""
    w = Window.partitionBy("source").orderBy(*order)
    new = F.lag(value).over(w).isNull() | ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.col("t") - F.lag("t").over(w) > gap)
    x = points.withColumn("__new", new.cast("int"))
    x = x.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("source", "__run", value).agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n")).drop("__run")


def shots(points: DataFrame, cut: Column, order: tuple = ("t",)) -> DataFrame:
    """points with shot: the number of cuts up to and including the point, as a cut belongs to the next shot."""
    w = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("shot", F.sum(cut.cast("int")).over(w))


def split_at(intervals: DataFrame, cuts: DataFrame, cell: float) -> DataFrame:
    """intervals (id, source, s, e) split at the cuts (source, t) strictly inside: (id, source, part, s, e), parts numbered from 0 in time."""
    inside = points_in_intervals(cuts.distinct(), intervals, 0.0, cell).where("t > s AND t < e").select("id", "source", F.col("t").alias("edge"))
    edges = intervals.select("id", "source", F.col("s").alias("edge")).union(inside).union(intervals.select("id", "source", F.col("e").alias("edge")))
    w = Window.partitionBy("id", "source").orderBy("edge")
    x = edges.withColumn("e", F.lead("edge").over(w)).withColumn("part", (F.row_number().over(w) - 1).cast("int"))
    return x.where(F.col("e").isNotNull()).select("id", "source", "part", F.col("edge").alias("s"), "e")


def local_slope(points: DataFrame, value: str, around: int = 2, order: tuple = ("t",)) -> DataFrame:
    """points with slope: the least-squares slope of a value over time in a window of `around` rows on either side."""
    w = Window.partitionBy("source").orderBy(*order).rowsBetween(-around, around)
    return points.withColumn("slope", F.regr_slope(value, "t").over(w))


def filled(points: DataFrame, value: str, most: float, order: tuple = ("t",)) -> DataFrame:
    """points with filled: missing values between two known ones at most `most` seconds apart are interpolated linearly; ends stay missing."""
    w = Window.partitionBy("source").orderBy(*order)
    known = F.when(F.col(value).isNotNull(), F.struct("t", F.col(value).alias("v")))
    p = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = points.withColumn("__p", p).withColumn("__n", n)
    span = F.col("__n.t") - F.col("__p.t")
    line = F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * (F.col("t") - F.col("__p.t")) / F.nullif(span, F.lit(0.0))
    return x.withColumn("filled", F.coalesce(F.col(value), F.when(span <= most, line))).drop("__p", "__n")


def median3(points: DataFrame, value: str, order: tuple = ("t",)) -> DataFrame:
    """points with median3: the median of a value and its two neighbours; the first and last stay as they are."""
    w = Window.partitionBy("source").orderBy(*order)
    a, b, c = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    return points.withColumn("median3", F.when(a.isNull() | c.isNull(), b).otherwise(F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))))
