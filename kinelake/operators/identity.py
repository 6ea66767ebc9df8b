"""Who is who: consensus of faces, ownership, association with margins, consistency of tracks, cross-source leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import vectors as V


def owned(rows: DataFrame, item: list[str], owner: str, residual: str, margin: float) -> DataFrame:
    """Each item's owner with the smallest residual, kept only where the second is worse by `margin`; an ambiguous item has no owner."""
    w = Window.partitionBy(*item).orderBy(residual, owner)
    x = rows.withColumn("__n", F.row_number().over(w)).withColumn("__next", F.lead(residual).over(w)).where("__n = 1")
    return x.where(F.col("__next").isNull() | (F.col("__next") - F.col(residual) >= margin)).drop("__n", "__next")


def consensus(pairs: DataFrame, key: list[str], left: str, right: str, score: str, same: float, different: float, support: float = 2 / 3, least: int = 3) -> DataFrame:
    """(key, verdict, score) from all sample pairs of two people (their samples thinned before, so that those of one moment count once).

    A sample is supported if, of `least` usable partners or more, two and `support` of them reach `same`; it contradicts if the best of so many is no more than `different`.
    One contradiction on either side gives `different`; else `least` supported samples and `support` of all on both sides give `same` and the mean of the supported samples'
    interpolated medians. Everything else is unknown and has no score. Each side is one aggregation a sample and one a pair of people.
    """

    one = lambda own: pairs.groupBy(*key, own).agg(F.count(score).alias("n"), F.count_if(F.col(score) >= same).alias("p"), F.max(score).alias("best"), F.percentile(score, 0.5).alias("mid"))
    return verdicts(one(left), one(right), key, different, support, least)


def verdicts(left: DataFrame, right: DataFrame, key: list[str], different: float, support: float = 2 / 3, least: int = 3) -> DataFrame:
    """`consensus` from what each sample of either side scores with the other side: (key, ..., n, p, best, mid), its partners, those that reach `same`, the best and the median score."""

    def side(one: DataFrame, n: str, good: str, bad: str) -> DataFrame:
        backed = (F.col("n") >= least) & (F.col("p") >= 2) & (F.col("p") >= support * F.col("n") - 1e-9)
        return one.groupBy(*key).agg(
            F.count("*").alias(n), F.count_if(backed).alias(good), F.max((F.col("n") >= least) & (F.col("best") <= different)).alias(bad), F.sum(F.when(backed, F.col("mid"))).alias(f"{n}_sum")
        )

    x = side(left, "n", "good", "bad").join(side(right, "m", "back", "wrong"), key)
    enough = (F.col("n") >= least) & (F.col("m") >= least)
    both = (F.least("good", "back") >= least) & (F.col("good") >= support * F.col("n") - 1e-9) & (F.col("back") >= support * F.col("m") - 1e-9)
    verdict = F.when(enough & (F.col("bad") | F.col("wrong")), "different").when(enough & both, "same").otherwise("unknown")
    mean = (F.col("n_sum") + F.col("m_sum")) / (F.col("good") + F.col("back"))
    return x.select(*key, verdict.alias("verdict"), F.when(verdict == "same", mean).alias("score"))


def independent_samples(samples: DataFrame, key: list[str], time: str, bucket: float = 0.1) -> DataFrame:
    """One sample (the earliest) of each stretch of `bucket` seconds of a key, so that repeated frames of one moment aren't independent evidence."""
    w = Window.partitionBy(*key, F.floor(F.col(time) / bucket)).orderBy(time)
    return samples.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def yaw_summary(samples: DataFrame, key: list[str], start: Column, end: Column, coverage: float = 0.6, expected: int = 4) -> DataFrame:
    """(key, samples, yaw): the yaw nearest to the interval's middle. Times with conflicting values are void; too few samples give a null."""
    clean = samples.groupBy(*key, "t").agg(F.min("yaw").alias("lo"), F.max("yaw").alias("hi"), F.min(start).alias("s"), F.max(end).alias("e")).where("lo = hi")
    g = clean.groupBy(*key).agg(F.count("*").alias("samples"), F.min_by("lo", F.struct(F.abs(F.col("t") - (F.col("s") + F.col("e")) / 2), F.col("t"))).alias("yaw"))
    return g.select(*key, "samples", F.when(F.col("samples") >= coverage * expected, F.col("yaw")).alias("yaw"))


def evenly_spaced(rows: DataFrame, key: list[str], order: list, most: int = 5) -> DataFrame:
    """At most `most` rows of each key, evenly spaced in order, the first and the last among them."""
    w = Window.partitionBy(*key)
    x = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    slot = F.sequence(F.lit(0), F.lit(most - 1))
    picks = F.transform(slot, lambda j: F.floor(j * (F.col("__n") - 1) / (most - 1)))
    return x.where((F.col("__n") <= most) | F.array_contains(picks, F.col("__i").cast("long"))).drop("__i", "__n")


def consistent(samples: DataFrame, key: str, least: int, span: float, alike: float) -> DataFrame:
    """(key, n, worst): keys with `least` samples over `span` seconds that are all alike. samples: (key, id, t, v); a key's samples are few (thinned before)."""
    n = samples.groupBy(key).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span")).where((F.col("n") >= least) & (F.col("span") >= span))
    a = samples.join(n, key, "left_semi")
    b = a.select(key, F.col("id").alias("id2"), F.col("v").alias("v2"))
    worst = a.join(b, key).where("id < id2").groupBy(key).agg(F.min(V.cosine(F.col("v"), F.col("v2"))).alias("worst"))
    return n.join(worst, key).where(F.col("worst") >= alike).select(key, "n", "worst")


def covisions(rows: DataFrame, identity: str, frame: list[str], disjoint: Column) -> DataFrame:
    """(identity, times): frames in which one identity is seen at two disjoint places, an error of grouping. Columns of the second sighting end in 2."""
    b = rows.select(*[F.col(c).alias(f"{c}2") for c in rows.columns])
    on = [F.col(c) == F.col(f"{c}2") for c in [identity, *frame]]
    return rows.join(b, on).where((F.col("id") < F.col("id2")) & disjoint).groupBy(identity).agg(F.countDistinct(*frame).alias("times"))


def prefix_range(points: DataFrame, ranges: DataFrame, value: str) -> DataFrame:
    """ranges (id, source, s, e) with the sum of `value` over the source's points in [s, e): two running sums instead of a range join, one sort a source."""
    p = points.select("source", "t", F.col(value).cast("double").alias("x"), F.lit(None).cast("long").alias("id"), F.lit(1).alias("side"))
    q = ranges.select("source", F.col("s").alias("t"), F.lit(0.0).alias("x"), "id", F.lit(-1).alias("side")).union(ranges.select("source", "e", F.lit(0.0), "id", F.lit(0)))
    # at one time, bounds come before points: a point at s counts, one at e does not
    w = Window.partitionBy("source").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    run = p.union(q).withColumn("run", F.sum("x").over(w)).where("id IS NOT NULL")
    return run.groupBy("source", "id").agg(F.sum(F.when(F.col("side") == 0, F.col("run")).otherwise(-F.col("run"))).alias("total"))
