"""Vector arithmetic as column expressions; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def cosine(a: Column, b: Column, invalid: float = 0.0) -> Column:
    """Cosine clamped to [-1, 1]; `invalid` where vectors are missing, empty, of different length, not finite or of no length (callers choose 0, -1 or -2)."""
    norm = dot(a, a) * dot(b, b)
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & finite(a) & finite(b) & (dot(a, a) > 1e-12) & (dot(b, b) > 1e-12)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(norm)))).otherwise(F.lit(invalid))


def rms_distance(a: Column, b: Column) -> Column:
    """Root mean squared difference; components that only one vector has count 1 each."""
    n, m = F.size(a), F.size(b)
    sq = _sum(F.transform(F.slice(F.arrays_zip(a.alias("p"), b.alias("q")), 1, F.least(n, m)), lambda s: (s.p.cast("double") - s.q.cast("double")) * (s.p.cast("double") - s.q.cast("double"))))
    return F.sqrt((sq + F.greatest(n, m) - F.least(n, m)) / F.greatest(n, m))


def rms_similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-rms_distance(a, b))))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Overlap of two histograms, neutral 0.5 where one is missing."""
    root = F.zip_with(a, b, lambda p, q: F.sqrt(F.greatest(p.cast("double"), F.lit(0.0))) * F.sqrt(F.greatest(q.cast("double"), F.lit(0.0))))
    return F.when(a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(a) != F.size(b)), F.lit(0.5)).otherwise(_sum(root))


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 1e-12, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles(v))


def top_mean(v: Column) -> Column:
    """Mean of the largest quarter, at least three."""
    k = F.greatest(F.lit(3), F.ceil(F.size(v) / 4).cast("int"))
    top = F.slice(F.sort_array(v, asc=False), 1, k)
    return F.when(F.size(v) > 0, _sum(top) / F.size(top))


def upper_median(v: Column) -> Column:
    """The element at n/2 of the ordered values (not interpolated)."""
    return F.try_element_at(F.sort_array(v), F.floor(F.size(v) / 2).cast("int") + 1)


def lower_quartile(v: Column) -> Column:
    return F.try_element_at(F.sort_array(v), F.floor((F.size(v) - 1) / 4).cast("int") + 1)


def median_deviation(v: Column) -> Column:
    m = upper_median(v)
    return upper_median(F.transform(v, lambda x: F.abs(x - m)))


def pose_distance(a: Column, b: Column, sure_a: Column, sure_b: Column, least: float = 0.5, joints: int = 5) -> Column:
    """Mean distance of joints (x, y in turn) weighted by the lesser evidence of the two, over joints with `least` of it in both; null if fewer than `joints` are."""
    q = F.zip_with(sure_a, sure_b, lambda x, y: F.least(x, y))
    at = lambda v, i: F.element_at(v, i)
    parts = F.transform(q, lambda w, i: F.struct(w.alias("w"), F.hypot(at(a, 2 * i + 1) - at(b, 2 * i + 1), at(a, 2 * i + 2) - at(b, 2 * i + 2)).alias("d")))
    good = F.filter(parts, lambda s: s.w >= least)
    total = lambda f: F.aggregate(good, F.lit(0.0), f)
    return F.when(F.size(good) >= joints, total(lambda s, x: s + x.w * x.d) / total(lambda s, x: s + x.w))
