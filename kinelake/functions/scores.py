"""Scores that rank and organise results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def rank_score(similarity, duration, confidence) -> Column:
    return similarity * (0.75 + 0.25 * F.least(duration, F.lit(1.0))) * (0.8 + 0.2 * confidence)


def organization_score(similarity, evidence, identity) -> Column:
    return similarity * (0.55 + 0.45 * evidence) * F.when(identity, 1.0).otherwise(0.85)


def representative_quality(quality, identity, coverage, similarity, camera) -> Column:
    return clamp(0.55 * quality + 0.20 * identity + 0.15 * coverage + 0.10 * similarity - 0.15 * camera)


def evidence(n: Column) -> Column:
    """Evidence saturates at three samples."""
    return F.least(F.lit(1.0), n / 3.0)


def boundary_score(raw, threshold) -> Column:
    return F.greatest(F.lit(0.0), raw / threshold)
