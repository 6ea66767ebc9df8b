"""Ordered gates: a cascade of predicates whose first failure is recorded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_failure(*gates: tuple[str, Column]) -> Column:
    """The name of the first gate whose predicate holds (a failure), in the order given; null if none does. A null predicate does not fail."""
    out = None
    for name, failed in gates:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out


def identity_evidence(consensus: Column, face: Column, weak_face: Column, body: Column, cross_source: Column, moving: Column, min_body: float = 0.76) -> Column:
    """verified / candidate / rejected / none, from the strongest evidence down; missing evidence (null) proves nothing.

    Direct-face consensus decides; then a clear face; then a weak face with a middling body, across sources and moving, makes a candidate; a contradicting face
    vetoes; then the body alone.
    """
    return (
        F.when(consensus == "same", "verified").when(consensus == "different", "rejected").when(face >= 0.363, "verified")
        .when((weak_face >= 0.25) & (body >= 0.72) & (body < min_body) & cross_source & moving, "candidate").when(face.isNotNull() & (face < 0.25), "rejected")
        .when(body >= min_body, "verified").otherwise("none")
    )


def source_gap_allowed(same_source: Column, start_a: Column, start_b: Column, separate_shots: Column, cross_gap: float, floor: float, same_gap: float) -> Column:
    """Starts are far enough apart: cross_gap between sources, only the floor between verified separate shots, else the larger of floor and same_gap."""
    gap = F.abs(start_a - start_b)
    return F.when(~same_source, gap >= cross_gap).when(separate_shots, gap >= floor).otherwise(gap >= max(floor, same_gap))


def parameters(min_result_duration: float = 1.0, min_temporal_frames: int = 8, min_appearance: float = 0.76, similarity: float = 0.76, max_unique: int = 400) -> dict:
    """Validated search parameters; a value that is not finite or out of range raises ValueError."""
    import math

    given = dict(locals())
    given.pop("math")
    ranges = {"min_result_duration": (0, 60), "min_temporal_frames": (1, 1000), "min_appearance": (-1, 1), "similarity": (0, 1), "max_unique": (1, 100_000)}
    for k, (lo, hi) in ranges.items():
        if not math.isfinite(given[k]) or not lo <= given[k] <= hi:
            raise ValueError(f"{k} must lie between {lo} and {hi}")
    return given


#: Accuracy presets by name.
PRESETS = {"fast": parameters(similarity=0.70, min_temporal_frames=6), "balanced": parameters(), "precise": parameters(similarity=0.84, min_temporal_frames=10)}
