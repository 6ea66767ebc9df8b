"""Ranges of clips around matches: times in seconds, an end is exclusive, a null shot is unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_range(start: Column, end: Column, shot_start: Column, shot_end: Column, fps: float = 24.0) -> Column:
    """struct(start, end) of a match: its last frame is kept by half a frame's time, but the shot's end isn't passed."""
    half = 0.5 / fps
    s = F.greatest(F.lit(0.0), start)
    e = F.greatest(s, F.coalesce(end, s))
    long = e - s + half
    top = F.when(shot_end > e, shot_end).otherwise(F.greatest(e, s + long))
    return F.when(start.isNotNull(), F.struct(s.alias("start"), F.least(s + long, top).alias("end")))


def shot_range(start: Column, end: Column, shot_start: Column, shot_end: Column, fps: float = 24.0, most: float = 12.0, context: float = 1.25) -> Column:
    """struct(start, end): the whole shot where it is short, else the match with some context, inside the shot; the match alone where the shot is unknown or doesn't hold it."""
    m = match_range(start, end, shot_start, shot_end, fps)
    fits = (shot_start >= 0) & (shot_end > shot_start) & (end >= start) & (start >= shot_start) & (end < shot_end)
    pad = F.least(F.lit(context), F.greatest(F.lit(0.0), F.lit(most) - (m.end - m.start)) * 0.5)
    wide = F.struct(F.greatest(shot_start, m.start - pad).alias("start"), F.least(shot_end, m.end + pad).alias("end"))
    whole = F.struct(shot_start.alias("start"), shot_end.alias("end"))
    return F.when(F.coalesce(fits, F.lit(False)), F.when(shot_end - shot_start <= most, whole).otherwise(wide)).otherwise(m)


def boundary_end(shot_start: Column, shot_end: Column, fallback: Column) -> Column:
    return F.when((shot_start >= 0) & (shot_end > shot_start), shot_end).otherwise(fallback)


def refined_end(end: Column, boundary: Column, supported: Column) -> Column:
    """The earlier of a clip's end and a cut found at full rate, unless that would lose a frame of the match."""
    return F.when(boundary >= supported, F.least(end, boundary)).otherwise(end)


def start_needs_refinement(start: Column, shot_start: Column) -> Column:
    """Only a clip that begins at its sampled shot boundary has its start refined."""
    return F.coalesce((shot_start > 0) & (F.abs(start - shot_start) < 1e-6), F.lit(False))


def organized(left: Column, adjusted: Column, start: Column, end: Column, shot_start: Column, shot_end: Column, fps: float = 24.0) -> Column:
    """struct(start, end) of one side of a result: a range that was set by hand stays, others are given their shot."""
    own = F.struct(start.alias("start"), end.alias("end"))
    return F.when(left, F.when(adjusted, own).otherwise(shot_range(start, end, shot_start, shot_end, fps)))
