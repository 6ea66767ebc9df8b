"""Timecodes and frame durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timecode(seconds: Column, fps: float, drop: bool) -> Column:
    """hh:mm:ss:ff of a rounded frame count; hours go on beyond 24. With drop-frame at 30 or 60 frames, of every minute but each tenth the first two numbers (four) are left out."""
    fps = max(1.0, fps)
    base = round(fps)
    n = F.floor(F.greatest(F.lit(0.0), seconds) * fps + 0.5).cast("long")
    if drop and base in (30, 60):
        skip = base // 15
        in_ten = n % (600 * base - 9 * skip)
        later = F.greatest(F.lit(0), F.floor((in_ten - skip) / (60 * base - skip)))  # minutes of the ten whose first numbers are left out
        n = (n + skip * (9 * F.floor(n / (600 * base - 9 * skip)) + later)).cast("long")
    s = F.floor(n / base)
    parts = [F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, n % base]
    return F.format_string(":".join(["%02d"] * 4), *[x.cast("long") for x in parts])


def frame_duration(fps: Column) -> Column:
    """A frame's duration as a fraction of seconds: NTSC rates exactly, others in millionths; 1/1s for rates that are null, not finite or not above zero."""
    ntsc = F.when(F.abs(fps - 23.976) < 0.01, "1001/24000s").when(F.abs(fps - 29.97) < 0.01, "1001/30000s").when(F.abs(fps - 59.94) < 0.01, "1001/60000s")
    scale = 1_000_000
    k = F.greatest(F.lit(1), F.floor(fps * scale + 0.5).cast("long"))
    # Euclid's algorithm, more steps than numbers of this size need
    begin = F.struct(k.cast("long").alias("x"), F.lit(scale).cast("long").alias("y"))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(32)), begin, lambda s, _: F.when(s.y == 0, s).otherwise(F.struct(s.y.alias("x"), (s.x % F.greatest(s.y, F.lit(1))).alias("y"))), lambda s: s.x)
    text = F.concat((F.lit(scale) / gcd).cast("long").cast("string"), F.lit("/"), (k / gcd).cast("long").cast("string"), F.lit("s"))
    known = fps.isNotNull() & ~F.isnan(fps) & (fps > 0) & (fps < float("inf"))
    return F.when(known, F.coalesce(ntsc, text)).otherwise("1/1s")
