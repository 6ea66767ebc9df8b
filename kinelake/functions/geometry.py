"""Boxes, angles, rotations, colours and clip ranges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(w: Column, h: Column) -> Column:
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of boxes given by corner and size; 0 where they don't meet."""
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = area(aw, ah) + area(bw, bh) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def centre_score(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """exp(-2.5 d / sqrt(area)) of the distance between centres, by the larger box."""
    d = F.sqrt(F.pow(ax + aw / 2 - bx - bw / 2, F.lit(2)) + F.pow(ay + ah / 2 - by - bh / 2, F.lit(2)))
    size = F.sqrt(F.greatest(area(aw, ah), area(bw, bh)))
    return F.when(size > 0, F.exp(-2.5 * d / size)).otherwise(0.0)


def signed_angle(a: Column) -> Column:
    """Degrees in [-180, 180)."""
    return F.pmod(a + 180, F.lit(360.0)) - 180


def view_sector(yaw: Column) -> Column:
    """One of eight sectors of 45 degrees, 0 in front, counted upwards."""
    return F.pmod(F.floor((signed_angle(yaw) + 22.5) / 45), F.lit(8)).cast("int")


def angular_distance(a: Column, b: Column) -> Column:
    return F.abs(signed_angle(a - b))


def rotation_angles(r: Column) -> Column:
    """(yaw, pitch, roll) in degrees of a 3x3 row-major rotation; null near gimbal lock."""
    e = lambda i: r[i].cast("double")
    flat = F.sqrt(e(0) * e(0) + e(3) * e(3))
    return F.when(flat > 1e-6, F.struct(F.degrees(F.atan2(-e(6), flat)).alias("yaw"), F.degrees(F.atan2(e(7), e(8))).alias("pitch"), F.degrees(F.atan2(e(3), e(0))).alias("roll")))


def valid_rotation(r: Column, tolerance: float = 0.002) -> Column:
    e = lambda i: r[i].cast("double")
    row = lambda a, b: e(3 * a) * e(3 * b) + e(3 * a + 1) * e(3 * b + 1) + e(3 * a + 2) * e(3 * b + 2)
    ok = F.size(r) == 9
    for a in range(3):
        for b in range(a, 3):
            ok = ok & (F.abs(row(a, b) - (1.0 if a == b else 0.0)) <= tolerance)
    det = e(0) * (e(4) * e(8) - e(5) * e(7)) - e(1) * (e(3) * e(8) - e(5) * e(6)) + e(2) * (e(3) * e(7) - e(4) * e(6))
    return F.coalesce(ok & (F.abs(det - 1) <= tolerance), F.lit(False))


def rotation_distance(a: Column, b: Column) -> Column:
    """Geodesic distance of two rotations as a share of pi."""
    trace = F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))) / 3.141592653589793


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue 0..1, saturation and value 0..255 of 8-bit colours."""
    hi, lo = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    d = hi - lo
    h = F.when(d == 0, 0.0).when(hi == r, F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return F.struct(h.alias("h"), F.when(hi == 0, 0.0).otherwise(d / hi * 255).alias("s"), hi.alias("v"))


def clip_range(start, end, scene_start, scene_end, pad: float = 1.25, whole: float = 12.0) -> Column:
    """The whole shot where it is short enough, else the match with padding inside the shot; unknown bounds (null) don't limit."""
    known = scene_start.isNotNull() & scene_end.isNotNull() & (scene_end > scene_start)
    short = known & (scene_end - scene_start <= whole)
    lo = F.greatest(F.lit(0.0), start - pad)
    return F.struct(
        F.when(short, scene_start).when(known, F.greatest(lo, scene_start)).otherwise(lo).alias("start"),
        F.when(short, scene_end).when(known, F.least(end + pad, scene_end)).otherwise(end + pad).alias("end"),
    )
