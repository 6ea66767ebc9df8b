"""Admission of windows and rejection of pairs, as column expressions over measured values. Times are seconds; a null measure is one that was not taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.operators.graph import checkpointed

#: Tolerance of sums of timestamps.
EPS = 1e-9


def temporal_support(frames: Column, span: Column, static: Column, least_frames: int, least_span: float, static_frames: int = 3, static_span: float = 0.30) -> Column:
    """Whether a window is long enough to mean something: a held pose by few samples, a motion by many, or by six over a longer span."""
    held = (frames >= static_frames) & (span + EPS >= static_span)
    moved = (frames >= least_frames) | ((frames >= 6) & (span + EPS >= least_span))
    return (frames >= 3) & F.when(static, held).otherwise(moved)


def distinct_samples(frames: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, usable, span): usable frames whose time is later than every usable one before, and the time from the first to the last of them. frames: (key, order, t, ok)."""
    ok = F.col("ok") & F.col("t").isNotNull() & ~F.isnan("t")
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = frames.withColumn("t", F.when(ok, F.col("t").cast("double")))
    x = x.withColumn("__top", F.max("t").over(before))
    x = x.withColumn("t", F.when(F.col("__top").isNull() | (F.col("t") > F.col("__top")), F.col("t")))
    return x.groupBy(*key).agg(F.count("t").alias("usable"), F.coalesce(F.max("t") - F.min("t"), F.lit(0.0)).alias("span"))


def admitted(samples: Column, temporal: Column, delta: Column, active: Column, extent: Column, static: Column, allow_static: bool = True, least: tuple = (0.008, 0.03, 0.06)) -> Column:
    """Whether a window is searched at all: enough samples over enough time and, unless it is a held pose, mean change, share of active transitions and extent of the way."""
    moving = (delta >= least[0]) & (active >= least[1]) & (extent >= least[2])
    return samples & temporal & F.when(static, F.lit(allow_static)).otherwise(moving)


def crosses_shot(times: Column, start: Column, end: Column) -> Column:
    """Whether a frame lies outside its shot [start, end). Unknown or empty shots are crossed by none."""
    known = start.isNotNull() & end.isNotNull() & (start >= 0) & (end > start)
    return F.coalesce(known & F.exists(times, lambda t: (t < start) | (t >= end)), F.lit(False))


def separate_shots(a: dict[str, Column], b: dict[str, Column], verified: Column) -> Column:
    """Whether two windows (source, shot, s, e, first, last) lie in disjoint shots of one source, each inside its shot, with the same verified person."""
    inside = lambda w: (w["s"] >= 0) & (w["e"] > w["s"]) & (w["first"] >= w["s"]) & (w["last"] < w["e"])
    apart = (a["e"] <= b["s"]) | (b["e"] <= a["s"])
    return F.coalesce((a["source"] == b["source"]) & (a["shot"] != b["shot"]) & inside(a) & inside(b) & apart & verified, F.lit(False))


#: Gates in the order in which a pair meets them, each with its column of m.
GATES = ("shot_boundary", "head_identity", "temporal_support", "identity", "active_body", "direction", "scene_context", "head_geometry", "static_geometry")


def first_rejection(m: dict[str, Column], head_face: float = 0.70, static_pose: float = 0.86, articulation: float = 0.86) -> Column:
    """The first gate that rejects a pair, null if none does.

    m: crosses, static, head_only, direct, face (score), frames (the fewer of both), span (the shorter), needs_identity, candidate, active, direction, context, anatomy,
    temporal, dtw, head_region, articulation.
    """
    pose = F.greatest(F.sqrt(m["dtw"] * m["anatomy"]), m["articulation"])
    rejects = {
        "shot_boundary": m["crosses"],
        "head_identity": m["head_only"] & (m["face"] < head_face) & ~m["direct"],
        "temporal_support": m["head_only"] & m["static"] & ((m["frames"] < 6) | (m["span"] < 0.75)),
        "identity": m["needs_identity"] & ~m["candidate"],
        "active_body": ~m["static"] & (m["active"] < 0.35),
        "direction": ~m["static"] & (m["direction"] < 0.45),
        "scene_context": ~m["static"] & (m["context"] < 0.16) & (F.least(m["anatomy"], m["temporal"], m["dtw"]) < 0.72),
        "head_geometry": m["static"] & m["head_region"] & (m["dtw"] < max(0.90, static_pose)),
        "static_geometry": m["static"] & (pose < static_pose) & (m["articulation"] < articulation),
    }
    out = F.lit(None).cast("string")
    for name in reversed(GATES):
        out = F.when(rejects[name], name).otherwise(out)
    return out


def measured_identity(faces: DataFrame, key: list[str], start: str, end: str, portrait: str) -> DataFrame:
    """(key, compatible): faces (key, t, observed, similarity, eyes, and the interval and kind of the key's picture).

    An observed face in the interval that is clearly another one (similarity .25 or less with eyes apart by .02, or not measurable) is a veto; a portrait in which three
    or more times were inspected needs two that support it (.363 or more).
    """
    x = faces.where((F.col("t") >= F.col(start) - 0.01) & (F.col("t") <= F.col(end) + 0.01))
    seen = F.coalesce("observed", F.lit(False))
    bad = F.col("similarity").isNull() | F.isnan("similarity")
    veto = seen & (bad | ((F.col("eyes") >= 0.02) & (F.col("similarity") <= 0.25)))
    good = seen & ~bad & (F.col("similarity") >= 0.363) & (F.col("eyes") >= 0.02)
    g = x.groupBy(*key).agg(F.max(veto).alias("veto"), F.countDistinct("t").alias("n"), F.countDistinct(F.when(good, F.col("t"))).alias("good"), F.max(portrait).alias("portrait"))
    return g.select(*key, (~F.col("veto") & (~F.col("portrait") | (F.col("n") < 3) | (F.col("good") >= 2))).alias("compatible"))


def repeated_view(static: Column, same_source: Column, gap: Column, context: Column, shape: Column, body: Column) -> Column:
    """Whether a held pose is the same view seen again within 180 s of one source rather than another event."""
    return F.coalesce(static & same_source & (gap <= 180.0) & (context >= 0.97) & (shape >= F.when(body, 0.86).otherwise(0.98)), F.lit(False))


def valid_similarity(x: Column) -> Column:
    """Whether a score may be organised: finite, 0 to 1."""
    return F.coalesce(~F.isnan(x) & (x >= 0.0) & (x <= 1.0), F.lit(False))


def crop_viable(confidence: Column, width: Column, height: Column, frame_width: Column, frame_height: Column) -> Column:
    """Whether a detection's crop is large and upright enough to tell a person by."""
    w, h = F.greatest(F.lit(0.0), width), F.greatest(F.lit(0.0), height)
    aspect = h / F.greatest(w, F.lit(1.0))
    return (confidence >= 0.40) & (w >= F.greatest(F.lit(24.0), frame_width * 0.035)) & (h >= F.greatest(F.lit(48.0), frame_height * 0.08)) & (aspect >= 0.35) & (aspect <= 5.0)


def seen_apart(rows: DataFrame, least: int = 3, span: float = 0.25) -> DataFrame:
    """(owner1, owner2, track1, track2, times): people proven to be two, as the same two tracks show them at disjoint places of one frame `least` times over `span` seconds.

    rows: (frame, t, owner, track, lo, hi, conf), one per owner and frame. An equi-join on the frame; whoever is seen in one frame is few.
    """
    one = rows.groupBy("frame", "t", "owner").agg(F.min_by(F.struct("track", "lo", "hi", "conf"), "track").alias("x")).select("frame", "t", "owner", "x.*")
    a, b = (one.select("frame", "t", *[F.col(c).alias(f"{c}{i}") for c in ("owner", "track", "lo", "hi", "conf")]) for i in (1, 2))
    p = a.join(b, ["frame", "t"]).where("owner1 < owner2 AND hi1 > lo1 AND hi2 > lo2 AND conf1 >= 0.6 AND conf2 >= 0.6 AND (hi1 < lo2 OR hi2 < lo1)")
    g = p.groupBy("owner1", "owner2", "track1", "track2").agg(F.count("*").alias("times"), (F.max("t") - F.min("t")).alias("span"))
    return g.where((F.col("times") >= least) & (F.col("span") >= span)).drop("span")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their rank in an order over all rows, found in two passes so that no task holds them all: rows are sorted over range partitions, numbered within each, and what the
    partitions before hold is added. The numbered rows are checkpointed, as another evaluation could draw other ranges."""
    x = checkpointed(rows.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    x = x.withColumn("__p", F.shiftright("__m", 33)).withColumn("__n", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    before = x.groupBy("__p").agg(F.max("__n").alias("__c"))  # one row a partition
    before = before.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    return x.join(F.broadcast(before), "__p").withColumn(name, (F.col("__n") + F.col("__b")).cast("long")).drop("__m", "__p", "__n", "__b")


def selection_first(threshold: float) -> list[Column]:
    """The order in which pairs take their places: bodies before heads, motion before held poses, heads that face alike before others, then the strongest."""
    head, straight = F.col("head"), F.col("plain") >= threshold
    return [F.asc("head"), F.when(~head, F.col("static")).asc_nulls_last(), F.when(head, ~straight).asc_nulls_last(), F.when(head & straight, -F.col("plain")).asc_nulls_last(), F.desc("score"), F.asc("id")]


def candidate_order(rows: DataFrame, most_open: int, suggested: int | None) -> DataFrame:
    """rows (id, known, presence, quality) with candidate, the place in the list of people: proven ones first, the suggested one, then by presence and quality; of
    those that aren't proven only the first `most_open` are listed, others have a null place."""
    first = F.col("id") != F.lit(suggested) if suggested is not None else F.lit(False)
    good = lambda c: F.when(F.isnan(c) | F.col(c).isNull(), 0.0).otherwise(F.col(c)).desc()
    x = ranked(rows, [F.desc("known"), first.asc(), good("presence"), good("quality"), F.asc("id")], "__seat")
    known = rows.agg(F.count_if("known").alias("__known"))
    x = x.crossJoin(F.broadcast(known))  # one row
    return x.withColumn("candidate", F.when(F.col("known") | (F.col("__seat") - F.col("__known") <= most_open), F.col("__seat"))).drop("__seat", "__known")


def unique_times(rows: DataFrame, key: str, time: str, apart: float = 1e-9) -> DataFrame:
    """(key, time) in order without those that follow another one closer than `apart`."""
    x = rows.select(key, time).withColumn("__p", F.lag(time).over(Window.partitionBy(key).orderBy(time)))
    return x.where(F.col("__p").isNull() | (F.col(time) - F.col("__p") >= apart)).drop("__p")


def face_sums(rows: DataFrame, source: str, shot: str, sure: str, vector: str, tie: str, least: float) -> DataFrame:
    """(source, i, total): by component, the sum of unit vectors of each shot's surest row; zero vectors and those below `least` take no part. Components are summed apart."""
    v = F.col(vector).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    x = rows.where(F.col(sure) >= least).withColumn("__len", length).where("__len > 1e-6")
    best = x.groupBy(source, shot).agg(F.max_by(F.struct(v.alias("v"), "__len"), F.struct(F.col(sure), -F.col(tie))).alias("b"))
    return best.select(source, "b.__len", F.posexplode("b.v").alias("i", "x")).groupBy(source, "i").agg(F.sum(F.col("x") / F.col("__len")).alias("total"))
