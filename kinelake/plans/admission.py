"""Queries about admission, rejection, clip ranges, names and orders. Order lines stand in for measured windows and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import clips, names
from kinelake.functions import vectors as V
from kinelake.operators import admission as A
from kinelake.plans.base import DAY, intervals, query, r6, table, timeline, vectors

_W = """w AS (SELECT l_orderkey AS k, count(*) AS n, (max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate))) / 86400000000.0::DOUBLE / 100 AS span, round(avg(l_tax), 9) / 4 AS delta, round(avg(l_discount), 9) AS active,
    max(l_discount) - min(l_discount) AS extent, l_orderkey % 4 = 0 AS static FROM lineitem GROUP BY l_orderkey)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(86400000000.0)
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count("*").alias("n"), ((F.max(d) - F.min(d)) / 100).alias("span"), (F.round(F.avg("l_tax"), 9) / 4).alias("delta"), F.round(F.avg("l_discount"), 9).alias("active"), (F.max("l_discount") - F.min("l_discount")).alias("extent")
    )
    return w.withColumn("static", F.col("k") % 4 == 0)


@query(f"""WITH {_W}, t AS (SELECT *, n >= 3 AND CASE WHEN static THEN span + 1e-9 >= 0.3 ELSE n >= 7 OR (n >= 6 AND span + 1e-9 >= 0.75) END AS temporal FROM w)
    SELECT k, temporal, n >= 3 AND temporal AND CASE WHEN static THEN true ELSE delta >= 0.008 AND active >= 0.03 AND extent >= 0.06 END AS admitted FROM t""")
def window_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which windows have the temporal support and the motion to be searched."""
    w = windows(spark, sf_dir).withColumn("temporal", A.temporal_support(F.col("n"), F.col("span"), F.col("static"), 7, 0.75))
    return w.select("k", "temporal", A.admitted(F.col("n") >= 3, F.col("temporal"), F.col("delta"), F.col("active"), F.col("extent"), F.col("static")).alias("admitted"))


@query("""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN min(l_partkey) % 9 <> 0 THEN epoch_us(min(l_shipdate)) / 86400000000.0::DOUBLE END AS t FROM lineitem GROUP BY 1, 2),
    y AS (SELECT *, max(t) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x), z AS (SELECT k, CASE WHEN top IS NULL OR t > top THEN t END AS t FROM y)
    SELECT k, count(t) AS usable, round(coalesce(max(t) - min(t), 0), 6) AS span FROM z GROUP BY k""")
def distinct_temporal_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")).agg(F.min("l_shipdate").alias("l_shipdate"), F.min("l_partkey").alias("l_partkey"))
    x = x.select("k", "i", (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(86400000000.0)).alias("t"), (F.col("l_partkey") % 9 != 0).alias("ok"))
    return A.distinct_samples(x, ["k"], "i").select("k", "usable", r6(F.col("span"), "span"))


@query("""WITH x AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) / 86400000000.0::DOUBLE + 30 AS s, CASE WHEN o_orderkey % 5 <> 0 THEN epoch_us(o_orderdate) / 86400000000.0::DOUBLE + 110 END AS e FROM orders)
    SELECT k, coalesce(e IS NOT NULL AND bool_or(d < s OR d >= e), false) AS crosses FROM x JOIN (SELECT l_orderkey AS k, epoch_us(l_shipdate) / 86400000000.0::DOUBLE AS d FROM lineitem) USING (k) GROUP BY k, s, e""")
def shot_boundary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with frames outside their shot."""
    day = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(86400000000.0)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (day("o_orderdate") + 30).alias("s"), F.when(F.col("o_orderkey") % 5 != 0, day("o_orderdate") + 110).alias("e"))
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(day("l_shipdate")).alias("t"))
    return o.join(f, "k").select("k", A.crosses_shot(F.col("t"), F.col("s"), F.col("e")).alias("crosses"))


_MEASURES = {  # name: (modulus, offset), so that a pair's measures are fixed functions of its number
    "face": (31, 7), "active": (37, 3), "direction": (41, 5), "context": (43, 11), "anatomy": (47, 13), "temporal": (53, 17), "dtw": (59, 19), "articulation": (61, 23),
}
_FLAGS = {"crosses": 29, "static": 2, "head_only": 5, "direct": 11, "needs_identity": 7, "head_region": 6}
_M_SQL = ", ".join([f"(l_orderkey * 8 + l_linenumber + {o}) * 7919 % {m} / {m - 1}.0::DOUBLE AS m_{n}" for n, (m, o) in _MEASURES.items()] + [f"(l_orderkey * 8 + l_linenumber) * 104729 % {m} = 0 AS m_{n}" for n, m in _FLAGS.items()])


@query(f"""WITH x AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, (l_orderkey * 8 + l_linenumber) % 13 AS frames, (l_orderkey * 8 + l_linenumber) % 17 / 16.0::DOUBLE AS span, {_M_SQL} FROM lineitem)
    SELECT id, CASE WHEN m_crosses THEN 'shot_boundary' WHEN m_head_only AND m_face < 0.7 AND NOT m_direct THEN 'head_identity' WHEN m_head_only AND m_static AND (frames < 6 OR span < 0.75) THEN 'temporal_support'
    WHEN m_needs_identity AND id % 3 <> 0 THEN 'identity' WHEN NOT m_static AND m_active < 0.35 THEN 'active_body' WHEN NOT m_static AND m_direction < 0.45 THEN 'direction'
    WHEN NOT m_static AND m_context < 0.16 AND (m_anatomy < 0.72 OR m_temporal < 0.72 OR m_dtw < 0.72) THEN 'scene_context' WHEN m_static AND m_head_region AND m_dtw < 0.9 THEN 'head_geometry'
    WHEN m_static AND greatest(sqrt(m_dtw * m_anatomy), m_articulation) < 0.86 AND m_articulation < 0.86 THEN 'static_geometry' END AS rejection FROM x""")
def first_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which gate rejects each pair first."""
    key = F.col("id")
    m = {n: (key + o) * 7919 % k / F.lit(float(k - 1)) for n, (k, o) in _MEASURES.items()} | {n: key * 104729 % k == 0 for n, k in _FLAGS.items()}
    m |= {"frames": key % 13, "span": key % 17 / F.lit(16.0), "candidate": key % 3 == 0}
    x = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).distinct()
    return x.select("id", A.first_rejection(m).alias("rejection"))


@query("""WITH f AS (SELECT l_orderkey AS k, epoch_us(l_shipdate) / 86400000000.0::DOUBLE AS t, l_partkey % 4 <> 0 AS observed, CASE WHEN l_partkey % 50 <> 0 THEN 0.2 + (l_suppkey % 20) / 25.0::DOUBLE END AS sim, (l_partkey % 7) / 100.0::DOUBLE AS eyes FROM lineitem),
    b AS (SELECT k, min(t) + 5 AS s, max(t) - 5 AS e, k % 2 = 0 AS portrait FROM f GROUP BY k), x AS (SELECT f.*, portrait FROM f JOIN b USING (k) WHERE t >= s - 0.01 AND t <= e + 0.01),
    g AS (SELECT k, bool_or(observed AND (sim IS NULL OR (eyes >= 0.02 AND sim <= 0.25))) AS veto, count(DISTINCT t) AS n, count(DISTINCT t) FILTER (WHERE observed AND sim >= 0.363 AND eyes >= 0.02) AS good, bool_or(portrait) AS portrait FROM x GROUP BY k)
    SELECT k, NOT veto AND (NOT portrait OR n < 3 OR good >= 2) AS compatible FROM g""")
def measured_identity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures whose measured faces allow the person that they are said to show."""
    day = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(86400000000.0)
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), day.alias("t"), (F.col("l_partkey") % 4 != 0).alias("observed"), F.when(F.col("l_partkey") % 50 != 0, 0.2 + (F.col("l_suppkey") % 20) / 25.0).alias("similarity"), ((F.col("l_partkey") % 7) / 100.0).alias("eyes"))
    b = f.groupBy("k").agg((F.min("t") + 5).alias("s"), (F.max("t") - 5).alias("e")).withColumn("portrait", F.col("k") % 2 == 0)
    return A.measured_identity(f.join(b, "k"), ["k"], "s", "e", "portrait")


@query("""WITH {timeline}, o AS (SELECT floor(t / 900)::BIGINT AS frame, source % 6 AS owner, source AS track, (source % 40) * 1.0::DOUBLE AS lo, 0.5 + (event_id % 5) / 10.0::DOUBLE AS conf FROM timeline),
    one AS (SELECT frame, owner, min(track) AS track, min_by(lo, track) AS lo, min_by(conf, (track, lo, conf)) AS conf FROM o GROUP BY 1, 2),
    p AS (SELECT a.owner AS owner1, b.owner AS owner2, a.track AS track1, b.track AS track2, a.frame FROM one a JOIN one b ON a.frame = b.frame AND a.owner < b.owner WHERE a.conf >= 0.6 AND b.conf >= 0.6 AND (a.lo + 6 < b.lo OR b.lo + 6 < a.lo))
    SELECT owner1, owner2, track1, track2, count(*) AS times FROM p GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2 AND (max(frame) - min(frame)) * 900.0 >= 0.25""")
def people_seen_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners that two tracks prove to be different people, by frames that show both apart."""
    o = timeline(spark, sf_dir).select(F.floor(F.col("t") / 900).alias("frame"), (F.col("source") % 6).alias("owner"), F.col("source").alias("track"), (F.col("source") % 40).cast("double").alias("lo"), (0.5 + (F.col("event_id") % 5) / 10.0).alias("conf"))
    o = o.groupBy("frame", "owner", "track", "lo").agg(F.min("conf").alias("conf")).select("frame", (F.col("frame") * 900.0).alias("t"), "owner", "track", "lo", (F.col("lo") + 6).alias("hi"), "conf")
    return A.seen_apart(o, 2, 0.25)


@query("""WITH {intervals}, x AS (SELECT id, s, e, CASE WHEN id % 7 <> 0 THEN s - (id % 20) END AS a, e + (id % 11) - 3 AS z FROM (SELECT id, (s / 86400) % 1000 AS s, (s / 86400) % 1000 + (id % 13) AS e FROM intervals)),
    m AS (SELECT *, s AS ms, CASE WHEN z > e THEN least(s + (e - s) + 0.5 / 24, z) ELSE s + (e - s) + 0.5 / 24 END AS me FROM x),
    p AS (SELECT *, coalesce(a >= 0 AND z > a AND s >= a AND e < z, false) AS fits, least(1.25, greatest(0, 12 - (me - ms)) * 0.5) AS pad FROM m)
    SELECT id, round(ms, 6) AS match_start, round(me, 6) AS match_end, round(CASE WHEN NOT fits THEN ms WHEN z - a <= 12 THEN a ELSE greatest(a, ms - pad) END, 6) + 0.0 AS clip_start,
    round(CASE WHEN NOT fits THEN me WHEN z - a <= 12 THEN z ELSE least(z, me + pad) END, 6) AS clip_end, coalesce(a > 0 AND abs(s - a) < 1e-6, false) AS refine FROM p""")
def clip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of matches and of the clips around them."""
    s = (F.col("s") / 86400) % 1000
    x = intervals(spark, sf_dir).select("id", s.alias("s"), (s + F.col("id") % 13).alias("e"))
    a, z = F.when(F.col("id") % 7 != 0, F.col("s") - F.col("id") % 20), F.col("e") + F.col("id") % 11 - 3
    x = x.select("id", clips.match_range(F.col("s"), F.col("e"), a, z).alias("m"), clips.shot_range(F.col("s"), F.col("e"), a, z).alias("c"), clips.start_needs_refinement(F.col("s"), a).alias("refine"))
    return x.select("id", r6(F.col("m.start"), "match_start"), r6(F.col("m.end"), "match_end"), r6(F.col("c.start"), "clip_start"), r6(F.col("c.end"), "clip_end"), "refine")


_NAMES = lambda n, c: "[" + ", ".join(f"'{x}'" for x in n) + f"][{c} + 1]"


@query(f"""WITH x AS (SELECT p_partkey AS k, p_partkey % 9 AS d, p_partkey % 7 AS d2, p_partkey % 18 AS g, p_partkey % 16 AS r, (p_partkey % 3)::DOUBLE AS ca, (p_partkey % 2)::DOUBLE AS cb, (p_partkey * 37 % 401) - 200.0::DOUBLE AS yaw FROM part),
    n AS (SELECT *, coalesce({_NAMES(names.DIRECTIONS, 'd')}, 'unknown') AS a, coalesce({_NAMES(names.DIRECTIONS, 'd2')}, 'unknown') AS b, CASE WHEN abs(yaw) <= 180 THEN (floor((yaw + 22.5) / 45)::INTEGER + 8) % 8 + 1 ELSE 0 END AS view FROM x)
    SELECT k, a AS direction, coalesce({_NAMES(names.GESTURES, 'g')}, 'unknown') AS gesture, coalesce({_NAMES(names.FAMILY_REASONS, 'r')}, 'invalid_range') AS reason, CASE WHEN a = b THEN a WHEN ca <= 0 THEN b WHEN cb <= 0 THEN a ELSE 'mixed' END AS combined,
    view, k % 5 IN (2, 3) AND view > 0 AND view = k % 9 AND k % 6 >= 3 AND k % 8 >= k % 6 AS body, view > 0 AND view = k % 9 AND (k % 4) / 2.0 > 0 AND (k % 4) / 2.0 <= 1 AS head FROM n""")
def class_names_and_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes as names, classes of two sides combined, and which views are supported."""
    k = F.col("k")
    a, b = names.named(k % 9, names.DIRECTIONS, "unknown"), names.named(k % 7, names.DIRECTIONS, "unknown")
    yaw = (k * 37 % 401).cast("double") - 200.0
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select(
        "k", a.alias("direction"), names.named(k % 18, names.GESTURES, "unknown").alias("gesture"), names.named(k % 16, names.FAMILY_REASONS, "invalid_range").alias("reason"), names.combined_class(a, b, k % 3, k % 2).alias("combined"),
        names.view_of(yaw).alias("view"), names.body_supported(k % 5, yaw, k % 9, k % 6, k % 8).alias("body"), names.head_supported(yaw, k % 9, (k % 4) / 2.0).alias("head"),
    )


@query("""WITH x AS (SELECT p_partkey AS k, p_size * 1.0::DOUBLE AS w, p_partkey % 160 + 20.0::DOUBLE AS h, (p_partkey % 10) / 10.0::DOUBLE AS c, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 1.5 ELSE p_size / 50.0 END AS score FROM part)
    SELECT k, c >= 0.4 AND w >= greatest(24, 640 * 0.035) AND h >= greatest(48, 360 * 0.08) AND h / greatest(w, 1) BETWEEN 0.35 AND 5 AS crop, coalesce(NOT isnan(score) AND score >= 0 AND score <= 1, false) AS valid,
    k % 2 = 0 AND k % 3 <> 0 AND k % 300 <= 180 AND 0.9 + (k % 10) / 90.0 >= 0.97 AND 0.8 + (k % 21) / 100.0 >= CASE WHEN k % 4 = 0 THEN 0.86 ELSE 0.98 END AS repeated FROM x""")
def crop_score_and_view_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    score = F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, float("nan")).when(k % 6 == 2, 1.5).otherwise(F.col("p_size") / 50.0)
    crop = A.crop_viable((k % 10) / 10.0, F.col("p_size").cast("double"), k % 160 + 20.0, F.lit(640.0), F.lit(360.0))
    again = A.repeated_view(k % 2 == 0, k % 3 != 0, k % 300, 0.9 + (k % 10) / 90.0, 0.8 + (k % 21) / 100.0, k % 4 == 0)
    return table(spark, sf_dir, "part").select(k.alias("k"), crop.alias("crop"), A.valid_similarity(score).alias("valid"), again.alias("repeated"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS source, l_suppkey % 11 AS other, l_orderkey % 6 AS shot, l_orderkey % 7 AS shot2, l_partkey % 5 = 0 AS verified, epoch_us(l_shipdate) / 86400000000.0::DOUBLE AS t FROM lineitem)
    SELECT id, source % 11 = other AND shot <> shot2 AND t % 100 >= shot * 15 AND t % 100 < shot * 15 + 15 AND (t + 20) % 100 >= shot2 * 15 AND (t + 20) % 100 < shot2 * 15 + 15 AND verified AS separate FROM s""")
def separate_verified_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_suppkey", "l_orderkey", "l_partkey", (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(86400000000.0)).alias("t")).distinct()

    def side(shot, t):
        return {"source": F.col("l_suppkey") % 11, "shot": shot, "s": shot * 15, "e": shot * 15 + 15, "first": t % 100, "last": t % 100}

    a, b = side(F.col("l_orderkey") % 6, F.col("t")), side(F.col("l_orderkey") % 7, F.col("t") + 20)
    return x.select("id", A.separate_shots(a, b, F.col("l_partkey") % 5 == 0).alias("separate"))


@query("""WITH p AS (SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    j AS (SELECT id, unnest(range(1, 17)) AS i, x, y FROM p), q AS (SELECT id, least(abs(x[32 + i]) * 4, abs(y[32 + i]) * 4) AS q, sqrt((x[2 * i - 1] - y[2 * i - 1]) ** 2 + (x[2 * i] - y[2 * i]) ** 2) AS d FROM j),
    g AS (SELECT id, sum(q * d) / sum(q) AS d, count(*) AS n FROM q WHERE q >= 0.5 GROUP BY id) SELECT p.id, round(CASE WHEN n >= 5 THEN d END, 6) AS distance, round(CASE WHEN n >= 5 THEN exp(-d) END, 6) AS similarity FROM p LEFT JOIN g USING (id)""")
def scene_pose_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of poses over the joints that both scenes show well."""
    v = vectors(spark, sf_dir).select("id", F.col("v").cast("array<double>").alias("v"))
    p = v.withColumnRenamed("v", "x").join(v.select((F.col("id") - 1).alias("id"), F.col("v").alias("y")), "id")
    scaled = lambda c: F.transform(F.slice(c, 33, 16), lambda e: F.abs(e) * 4)
    d = V.pose_distance(F.slice("x", 1, 32), F.slice("y", 1, 32), scaled("x"), scaled("y"))
    return p.select("id", F.round(d, 6).alias("distance"), F.round(F.exp(-d), 6).alias("similarity"))


@query("""WITH x AS (SELECT p_partkey AS id, p_partkey % 5 = 0 AS head, p_partkey % 2 = 0 AS static, (p_partkey % 97) / 96.0::DOUBLE AS plain, (p_partkey % 89) / 88.0::DOUBLE AS score, (p_partkey % 83)::DOUBLE AS presence, (p_partkey % 79)::DOUBLE AS quality, p_partkey % 3 = 0 AS distinct_ FROM part),
    f AS (SELECT *, row_number() OVER (ORDER BY head, CASE WHEN NOT head THEN static END, CASE WHEN head THEN plain < 0.8 END, CASE WHEN head AND plain >= 0.8 THEN -plain END, score DESC, id) AS first_, row_number() OVER (ORDER BY score DESC, id) AS best,
    row_number() OVER (ORDER BY NOT distinct_, id <> 17, presence DESC, quality DESC, id) AS seat FROM x), u AS (SELECT *, sum((NOT distinct_)::INTEGER) OVER (ORDER BY seat) AS open_ FROM f)
    SELECT id, first_ AS selection, best AS organized, CASE WHEN distinct_ OR open_ <= 20 THEN seat END AS candidate FROM u""")
def selection_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks in the orders that selection, organisation and the list of people use."""
    k = F.col("p_partkey")
    x = table(spark, sf_dir, "part").select(k.alias("id"), (k % 5 == 0).alias("head"), (k % 2 == 0).alias("static"), (k % 97 / 96.0).alias("plain"), (k % 89 / 88.0).alias("score"), (k % 83).cast("double").alias("presence"), (k % 79).cast("double").alias("quality"), (k % 3 == 0).alias("known"))
    x = A.ranked(x, A.selection_first(0.8), "selection")
    x = A.ranked(x, [F.desc("score"), F.asc("id")], "organized")
    return A.candidate_order(x, 20, 17).select("id", "selection", "organized", "candidate")


@query("""WITH {timeline}, a AS (SELECT source, floor(t / 86400)::BIGINT AS shot, t, event_id FROM timeline), w AS (SELECT source, shot, min_by(event_id, (-(event_id % 100), event_id)) AS e FROM a WHERE event_id % 100 >= 45 GROUP BY 1, 2),
    u AS (SELECT source, e % (SELECT count(*) FROM embeddings) AS vec_id FROM w), n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS len FROM embeddings),
    c AS (SELECT source, unnest(v) / len AS x, unnest(range(len(v))) AS i FROM u JOIN n USING (vec_id) WHERE len > 1e-6) SELECT source, i, round(sum(x), 6) + 0.0 AS total FROM c WHERE i < 4 GROUP BY 1, 2""")
def source_face_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of unit vectors over the surest window of each shot of a source (four components)."""
    n = table(spark, sf_dir, "embeddings").count()
    a = timeline(spark, sf_dir).select("source", F.floor(F.col("t") / DAY).alias("shot"), "event_id", (F.col("event_id") % n).alias("id"), ((F.col("event_id") % 100) / 100.0).alias("sure"))
    s = A.face_sums(a.join(vectors(spark, sf_dir).select("id", "v"), "id"), "source", "shot", "sure", "v", "event_id", 0.45)
    return s.where("i < 4").select("source", "i", r6(F.col("total"), "total"))


@query("""WITH {timeline}, x AS (SELECT source, t, lag(t) OVER (PARTITION BY source ORDER BY t) AS p FROM (SELECT source, floor(t / 7200) * 7200.0 AS t FROM timeline)) SELECT source, t FROM x WHERE p IS NULL OR t - p >= 1e-9""")
def unique_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unique_times(timeline(spark, sf_dir).select("source", (F.floor(F.col("t") / 7200) * 7200.0).alias("t")), "source", "t")


@query("""WITH x AS (SELECT o_custkey AS k, list_distinct(list(CASE WHEN o_orderkey % 4 = 0 THEN 'group:' || (o_orderkey % 9) ELSE o_orderpriority END)) AS present FROM orders GROUP BY 1),
    y AS (SELECT k, present, list_sort(list_filter(present, lambda p: p LIKE 'group:%')) AS groups, list_filter(['group:8', '3-MEDIUM', 'group:0', '1-URGENT'], lambda p: list_contains(present, p)) AS keys FROM x),
    z AS (SELECT *, coalesce(list_position(list_transform(keys, lambda p: p NOT LIKE 'group:%'), true), len(keys) + 1) AS pos FROM y)
    SELECT k, array_to_string(list_concat(list_concat(keys[1:pos - 1], list_filter(groups, lambda g: NOT list_contains(keys, g))), keys[pos:]), '|') AS export_order FROM z""")
def export_class_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of exported classes: named ones that are present, manual groups that weren't named before the first class."""
    key = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("group:"), (F.col("o_orderkey") % 9).cast("string"))).otherwise(F.col("o_orderpriority"))
    x = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(key).alias("present"))
    groups = F.filter("present", lambda p: p.startswith("group:"))
    asked = F.array(*[F.lit(c) for c in ("group:8", "3-MEDIUM", "group:0", "1-URGENT")])
    return x.select("k", F.array_join(names.export_class_order(asked, F.col("present"), groups), "|").alias("export_order"))


@query("""WITH x AS (SELECT p_partkey AS i, (p_size % 51) / 50.0::DOUBLE AS score, p_partkey % 3 = 0 AS verified, (p_partkey % 10) / 10.0::DOUBLE AS identity, p_partkey % 5 <> 0 AS l, p_partkey % 7 <> 0 AS r, p_size % 9 + 0.0::DOUBLE AS s FROM part)
    SELECT i, '#' || i || '  ' || printf('%.1f', score * 100) || '%' AS head, '  Identity: ' || CASE WHEN verified THEN 'verified' ELSE 'pose-only' END || ' (' || printf('%.3f', identity) || ')' AS person,
    '  Duration: ' || printf('%.3f', CASE WHEN l AND r THEN 3.0 WHEN l THEN 2.0 WHEN r THEN 4.0 ELSE 0 END) || ' s' AS duration, '  A: ' || CASE WHEN l THEN '' ELSE '[disabled] ' END || 'src  ' || printf('%.3f', s) || '–' || printf('%.3f', s + 2) || ' s' AS a FROM x""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as lines of a plain text export."""
    from kinelake.sources.formats import text_result

    k = F.col("p_partkey")
    s = F.col("p_size") % 9 + F.lit(0.0)
    left = {"on": k % 5 != 0, "source": F.lit("src"), "start": s, "end": s + 2}
    right = {"on": k % 7 != 0, "source": F.lit("other"), "start": s, "end": s + 4}
    lines = text_result(k, (F.col("p_size") % 51) / 50.0, k % 3 == 0, (k % 10) / 10.0, F.lit(3.0), left, right)
    return table(spark, sf_dir, "part").select(k.alias("i"), lines[0].alias("head"), lines[1].alias("person"), lines[2].alias("duration"), lines[3].alias("a"))
