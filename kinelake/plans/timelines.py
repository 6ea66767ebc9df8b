"""Queries on timelines and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import vectors as V
from kinelake.operators import timeline as T
from kinelake.plans.base import DAY, intervals, query, r6, table, timeline


@query("""
    WITH {timeline}, r AS (SELECT event_id, source, t FROM timeline WHERE kind = 'error'), f AS (SELECT source, t AS ft FROM timeline WHERE kind = 'click')
    SELECT r.event_id, CASE WHEN min(ft) - any_value(r.t) <= 172800 THEN min(ft) END AS frame_t
    FROM r LEFT JOIN f ON r.source = f.source AND f.ft >= r.t GROUP BY r.event_id""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir)
    return T.asof_forward(t.where("kind = 'error'").select("source", "t", "event_id"), t.where("kind = 'click'"), 2 * DAY).select("event_id", "frame_t")


@query("""
    WITH {timeline}, r AS (SELECT event_id, source, t FROM timeline WHERE kind = 'purchase'), f AS (SELECT source, t AS ft FROM timeline WHERE kind = 'view'),
    n AS (SELECT r.event_id, ft, row_number() OVER (PARTITION BY r.event_id ORDER BY abs(ft - r.t), ft) AS k FROM r JOIN f ON r.source = f.source AND abs(ft - r.t) <= 43200)
    SELECT r.event_id, ft AS frame_t FROM r LEFT JOIN n ON r.event_id = n.event_id AND k = 1""")
def asof_nearest_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir)
    return T.asof_nearest(t.where("kind = 'purchase'").select("source", "t", "event_id"), t.where("kind = 'view'"), DAY / 2).select("event_id", "frame_t")


@query("""
    WITH {timeline}, {intervals}, p AS (SELECT source, t - 820540800 AS t, v FROM timeline)
    SELECT i.id, i.s, i.e, count(*) AS notes, round(sum(v), 4) + 0.0 AS total FROM p JOIN intervals i ON p.source = i.source AND p.t >= i.s - 0.01 AND p.t <= i.e + 0.01 GROUP BY ALL""")
def notes_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the events' month, moved by 26 years into the orders' time."""
    x = T.points_in_intervals(timeline(spark, sf_dir).withColumn("t", F.col("t") - 820540800), intervals(spark, sf_dir), 0.01, 30 * DAY)
    return x.groupBy("id", "s", "e").agg(F.count("*").alias("notes"), (F.round(F.sum("v"), 4) + 0.0).alias("total"))


@query("""
    WITH {intervals}, x AS (SELECT a.source, least(a.e, b.e) - greatest(a.s, b.s) AS o FROM intervals a JOIN intervals b ON a.source = b.source AND a.id < b.id AND greatest(a.s, b.s) < least(a.e, b.e))
    SELECT source, count(*) AS pairs, round(sum(o), 3) AS overlap FROM x GROUP BY source""")
def interval_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.overlapping_pairs(intervals(spark, sf_dir), 30 * DAY)
    return x.groupBy("source").agg(F.count("*").alias("pairs"), F.round(F.sum("overlap"), 3).alias("overlap"))


@query("""
    WITH {intervals}, p AS (SELECT id, source, s, e, lead(id) OVER w AS id2, lead(s) OVER w AS s2, lead(e) OVER w AS e2 FROM intervals WINDOW w AS (PARTITION BY source ORDER BY s, id, e)),
    q AS (SELECT * FROM p WHERE id2 IS NOT NULL AND e > s AND e2 > s2),
    x AS (SELECT a.id AS a, b.id AS b,
            greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s) AS d1, greatest(0, least(a.e2, b.e2) - greatest(a.s2, b.s2)) / least(a.e2 - a.s2, b.e2 - b.s2) AS d2,
            greatest(0, least(a.e, b.e2) - greatest(a.s, b.s2)) / least(a.e - a.s, b.e2 - b.s2) AS w1, greatest(0, least(a.e2, b.e) - greatest(a.s2, b.s)) / least(a.e2 - a.s2, b.e - b.s) AS w2
          FROM q a JOIN q b ON a.source = b.source AND a.id < b.id)
    SELECT DISTINCT a, b, d1 >= 0.7000001 AND d2 >= 0.7000001 AS direct, w1 >= 0.7000001 AND w2 >= 0.7000001 AS swapped FROM x WHERE (d1 >= 0.7000001 AND d2 >= 0.7000001) OR (w1 >= 0.7000001 AND w2 >= 0.7000001)""")
def duplicate_intervals_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results (pairs of a source's intervals that follow each other) that cover the same two ranges, in the same or in swapped order."""
    w = Window.partitionBy("source").orderBy("s", "id", "e")
    q = intervals(spark, sf_dir).select("*", *[F.lead(c).over(w).alias(f"{c}2") for c in ("id", "s", "e")]).where("id2 IS NOT NULL AND e > s AND e2 > s2")
    a, b = (q.select("source", *[F.col(c).alias(f"{k}{c}") for c in ("id", "s", "e", "s2", "e2")]) for k in "ab")
    c = F.col
    share = lambda s, e, s2, e2: F.greatest(F.lit(0.0), F.least(c(e), c(e2)) - F.greatest(c(s), c(s2))) / F.least(c(e) - c(s), c(e2) - c(s2))
    direct = (share("as", "ae", "bs", "be") >= 0.7000001) & (share("as2", "ae2", "bs2", "be2") >= 0.7000001)
    swapped = (share("as", "ae", "bs2", "be2") >= 0.7000001) & (share("as2", "ae2", "bs", "be") >= 0.7000001)
    x = a.join(b, "source").where("aid < bid").select(c("aid").alias("a"), c("bid").alias("b"), direct.alias("direct"), swapped.alias("swapped"))
    return x.where("direct OR swapped").distinct()


@query("""
    WITH {timeline}, b AS (SELECT DISTINCT source, floor(t / 3600)::BIGINT AS slot FROM timeline)
    SELECT x.source AS a, y.source AS b, count(*) AS together, max(x.slot) - min(x.slot) AS span FROM b x JOIN b y ON x.slot = y.slot AND x.source < y.source GROUP BY 1, 2 HAVING count(*) >= 3""")
def covisible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources seen in the same time slots, three times or more: different people."""
    b = timeline(spark, sf_dir).select("source", F.floor(F.col("t") / 3600).alias("slot")).distinct()
    return T.seen_together(b, 3)


@query("""
    SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 2.0 AND abs(a.p_size - b.p_size) <= 1""")
def range_join_multi_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.range_pairs(table(spark, sf_dir, "part"), "p_partkey", {"p_retailprice": 2.0, "p_size": 1.0}).select("a", "b")


@query("""
    WITH {intervals}, m AS (SELECT source, s, e, max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM intervals)
    SELECT source, round(sum(greatest(0, e - greatest(s, coalesce(p, s)))), 3) AS presence FROM m GROUP BY source""")
def interval_union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.merged(intervals(spark, sf_dir)).groupBy("source").agg(F.round(F.sum(F.col("e") - F.col("s")), 3).alias("presence"))


@query("""
    WITH {intervals}, m AS (SELECT *, max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM intervals),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
    u AS (SELECT source, k, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT source, count(*) AS islands, max(n) AS most, round(sum(e - s) / (max(e) - min(s)), 6) AS busy FROM u GROUP BY source""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands, the largest one and the busy share of each source. The SQL rounds millionths, a product of doubles; Spark's round to 6 decimals rounds decimal digits, and 323 of 640 days differ."""
    m = T.merged(intervals(spark, sf_dir))
    busy = F.round(F.sum(F.col("e") - F.col("s")) / (F.max("e") - F.min("s")) * 1e6) / 1e6
    return m.groupBy("source").agg(F.count("*").alias("islands"), F.max("n").alias("most"), busy.alias("busy"))


_RUNS = """
    WITH {timeline}, l AS (SELECT *, lag(kind) OVER w AS pk, lag(t) OVER w AS pt FROM timeline WINDOW w AS (PARTITION BY source ORDER BY t, event_id)),
    g AS (SELECT *, sum(CASE WHEN pk IS NULL OR pk <> kind OR t - pt > 172800 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
    r AS (SELECT source, run, kind, min(t) AS s, max(t) AS e, count(*) AS n FROM g GROUP BY 1, 2, 3)
"""


@query(_RUNS + "SELECT source, kind, s, e, n FROM r WHERE n >= 3 AND e - s >= 3600")
def gap_islands_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.runs(timeline(spark, sf_dir), "kind", 2 * DAY, ("t", "event_id")).where("n >= 3 AND e - s >= 3600").select("source", "kind", "s", "e", "n")


@query("""
    WITH {timeline}, s AS (SELECT *, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS shot FROM timeline)
    SELECT source, shot::BIGINT AS shot, count(*) AS frames, min(t) AS s, max(t) AS e FROM s GROUP BY 1, 2""")
def shot_ids_from_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.shots(timeline(spark, sf_dir), F.col("kind") == "error", ("t", "event_id"))
    return x.groupBy("source", "shot").agg(F.count("*").alias("frames"), F.min("t").alias("s"), F.max("t").alias("e"))


@query("""
    WITH {timeline}, {intervals}, c AS (SELECT DISTINCT source, t FROM timeline WHERE kind = 'error'),
    x AS (SELECT id, source, s AS edge FROM intervals UNION ALL SELECT i.id, i.source, c.t FROM intervals i JOIN c ON i.source = c.source AND c.t > i.s AND c.t < i.e UNION ALL SELECT id, source, e FROM intervals),
    y AS (SELECT id, source, (row_number() OVER w - 1)::INTEGER AS part, edge AS s, lead(edge) OVER w AS e FROM x WINDOW w AS (PARTITION BY id, source ORDER BY edge))
    SELECT id, source, part, s, e FROM y WHERE e IS NOT NULL""")
def split_windows_at_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.split_at(intervals(spark, sf_dir), timeline(spark, sf_dir).where("kind = 'error'").select("source", "t"), 30 * DAY)


@query("""
    WITH {timeline}, l AS (SELECT *, lag(v) OVER w AS pv, lag(t) OVER w AS pt, lead(v) OVER w AS nv FROM timeline WINDOW w AS (PARTITION BY source ORDER BY t, event_id))
    SELECT event_id, pt AS before_t, t AS after_t, round(abs(v - pv), 6) + 0.0 AS delta FROM l WHERE abs(v - pv) >= 60 AND abs(v - pv) >= 3 * abs(nv - v)""")
def lag_delta_cut_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("t", "event_id")
    x = timeline(spark, sf_dir).withColumn("pv", F.lag("v").over(w)).withColumn("before_t", F.lag("t").over(w)).withColumn("nv", F.lead("v").over(w))
    d = F.abs(F.col("v") - F.col("pv"))
    return x.where((d >= 60) & (d >= 3 * F.abs(F.col("nv") - F.col("v")))).select("event_id", "before_t", F.col("t").alias("after_t"), r6(d, "delta"))


@query("""
    WITH {timeline}, l AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS c FROM timeline WINDOW w AS (PARTITION BY source ORDER BY t, event_id))
    SELECT event_id, round(CASE WHEN a IS NULL OR c IS NULL THEN v ELSE greatest(least(a, v), least(greatest(a, v), c)) END, 6) + 0.0 AS median3 FROM l""")
def median3_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.median3(timeline(spark, sf_dir), "v", ("t", "event_id")).select("event_id", r6(F.col("median3"), "median3"))


@query("""
    WITH {timeline}, z AS (SELECT *, t - min(t) OVER (PARTITION BY source) AS u FROM timeline)
    SELECT event_id, round(regr_slope(v, u / 86400) OVER (PARTITION BY source ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) + 0.0 AS slope FROM z""")
def local_slope_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = timeline(spark, sf_dir).withColumn("t0", F.min("t").over(Window.partitionBy("source")))
    z = z.select("source", "event_id", "v", F.col("t").alias("o"), ((F.col("t") - F.col("t0")) / DAY).alias("t"))
    return T.local_slope(z, "v", 2, ("o", "event_id")).select("event_id", (F.round("slope", 5) + 0.0).alias("slope"))


@query("""
    WITH {timeline}, m AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE v END AS x FROM timeline),
    k AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER p AS pt, last_value(x IGNORE NULLS) OVER p AS px,
          first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER n AS nt, first_value(x IGNORE NULLS) OVER n AS nx FROM m
          WINDOW p AS (PARTITION BY source ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY source ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(x, CASE WHEN nt - pt <= 172800 THEN px + (nx - px) * (t - pt) / nullif(nt - pt, 0) END), 6) + 0.0 AS filled FROM k""")
def linear_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = timeline(spark, sf_dir).withColumn("x", F.when(F.col("event_id") % 4 != 0, F.col("v")))
    return T.filled(m, "x", 2 * DAY, ("t", "event_id")).select("event_id", r6(F.col("filled"), "filled"))


@query("""
    WITH {timeline}, d AS (SELECT source, v, abs(v - lag(v) OVER (PARTITION BY source ORDER BY t, event_id)) AS d FROM timeline),
    a AS (SELECT source, list_sort(list(d) FILTER (WHERE d IS NOT NULL)) AS l, list_sort(list(v)) AS x FROM d GROUP BY source),
    m AS (SELECT source, l, x, x[len(x) // 2 + 1] AS med FROM a)
    SELECT source, round(l[len(l) // 2 + 1], 6) + 0.0 AS noise_floor, round(l[(len(l) - 1) // 4 + 1], 6) + 0.0 AS lower_quartile, round(list_sort(list_transform(x, lambda q: abs(q - med)))[len(x) // 2 + 1], 6) + 0.0 AS mad FROM m""")
def noise_floor_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("t", "event_id")
    d = timeline(spark, sf_dir).withColumn("d", F.abs(F.col("v") - F.lag("v").over(w)))
    a = d.groupBy("source").agg(F.collect_list("d").alias("l"), F.collect_list("v").alias("x"))
    return a.select("source", r6(V.upper_median(F.col("l")), "noise_floor"), r6(V.lower_quartile(F.col("l")), "lower_quartile"), r6(V.median_deviation(F.col("x")), "mad"))


@query("""
    WITH {timeline}, d AS (SELECT source, floor(t / 604800)::BIGINT AS wk, avg(v) FILTER (WHERE kind = 'click') AS l, avg(v) FILTER (WHERE kind = 'view') AS r FROM timeline GROUP BY 1, 2)
    SELECT source, count(*) AS n, round(corr(l, r), 6) + 0.0 AS feet FROM d WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY source HAVING count(*) >= 3""")
def foot_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of two trajectories of a source, sampled by week."""
    pick = lambda k: F.avg(F.when(F.col("kind") == k, F.col("v")))
    d = timeline(spark, sf_dir).groupBy("source", F.floor(F.col("t") / (7 * DAY)).alias("wk")).agg(pick("click").alias("l"), pick("view").alias("r")).where("l IS NOT NULL AND r IS NOT NULL")
    return d.groupBy("source").agg(F.count("*").alias("n"), r6(F.corr("l", "r"), "feet")).where("n >= 3")


@query("""
    WITH {timeline}, s AS (SELECT *, floor(t / 21600)::BIGINT AS slot FROM timeline)
    SELECT source, count(*) AS raw, count(DISTINCT slot) AS samples, round(least(1.0, count(DISTINCT slot) / 3.0), 6) AS evidence, round(sum(v), 6) + 0.0 AS duration, round(avg(v), 6) + 0.0 AS area, min(t) AS first_t, max(t) AS last_t FROM s GROUP BY source""")
def track_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track: distinct samples, saturating evidence, duration, mean area, first and last time."""
    from kinelake.functions.scores import evidence

    slot = F.floor(F.col("t") / 21600)
    return timeline(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("raw"), F.countDistinct(slot).alias("samples"), r6(evidence(F.countDistinct(slot)), "evidence"), r6(F.sum("v"), "duration"), r6(F.avg("v"), "area"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    )


@query("""
    WITH {timeline}, a AS (SELECT source, sum(v) AS total, avg(v) AS area, count(*) AS n, min(t) AS first_t FROM timeline GROUP BY source)
    SELECT source, round(total, 6) AS total, n FROM a ORDER BY total DESC, area DESC, n DESC, first_t, source LIMIT 1""")
def dominant_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source with the largest total, ties by area, samples, first time and id: one max over a struct, no sort."""
    a = timeline(spark, sf_dir).groupBy("source").agg(F.sum("v").alias("total"), F.avg("v").alias("area"), F.count("*").alias("n"), F.min("t").alias("first_t"))
    best = a.agg(F.max(F.struct("total", "area", "n", (-F.col("first_t")).alias("f"), (-F.col("source")).alias("s"))).alias("b"))
    return best.select((-F.col("b.s")).alias("source"), r6(F.col("b.total"), "total"), F.col("b.n").alias("n"))


@query("""
    WITH {timeline}, l AS (SELECT *, lag(t) OVER w AS pt FROM timeline WINDOW w AS (PARTITION BY source ORDER BY t, event_id)),
    g AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt >= 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM l)
    SELECT source, min(t) AS s, max(t) + 43200 AS e, count(*) AS n, round(sum(v), 6) + 0.0 AS total FROM g GROUP BY source, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that half a day without events ends; the same plan runs on a stream."""
    from kinelake.streaming.sessions import sessions

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    us = lambda c: F.unix_micros(c) / F.lit(1000000.0)
    return sessions(e, "12 hours", "1 day").select("source", us(F.col("s")).alias("s"), us(F.col("e")).alias("e"), "n", r6(F.col("total"), "total"))


@query("""SELECT user_id AS source, epoch_us(time_bucket(INTERVAL 1 DAY, ts) - k * INTERVAL 1 DAY)::BIGINT / 1000000.0::DOUBLE AS s, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of three days that start every day."""
    from kinelake.streaming.sessions import windowed

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("ts"))
    return windowed(e, "3 days", "1 day", "1 day").select("source", (F.unix_micros("s") / F.lit(1000000.0)).alias("s"), "n")
