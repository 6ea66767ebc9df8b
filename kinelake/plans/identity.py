"""Queries about identity: consensus, ownership, consistency, context ranges, families and leftovers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import vectors as V
from kinelake.operators import evidence, identity, similarity
from kinelake.plans.base import DAY, intervals, query, r6, table, timeline, vectors
from kinelake.plans.retrieval import _ALL, _CENTRE


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, min(l_quantity) AS d FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS n, lead(d) OVER w AS nx FROM l WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY d, l_suppkey))
    SELECT l_orderkey, l_linenumber, l_suppkey FROM r WHERE n = 1 AND (nx IS NULL OR nx - d >= 8)""")
def unique_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items claimed by several owners go to the clear best, or to none."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.min("l_quantity").alias("d"))
    return identity.owned(x, ["l_orderkey", "l_linenumber"], "l_suppkey", "d", 8.0).drop("d")


@query(f"""{_ALL}, p AS (SELECT si AS a, sj AS b, i AS l, j AS r, score FROM s WHERE si < sj),
    l AS (SELECT a, b, count(*) AS n, count(*) FILTER (WHERE ok) AS g, bool_or(bad) AS bad, sum(mid) FILTER (WHERE ok) AS t FROM (SELECT a, b, l, median(score) AS mid, max(score) <= 0.1 AND count(*) >= 3 AS bad,
        count(*) >= 3 AND count(*) FILTER (WHERE score >= 0.05) >= greatest(2, 0.25 * count(*) - 1e-9) AS ok FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2),
    r AS (SELECT a, b, count(*) AS m, count(*) FILTER (WHERE ok) AS h, bool_or(bad) AS bad2, sum(mid) FILTER (WHERE ok) AS t2 FROM (SELECT a, b, r, median(score) AS mid, max(score) <= 0.1 AND count(*) >= 3 AS bad,
        count(*) >= 3 AND count(*) FILTER (WHERE score >= 0.05) >= greatest(2, 0.25 * count(*) - 1e-9) AS ok FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2),
    d AS (SELECT *, CASE WHEN n >= 3 AND m >= 3 AND (bad OR bad2) THEN 'different' WHEN least(g, h) >= 3 AND g >= 0.25 * n AND h >= 0.25 * m THEN 'same' ELSE 'unknown' END AS verdict FROM l JOIN r USING (a, b))
    SELECT a, b, verdict, round(CASE WHEN verdict = 'same' THEN (t + t2) / (g + h) END, 6) + 0.0 AS score FROM d""")
def face_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two groups of face samples are one person, by support in both directions."""
    left, right = similarity.support(vectors(spark, sf_dir), 0.05)
    return identity.verdicts(left, right, ["a", "b"], 0.1, 0.25).select("a", "b", "verdict", r6(F.col("score"), "score"))


@query("""WITH {timeline}, s AS (SELECT source, floor(t / 604800)::BIGINT AS wk, floor(t / 3600)::BIGINT * 3600.0 AS t, round(v) AS yaw FROM timeline), c AS (SELECT source, wk, t, min(yaw) AS lo, max(yaw) AS hi FROM s GROUP BY 1, 2, 3 HAVING min(yaw) = max(yaw)),
    g AS (SELECT source, wk, count(*) AS samples, min_by(lo, (abs(t - (wk * 604800 + 302400)), t)) AS yaw FROM c GROUP BY 1, 2) SELECT source, wk, samples, CASE WHEN samples >= 0.6 * 20 THEN yaw END AS yaw FROM g""")
def yaw_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    wk = F.floor(F.col("t") / (7 * DAY))
    s = timeline(spark, sf_dir).select("source", wk.alias("wk"), (F.floor(F.col("t") / 3600) * 3600.0).alias("t"), F.round("v").alias("yaw"))
    return identity.yaw_summary(s, ["source", "wk"], F.col("wk") * 7 * DAY, (F.col("wk") + 1) * 7 * DAY, 0.6, 20)


@query("""WITH {timeline}, x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM timeline)
    SELECT source, event_id FROM x WHERE n <= 5 OR i IN (0, floor((n - 1) / 4), floor(2 * (n - 1) / 4), floor(3 * (n - 1) / 4), n - 1)""")
def representative_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.evenly_spaced(timeline(spark, sf_dir), ["source"], ["t", "event_id"], 5).select("source", "event_id")


@query("""WITH v AS (SELECT vec_id AS id, vec_id // 3 AS track, vec_id::DOUBLE AS t, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    p AS (SELECT a.track, min(greatest(-1.0, least(1.0, list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e))))) AS worst FROM v a JOIN v b ON a.track = b.track AND a.id < b.id GROUP BY 1),
    n AS (SELECT track, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 3 AND max(t) - min(t) >= 2)
    SELECT track, n, round(worst, 6) + 0.0 AS worst FROM n JOIN p USING (track) WHERE worst >= -0.1""")
def consistent_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vectors(spark, sf_dir).select(F.floor(F.col("id") / 3).alias("track"), "id", F.col("id").cast("double").alias("t"), "v")
    return identity.consistent(s, "track", 3, 2.0, -0.1).select("track", "n", r6(F.col("worst"), "worst"))


@query("""WITH {timeline}, s AS (SELECT kind, source % 5 AS grp, event_id AS id, floor(t / 600)::BIGINT AS frame, v AS x FROM timeline)
    SELECT a.kind, count(DISTINCT a.frame) AS times FROM s a JOIN s b ON a.kind = b.kind AND a.frame = b.frame AND a.id < b.id AND abs(a.x - b.x) > 20 GROUP BY 1""")
def identity_covisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One identity at two disjoint places in one frame."""
    s = timeline(spark, sf_dir).select("kind", F.col("event_id").alias("id"), F.floor(F.col("t") / 600).alias("frame"), F.col("v").alias("x"))
    return identity.covisions(s, "kind", ["frame"], F.abs(F.col("x") - F.col("x2")) > 20)


@query("""WITH {timeline}, w AS (SELECT DISTINCT source, floor(t / 86400)::BIGINT AS d FROM timeline), r AS (SELECT source * 100000 + d AS id, source, d * 86400.0 AS s, (d + 2) * 86400.0 AS e FROM w)
    SELECT r.id, round(coalesce(sum(v), 0), 6) + 0.0 AS total FROM r LEFT JOIN timeline t ON t.source = r.source AND t.t >= r.s AND t.t < r.e GROUP BY r.id""")
def context_range_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over time ranges from running sums."""
    t = timeline(spark, sf_dir)
    d = t.select("source", F.floor(F.col("t") / DAY).alias("d")).distinct()
    r = d.select((F.col("source") * 100000 + F.col("d")).alias("id"), "source", (F.col("d") * DAY).alias("s"), ((F.col("d") + 2) * DAY).alias("e"))
    return identity.prefix_range(t, r, "v").select("id", r6(F.col("total"), "total"))


@query("""WITH {timeline}, l AS (SELECT *, floor(t / 259200)::BIGINT AS win FROM timeline), k AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind THEN 1 ELSE 0 END AS nw FROM l WINDOW w AS (PARTITION BY source, win ORDER BY t, event_id)),
    g AS (SELECT *, sum(nw) OVER (PARTITION BY source, win ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM k), r AS (SELECT source, win, run, min(kind) AS kind, count(*) AS n FROM g GROUP BY 1, 2, 3)
    SELECT source, win, min_by(kind, run) AS was, max_by(kind, run) AS became FROM r GROUP BY 1, 2 HAVING count(*) = 2 AND min(n) >= 2""")
def single_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with exactly one change of state, confirmed twice on either side."""
    x = timeline(spark, sf_dir).withColumn("win", F.floor(F.col("t") / (3 * DAY)))
    w = Window.partitionBy("source", "win").orderBy("t", "event_id")
    x = x.withColumn("nw", F.coalesce((F.lag("kind").over(w) != F.col("kind")).cast("int"), F.lit(1))).withColumn("run", F.sum("nw").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = x.groupBy("source", "win", "run").agg(F.min("kind").alias("kind"), F.count("*").alias("n"))
    g = r.groupBy("source", "win").agg(F.count("*").alias("runs"), F.min("n").alias("least"), F.min_by("kind", "run").alias("was"), F.max_by("kind", "run").alias("became"))
    return g.where("runs = 2 AND least >= 2").select("source", "win", "was", "became")


@query(f"{_ALL}, used AS (SELECT i AS id FROM s WHERE score >= 0.4 AND si <> sj UNION SELECT j FROM s WHERE score >= 0.4 AND si <> sj) SELECT id, shot FROM v ANTI JOIN used USING (id)")
def unused_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that no accepted pair uses, for a second search."""
    v = vectors(spark, sf_dir).select("id", "shot")
    s = similarity.pairs_above(vectors(spark, sf_dir), 0.4).join(v.select(F.col("id").alias("i"), F.col("shot").alias("a")), "i").join(v.select(F.col("id").alias("j"), F.col("shot").alias("b")), "j").where("a <> b")
    used = s.select(F.col("i").alias("id")).union(s.select("j")).distinct()
    return v.join(used, "id", "left_anti")


@query(_CENTRE + """, s AS (SELECT a.shot AS i, b.shot AS j, list_inner_product(a.c, b.c) AS score FROM c a JOIN c b ON a.shot < b.shot) SELECT i, j, round(score, 6) + 0.0 AS score FROM s WHERE score >= 0.1""")
def cross_source_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose centroids agree."""
    c = evidence.centroids(vectors(spark, sf_dir), "shot", "v")
    return similarity.pairs_above(c.select(F.col("shot").alias("id"), F.col("centroid").alias("v")), 0.1).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), r6(F.col("score"), "score"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(list_sum(list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: e[(floor(i * (len(e) - 1) / 7 + 0.5))::INTEGER + 1])), 6) + 0.0 AS sampled,
    round(sqrt(list_inner_product(e, e)), 6) AS length FROM v""")
def sampled_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight evenly spaced elements of each sequence."""
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.element_at(F.col("v"), F.floor(i * (F.size("v") - 1) / 7 + 0.5).cast("int") + 1).cast("double"))
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), r6(F.aggregate(at, F.lit(0.0), lambda s, x: s + x), "sampled"), r6(F.sqrt(V.dot(F.col("v"), F.col("v"))), "length"))


@query("""WITH {intervals}, m AS (SELECT source, count(*) AS n, sum(e - s) AS shown FROM intervals GROUP BY 1), t AS (SELECT sum(shown) AS total FROM m)
    SELECT source, n, round(shown / total, 9) AS prominence, (row_number() OVER (ORDER BY shown DESC, source))::INTEGER AS place FROM m, t ORDER BY place LIMIT 20""")
def batch_group_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People by their share of all time shown: two levels of aggregation and a top-20."""
    m = intervals(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("shown"))
    top = m.orderBy(F.desc("shown"), "source").limit(20)
    total = m.agg(F.sum("shown").alias("total")).first()["total"]
    place = F.row_number().over(Window.orderBy(F.desc("shown"), "source")).cast("int")
    return top.select("source", "n", F.round(F.col("shown") / F.lit(total), 9).alias("prominence"), place.alias("place"))
