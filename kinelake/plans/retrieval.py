"""Queries on identity vectors: similarity joins, candidates, clusters, gates and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import geometry, scores
from kinelake.functions import vectors as V
from kinelake.operators import evidence, graph, similarity
from kinelake.plans.base import query, r6, vectors

_V = "v AS (SELECT vec_id AS id, label AS shot, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_COS = "greatest(-1.0, least(1.0, list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e))))"
_RMS = "exp(-sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(a.e)))"
_ALL = f"WITH {_V}, s AS (SELECT a.id AS i, b.id AS j, a.shot AS si, b.shot AS sj, {_COS} AS score FROM v a JOIN v b ON a.id < b.id)"


@query(f"""{_ALL},
    d AS (SELECT i, j, sj, score FROM s WHERE si <> sj AND score >= 0.25 UNION ALL SELECT j, i, si, score FROM s WHERE si <> sj AND score >= 0.25),
    c AS (SELECT *, row_number() OVER (PARTITION BY i, sj ORDER BY round(score, 9) DESC, j) AS n FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(score, 9) DESC, j) AS m FROM c WHERE n <= 4)
    SELECT least(i, j) AS left_id, greatest(i, j) AS right_id, round(max(score), 6) AS score FROM k WHERE m <= 24 GROUP BY 1, 2""")
def similar_pairs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: nearest windows of other shots, capped per shot and in all, each pair once."""
    return similarity.capped_neighbours(vectors(spark, sf_dir), per_shot=4, k=24, least=0.25).select("left_id", "right_id", r6(F.col("score"), "score"))


@query(f"{_ALL} SELECT i, j, round(score, 6) AS score FROM s WHERE score >= 0.35")
def cosine_pairs_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.pairs_above(vectors(spark, sf_dir), 0.35).select("i", "j", r6(F.col("score"), "score"))


@query(f"WITH {_V}, s AS (SELECT a.id AS i, b.id AS j, {_RMS} AS score FROM v a JOIN v b ON a.id < b.id) SELECT i, j, round(score, 6) AS score FROM s WHERE score >= 0.865")
def rms_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.pairs_above(vectors(spark, sf_dir), 0.865, "rms").select("i", "j", r6(F.col("score"), "score"))


@query(f"WITH {_V}, s AS (SELECT a.id AS i, b.id AS j, {_COS} >= 0.36 AS by_identity, {_RMS} >= 0.867 AS by_pose FROM v a JOIN v b ON a.id < b.id) SELECT * FROM s WHERE by_identity OR by_pose")
def identity_union_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.channels(vectors(spark, sf_dir), 0.36, 0.867)


@query("SELECT embedding[1]::DOUBLE AS first_value, min(vec_id) AS prototype, count(*) AS members FROM embeddings GROUP BY embedding, embedding[1]")
def exact_vector_intern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal vectors share one prototype."""
    return vectors(spark, sf_dir).groupBy("v").agg(F.min("id").alias("prototype"), F.count("*").alias("members")).select(F.col("v")[0].cast("double").alias("first_value"), "prototype", "members")


_CENTRE = f"""WITH {_V}, x AS (SELECT shot, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v), m AS (SELECT shot, i, avg(x) AS m, count(*) AS n FROM x GROUP BY 1, 2),
    l AS (SELECT shot, max(n) AS n, sqrt(sum(m * m)) AS len FROM m GROUP BY shot), c AS (SELECT m.shot, list(m.m / len ORDER BY i) AS c FROM m JOIN l USING (shot) GROUP BY m.shot)"""


@query(_CENTRE + " SELECT shot, n, round(least(1.0, n / 3.0), 6) AS evidence, round(c[1], 6) + 0.0 AS c1, round(c[2], 6) + 0.0 AS c2, round(list_sum(c), 6) + 0.0 AS total FROM c JOIN l USING (shot)")
def vector_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evidence.centroids(vectors(spark, sf_dir), "shot", "v")
    return c.select("shot", "n", r6(F.col("evidence"), "evidence"), r6(F.col("centroid")[0], "c1"), r6(F.col("centroid")[1], "c2"), r6(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), "total"))


@query(_CENTRE + """, s AS (SELECT v.id, c.shot AS candidate, list_inner_product(v.e, c.c) / sqrt(list_inner_product(v.e, v.e)) AS score FROM v, c),
    r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY id ORDER BY score DESC, candidate))
    SELECT id, candidate, round(score, 6) AS score, round(second, 6) + 0.0 AS second FROM r WHERE n = 1 AND score >= 0.35 AND score - second >= 0.12""")
def suggest_best_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's best centroid where it leads clearly. Centroids are a row a label: a small side, still an equi-join on one bucket for Spark to broadcast or not."""
    v = vectors(spark, sf_dir).select("id", "v", F.lit(1).alias("one"))
    c = evidence.centroids(vectors(spark, sf_dir), "shot", "v").select(F.col("shot").alias("candidate"), "centroid", F.lit(1).alias("one"))
    s = v.join(c, "one").select("id", "candidate", V.cosine(F.col("v"), F.col("centroid")).alias("score"))
    return graph.best_with_margin(s, "id", 0.35, 0.12).select("id", "candidate", r6(F.col("score"), "score"), r6(F.col("second"), "second"))


@query(f"""WITH RECURSIVE {_V}, s AS (SELECT a.id AS i, b.id AS j FROM v a JOIN v b ON a.id < b.id AND {_COS} >= 0.4), e AS (SELECT i, j FROM s UNION SELECT j, i FROM s),
    r AS (SELECT id, id AS m FROM v UNION SELECT e.j, r.m FROM r JOIN e ON e.i = r.id) SELECT id, min(m) AS component FROM r GROUP BY id""")
def connected_components_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return graph.components(v.select("id"), similarity.pairs_above(v, 0.4).select(F.col("i").alias("a"), F.col("j").alias("b")))


@query(f"{_ALL}, l AS (SELECT i, j, score FROM s WHERE score >= 0.42), n AS (SELECT x, count(*) AS c FROM (SELECT i AS x FROM l UNION ALL SELECT j FROM l) GROUP BY x) SELECT i AS a, j AS b FROM l JOIN n p ON p.x = i AND p.c = 1 JOIN n q ON q.x = j AND q.c = 1")
def degree_one_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_one(similarity.pairs_above(vectors(spark, sf_dir), 0.42).select(F.col("i").alias("a"), F.col("j").alias("b")))


@query()
def complete_link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity clusters within each label, by complete links."""
    return graph.complete_links_of_vectors(vectors(spark, sf_dir), "shot", link=0.2, conflict=0.0)


_GATED = f"""{_ALL}, g AS (SELECT i, j, score, CASE WHEN si = sj AND abs(i - j) <= 3 THEN 'source_overlap' WHEN si = sj THEN 'same_shot' WHEN abs(i - j) <= 20 AND score >= 0.3 THEN 'nearby_context'
    WHEN score < 0.2 THEN 'identity' WHEN abs(i - j) < 60 THEN 'source_gap' WHEN score < 0.25 THEN 'temporal_support' WHEN (i + j) % 5 = 0 THEN 'body_visibility' WHEN score < 0.3 THEN 'direction' END AS rejection FROM s)"""


@query(_GATED + " SELECT coalesce(rejection, 'none') AS rejection, count(*) AS n, round(max(score), 6) AS best FROM g GROUP BY 1")
def rejection_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered gates: the first that fails is the pair's rejection."""
    from kinelake.operators import gates

    v = vectors(spark, sf_dir).select("id", "shot")
    s = similarity.pairs_above(vectors(spark, sf_dir), -1.0).join(v.select(F.col("id").alias("i"), F.col("shot").alias("si")), "i").join(v.select(F.col("id").alias("j"), F.col("shot").alias("sj")), "j")
    c, far = F.col, F.abs(F.col("i") - F.col("j"))
    g = gates.first_failure(
        ("source_overlap", (c("si") == c("sj")) & (far <= 3)), ("same_shot", c("si") == c("sj")), ("nearby_context", (far <= 20) & (c("score") >= 0.3)), ("identity", c("score") < 0.2),
        ("source_gap", far < 60), ("temporal_support", c("score") < 0.25), ("body_visibility", (c("i") + c("j")) % 5 == 0), ("direction", c("score") < 0.3),
    )
    return s.select(F.coalesce(g, F.lit("none")).alias("rejection"), "score").groupBy("rejection").agg(F.count("*").alias("n"), r6(F.max("score"), "best"))


@query(f"""{_ALL}, f AS (SELECT i, j, score, CASE WHEN i % 11 = 0 THEN NULL ELSE i % 40 END AS a, j % 40 AS b FROM s WHERE score >= 0.3),
    r AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY round(score, 9) DESC, i, j) AS n FROM f WHERE a IS NULL OR a <> b)
    SELECT i, j, round(score, 6) AS score FROM r WHERE a IS NULL OR n = 1""")
def family_pair_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pair of each unordered pair of families; a pair within one family goes; an unknown family does not dedupe."""
    from kinelake.operators import selection

    s = similarity.pairs_above(vectors(spark, sf_dir), 0.3).select("i", "j", "score", F.when(F.col("i") % 11 != 0, F.col("i") % 40).alias("fa"), (F.col("j") % 40).alias("fb"))
    return selection.family_pairs(s, "fa", "fb", [F.desc(F.round("score", 9)), F.asc("i"), F.asc("j")]).select("i", "j", r6(F.col("score"), "score"))


@query(f"""{_ALL}, p AS (SELECT i, j, score, (j - i) % 7 / 4.0 AS d, (i % 10) / 10.0 AS c, i % 3 = 0 AS same FROM s WHERE score >= 0.3)
    SELECT i, j, round(score * (0.75 + 0.25 * least(d, 1.0)) * (0.8 + 0.2 * c), 6) AS rank_score, round(score * (0.55 + 0.45 * c) * CASE WHEN same THEN 1.0 ELSE 0.85 END, 6) AS organization,
      round(greatest(0.0, least(1.0, 0.55 * c + 0.20 * score + 0.15 * c + 0.10 * score - 0.15 * d)), 6) + 0.0 AS quality FROM p""")
def rank_and_organization_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = similarity.pairs_above(vectors(spark, sf_dir), 0.3)
    c, d, s = (F.col("i") % 10) / 10.0, (F.col("j") - F.col("i")) % 7 / 4.0, F.col("score")
    return p.select("i", "j", r6(scores.rank_score(s, d, c), "rank_score"), r6(scores.organization_score(s, c, F.col("i") % 3 == 0), "organization"), r6(scores.representative_quality(c, s, c, s, d), "quality"))


@query(f"""{_ALL}, t AS (SELECT i AS q, j AS item, score FROM s UNION ALL SELECT j, i, score FROM s), r AS (SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, item) AS rank FROM t),
    p AS (SELECT a.id AS q, b.id AS item FROM v a JOIN v b ON a.shot = b.shot AND a.id <> b.id), n AS (SELECT q, count(*) AS n FROM p GROUP BY q),
    h AS (SELECT q, min(rank) AS first_rank, count(*) FILTER (WHERE rank <= 1) AS h1, count(*) FILTER (WHERE rank <= 3) AS h3, count(*) FILTER (WHERE rank <= 10) AS h10 FROM r JOIN p USING (q, item) WHERE rank <= 10 GROUP BY q)
    SELECT n.q AS query_id, round(coalesce(h1, 0) / n, 6) AS recall_1, round(coalesce(h3, 0) / n, 6) AS recall_3, round(coalesce(h10, 0) / n, 6) AS recall_10, round(coalesce(1 / first_rank, 0), 6) AS reciprocal_rank FROM n LEFT JOIN h USING (q)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    m = evidence.group_retrieval_metrics(similarity.nearest(v, 10), v.select("id", F.col("shot").alias("group")), (1, 3, 10))
    return m.select("query_id", *[r6(F.col(c), c) for c in ("recall_1", "recall_3", "recall_10", "reciprocal_rank")])


@query(f"""{_ALL}, b AS (SELECT i AS query_id, j AS item, score FROM s UNION ALL SELECT j, i, score FROM s), t AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM b),
    k AS (SELECT query_id, CASE WHEN (query_id + item) % 3 = 0 THEN NULL ELSE (query_id * item) % 2 = 0 END AS good FROM t WHERE rank <= 10)
    SELECT query_id, round(count(*) FILTER (WHERE good) / count(*), 6) AS low, round(count(*) FILTER (WHERE coalesce(good, true)) / count(*), 6) AS high FROM k GROUP BY query_id""")
def precision_at_10_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = similarity.nearest(vectors(spark, sf_dir), 10).select("query_id", "item", "rank")
    judged = r.where((F.col("query_id") + F.col("item")) % 3 != 0).select("query_id", "item", ((F.col("query_id") * F.col("item")) % 2 == 0).alias("good"))
    return evidence.precision_bounds(r, judged, 10).select("query_id", r6(F.col("low"), "low"), r6(F.col("high"), "high"))


@query("""SELECT vec_id, (floor((((embedding[1] * 720 + 180) - 360 * floor((embedding[1] * 720 + 180) / 360)) - 180 + 22.5) / 45) + 8)::INTEGER % 8 AS sector,
    round(abs(((embedding[1] * 720 - embedding[2] * 720 + 180) - 360 * floor((embedding[1] * 720 - embedding[2] * 720 + 180) / 360)) - 180), 4) AS apart
    FROM (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS embedding FROM embeddings)""")
def view_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("v")[i].cast("double") * 720 for i in (0, 1))
    return vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), geometry.view_sector(a).alias("sector"), F.round(geometry.angular_distance(a, b), 4).alias("apart"))


@query("""WITH b AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), c AS (SELECT id, e[1] AS x, e[2] AS y, abs(e[3]) + 0.1 AS w, abs(e[4]) + 0.1 AS h FROM b),
    p AS (SELECT a.id AS i, b.id AS j, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS m, a.w * a.h + b.w * b.h AS t,
      sqrt(pow(a.x + a.w / 2 - b.x - b.w / 2, 2) + pow(a.y + a.h / 2 - b.y - b.h / 2, 2)) AS d, sqrt(greatest(a.w * a.h, b.w * b.h)) AS size FROM c a JOIN c b ON b.id = a.id + 1)
    SELECT i, j, round(m / (t - m), 6) + 0.0 AS iou, round(exp(-2.5 * d / size), 6) + 0.0 AS centre FROM p""")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("v")[i].cast("double")
    b = vectors(spark, sf_dir).select("id", e(0).alias("x"), e(1).alias("y"), (F.abs(e(2)) + 0.1).alias("w"), (F.abs(e(3)) + 0.1).alias("h"))
    a, c = (b.select([F.col(k).alias(f"{s}{k}") for k in b.columns]) for s in "ac")
    x = a.join(c, a.aid + 1 == c.cid)
    box = [F.col(f"{s}{k}") for s in "ac" for k in "xywh"]
    return x.select(F.col("aid").alias("i"), F.col("cid").alias("j"), r6(geometry.iou(*box), "iou"), r6(geometry.centre_score(*box), "centre"))


@query("""WITH h AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: abs(x::DOUBLE)) AS h FROM embeddings), n AS (SELECT vec_id, list_transform(h, lambda x: x / list_sum(h)) AS h FROM h)
    SELECT a.vec_id AS i, round(list_sum(list_transform(list_zip(a.h, b.h), lambda z: sqrt(z[1]) * sqrt(z[2]))), 6) AS context, round((list_reverse_sort(a.h)[1] + list_reverse_sort(a.h)[2] + list_reverse_sort(a.h)[3]) / 3, 6) AS active
    FROM n a JOIN n b ON b.vec_id = a.vec_id + 1""")
def context_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bhattacharyya overlap of neighbours' colour histograms, and the mean of the most active quarter (at least three)."""
    h = F.transform(F.slice("v", 1, 8), lambda x: F.abs(x.cast("double")))
    n = vectors(spark, sf_dir).select("id", h.alias("h")).select("id", F.transform("h", lambda x: x / F.aggregate("h", F.lit(0.0), lambda s, y: s + y)).alias("h"))
    x = n.select(F.col("id").alias("i"), F.col("h").alias("a")).join(n.select((F.col("id") - 1).alias("i"), F.col("h").alias("b")), "i")
    return x.select("i", r6(V.bhattacharyya(F.col("a"), F.col("b")), "context"), r6(V.top_mean(F.col("a")), "active"))


@query()
def knn_lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate nearest neighbours by random projections, with recall against the exact join."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors(spark, sf_dir).select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("f"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=1.0, numHashTables=12, seed=1).fit(v)
    near = similarity.hashed_pairs(model.transform(v).select("id", vector_to_array("f").alias("v"), F.transform("h", lambda x: F.element_at(vector_to_array(x), 1)).alias("h")), 1.14)
    true = similarity.pairs_above(vectors(spark, sf_dir), 1 - 1.14**2 / 2).select("i", "j")
    return true.join(near.withColumn("hit", F.lit(1)), ["i", "j"], "left").agg(F.count("*").alias("pairs"), F.count("hit").alias("found"))
