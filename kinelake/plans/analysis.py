"""Queries that vote, count, evaluate, classify and organise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import geometry, text
from kinelake.operators import classes, evidence, selection
from kinelake.plans.base import DAY, query, r6, table, timeline


@query("""
    WITH {timeline}, l AS (SELECT source, CASE WHEN kind = 'error' THEN NULL WHEN kind IN ('click', 'view') THEN 'look' ELSE kind END AS label FROM timeline),
    n AS (SELECT source, label, count(*) AS votes FROM l GROUP BY 1, 2), t AS (SELECT *, sum(votes) OVER (PARTITION BY source) AS total, sum(CASE WHEN label IS NOT NULL THEN votes END) OVER (PARTITION BY source) AS known FROM n)
    SELECT source, label, votes, total::BIGINT AS total FROM t WHERE label IS NOT NULL AND votes >= 0.45 * known AND known >= 0.7 * total""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("kind") == "error", F.lit(None)).when(F.col("kind").isin("click", "view"), "look").otherwise(F.col("kind"))
    return evidence.majority(timeline(spark, sf_dir).select("source", label.alias("label")), "source", "label", 0.45, 0.7)


_COMPOUND = "c AS (SELECT kind || '+' || lead(kind) OVER (PARTITION BY source ORDER BY t, event_id) AS class, kind FROM timeline)"


def _compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    nxt = F.lead("kind").over(Window.partitionBy("source").orderBy("t", "event_id"))
    return timeline(spark, sf_dir).select(F.when(nxt.isNotNull(), F.concat_ws("+", "kind", nxt)).alias("class"), "kind")


@query("WITH {timeline}, " + _COMPOUND + """, e AS (SELECT unnest(list_distinct(list_concat([class], string_split(class, '+')))) AS class FROM c WHERE class IS NOT NULL) SELECT class, count(*) AS n FROM e GROUP BY class""")
def class_facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.class_counts(_compound(spark, sf_dir), "class")


@query("WITH {timeline}, " + _COMPOUND + """ SELECT array_to_string(list_sort(list_distinct(string_split(class, '+'))), '+') AS class_key, count(*) AS n,
    count(*) FILTER (WHERE len(list_intersect(list_distinct(string_split(class, '+')), ['click', 'purchase'])) > 0) AS shared FROM c WHERE class IS NOT NULL GROUP BY 1""")
def facet_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free keys of compound classes, and how many share a facet with a given one."""
    x = _compound(spark, sf_dir).where("class IS NOT NULL")
    shared = F.size(F.array_intersect(F.array_distinct(F.split("class", r"\+")), F.array(F.lit("click"), F.lit("purchase")))) > 0
    return x.groupBy(text.class_key(F.col("class")).alias("class_key")).agg(F.count("*").alias("n"), F.count_if(shared).alias("shared"))


_TRUTH = "x AS (SELECT kind AS t, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'view' ELSE kind END AS g FROM timeline)"


@query("WITH {timeline}, " + _TRUTH + """, k AS (SELECT DISTINCT t AS class FROM x UNION SELECT DISTINCT g FROM x WHERE g IS NOT NULL),
    m AS (SELECT class, count(*) FILTER (WHERE t = class AND g = class) AS tp, count(*) FILTER (WHERE t <> class AND g = class) AS fp, count(*) FILTER (WHERE t = class AND g IS DISTINCT FROM class) AS fn FROM k, x GROUP BY class),
    p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM m)
    SELECT class, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM p""")
def confusion_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, "view").otherwise(F.col("kind"))
    m = evidence.classification_metrics(timeline(spark, sf_dir), F.col("kind"), guess)
    return m.select("class", "tp", "fp", "fn", *[r6(F.col(c), c) for c in ("precision", "recall", "f1")])


@query("WITH {timeline}, " + _TRUTH + """, k AS (SELECT DISTINCT t AS class FROM x), m AS (SELECT class, count(*) FILTER (WHERE t = class AND g = class) AS tp, count(*) FILTER (WHERE t <> class AND g = class) AS fp, count(*) FILTER (WHERE t = class AND g IS DISTINCT FROM class) AS fn FROM k, x GROUP BY class),
    p AS (SELECT coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM m) SELECT count(*) AS classes, round(avg(f1), 6) AS macro_f1, round((SELECT count(*) FILTER (WHERE g IS NULL) / count(*) FROM x), 6) AS unclassified FROM p""")
def classification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 5 == 0, "view").otherwise(F.col("kind"))
    x = timeline(spark, sf_dir)
    m = evidence.macro_metrics(evidence.classification_metrics(x, F.col("kind"), guess), x, guess)
    return m.select("classes", r6(F.col("macro_f1"), "macro_f1"), r6(F.col("unclassified"), "unclassified"))


@query("""WITH x AS (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b FROM part), m AS (SELECT *, greatest(r, g, b)::DOUBLE AS hi, greatest(r, g, b)::DOUBLE - least(r, g, b) AS d FROM x)
    SELECT p_partkey, round(CASE WHEN d = 0 THEN 0 WHEN hi = r THEN ((g - b) / d) - 6 * floor(((g - b) / d) / 6) WHEN hi = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6, 6) + 0.0 AS h, round(CASE WHEN hi = 0 THEN 0 ELSE d / hi * 255 END, 6) AS s, hi AS v FROM m""")
def hsv_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x = table(spark, sf_dir, "part").select("p_partkey", geometry.hsv(k * 7 % 256, k * 13 % 256, k * 29 % 256).alias("c"))
    return x.select("p_partkey", r6(F.col("c.h"), "h"), r6(F.col("c.s"), "s"), F.col("c.v").alias("v"))


@query("""WITH i AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS s, l_quantity + l_discount * 20 AS e, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity - 2 END AS ss, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity + l_tax * 300 END AS se FROM lineitem),
    k AS (SELECT *, ss IS NOT NULL AND se IS NOT NULL AND se > ss AS known, greatest(0.0, s - 1.25) AS lo FROM i)
    SELECT id, round(CASE WHEN known AND se - ss <= 12 THEN ss WHEN known THEN greatest(lo, ss) ELSE lo END, 6) + 0.0 AS start, round(CASE WHEN known AND se - ss <= 12 THEN se WHEN known THEN least(e + 1.25, se) ELSE e + 1.25 END, 6) + 0.0 AS "end" FROM k""")
def clip_range_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    known = c("l_linenumber") % 3 != 0
    r = geometry.clip_range(c("l_quantity"), c("l_quantity") + c("l_discount") * 20, F.when(known, c("l_quantity") - 2), F.when(known, c("l_quantity") + c("l_tax") * 300))
    x = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), r.alias("r"))
    return x.select("id", r6(c("r.start"), "start"), r6(c("r.end"), "end"))


@query("""WITH s AS (SELECT doc_id, n_chars AS size, source, doc_id % 3 AS tier, doc_id % 10 = 0 AS keep FROM documents), b AS (SELECT *, sum(size) OVER (ORDER BY tier, keep, source, size DESC, doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM s)
    SELECT doc_id, size FROM b WHERE total - before > 1000000""")
def evict_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache with a byte budget evicts: lower tiers first, protected ones last, then older, larger, path."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size"), "source", (F.col("doc_id") % 3).alias("tier"), (F.col("doc_id") % 10 == 0).alias("keep"))
    return selection.evict(s, 1_000_000, [F.asc("tier"), F.asc("keep"), F.asc("source"), F.desc("size"), F.asc("doc_id")]).select("doc_id", "size")


@query("""WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_discount * 10 AS walk, l_tax * 12 AS run, l_quantity / 50 AS sit, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_quantity / 60 END AS stand FROM lineitem)
    SELECT CASE WHEN run >= 0.5 AND run - walk >= 0.1 THEN 'running' WHEN walk >= 0.5 AND walk - run >= 0.1 THEN 'walking' WHEN sit >= 0.6 AND sit - stand >= 0.1 THEN 'seated' WHEN stand >= 0.6 AND stand - sit >= 0.1 THEN 'standing' ELSE 'unknown' END AS label, count(*) AS n FROM s GROUP BY 1""")
def measured_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from action scores that lead their rivals by a margin; missing scores prove nothing."""
    c = F.col
    s = table(spark, sf_dir, "lineitem").select(classes.measured(c("l_discount") * 10, c("l_tax") * 12, c("l_quantity") / 50, F.when(c("l_linenumber") != 4, c("l_quantity") / 60)).alias("label"))
    return s.select(F.coalesce("label", F.lit("unknown")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH {timeline}, w AS (SELECT source, floor(t / 604800)::BIGINT AS wk, min_by(v, (t, event_id)) AS a, max_by(v, (t, event_id)) AS b, count(*) AS n FROM timeline GROUP BY 1, 2)
    SELECT source, wk, CASE WHEN n < 3 THEN 'unknown' WHEN abs(b - a) < 8 THEN 'static' WHEN b > a THEN 'right' ELSE 'left' END AS direction, round(least(1.0, abs(b - a) / 40), 6) AS confidence FROM w""")
def movement_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = timeline(spark, sf_dir).groupBy("source", F.floor(F.col("t") / (7 * DAY)).alias("wk")).agg(F.min_by("v", F.struct("t", "event_id")).alias("a"), F.max_by("v", F.struct("t", "event_id")).alias("b"), F.count("*").alias("n"))
    return w.select("source", "wk", classes.direction(F.col("a"), F.col("b"), F.col("n"), 8.0).alias("direction"), r6(F.least(F.lit(1.0), F.abs(F.col("b") - F.col("a")) / 40), "confidence"))


@query("""WITH {timeline}, s AS (SELECT source, count(*) AS frames, count(DISTINCT kind) AS kinds, max(t) - min(t) AS duration FROM timeline GROUP BY source)
    SELECT count(*) AS sources, sum(frames)::BIGINT AS frames, max(kinds) AS kinds, round(sum(duration), 3) AS duration FROM s""")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timeline(spark, sf_dir).groupBy("source").agg(F.count("*").alias("frames"), F.countDistinct("kind").alias("kinds"), (F.max("t") - F.min("t")).alias("duration"))
    return s.agg(F.count("*").alias("sources"), F.sum("frames").alias("frames"), F.max("kinds").alias("kinds"), F.round(F.sum("duration"), 3).alias("duration"))


@query("SELECT o_orderkey, sha256('=' || o_orderkey || chr(10) || '=' || o_custkey || chr(10) || '=' || o_orderstatus || chr(10) || '-') AS fingerprint, o_custkey || '|' || o_orderkey || '|3|true|1500000|' || (o_orderkey % 100 * 1000000) AS range_key FROM orders")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    f = text.fingerprint(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.lit(None))
    return o.select("o_orderkey", f.alias("fingerprint"), text.range_key(F.col("o_custkey"), F.col("o_orderkey"), F.lit(3), F.lit(True), F.lit(1.5), (F.col("o_orderkey") % 100).cast("double")).alias("range_key"))
