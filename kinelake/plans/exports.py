"""Queries behind result lists, edits and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import text
from kinelake.functions.timecode import frame_duration, timecode
from kinelake.operators import edits, results, selection
from kinelake.plans.base import query, r6, table
from kinelake.sources import formats

#: Results: order lines as matches of two sources.
_R = "r AS (SELECT l_orderkey * 8 + l_linenumber AS id, 'src' || l_suppkey % 20 AS source, l_quantity AS start, l_quantity + l_extendedprice / 10000 AS \"end\", l_discount * 10 AS score, l_returnflag || '+' || l_linestatus AS class, CASE WHEN l_tax < 0.02 THEN NULL ELSE l_tax END AS yaw, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) = 1)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result for each order line; where lines repeat a number, the least."""
    c = F.col
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*rest)).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    return line.select(
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), F.concat(F.lit("src"), c("l_suppkey") % 20).alias("source"), c("l_quantity").alias("start"), (c("l_quantity") + c("l_extendedprice") / 10000).alias("end"),
        (c("l_discount") * 10).alias("score"), F.concat_ws("+", "l_returnflag", "l_linestatus").alias("class"), F.when(c("l_tax") >= 0.02, c("l_tax")).alias("yaw"), "l_linenumber",
    )


@query(f"WITH {_R} SELECT id, source, class, round(score, 6) AS score FROM r WHERE score >= 0.5 AND source = 'src3' AND list_contains(string_split(class, '+'), 'R') ORDER BY round(score, 6) DESC, id LIMIT 50 OFFSET 100")
def results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, sort and one page of results."""
    x = results.filtered(rows(spark, sf_dir), source="src3", facet="R", least=0.5)
    return results.page(x.withColumn("score", F.round("score", 6)), [F.desc("score"), F.asc("id")], 100, 50).select("id", "source", "class", r6(F.col("score"), "score"))


@query(f"WITH {_R}, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY yaw NULLS LAST, round(score, 6) DESC, id)::INTEGER AS place FROM r) SELECT source, place, id, yaw FROM o WHERE place <= 40")
def sort_unknown_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.asc_nulls_last("yaw"), F.desc(F.round("score", 6)), "id")
    return rows(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 40").select("source", "place", "id", "yaw")


@query(f"""WITH {_R}, p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, id) AS place, l_linenumber = 2 AS s FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY source, s ORDER BY place) AS slot, row_number() OVER (PARTITION BY source, s ORDER BY CASE WHEN s THEN -start ELSE place END, place) AS want FROM p)
    SELECT a.id, a.place::INTEGER AS place, b.place::INTEGER AS new_place FROM k a JOIN k b ON a.source = b.source AND a.s = b.s AND a.want = b.slot""")
def slot_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head results reordered by extent within the places they hold."""
    x = rows(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.round("score", 6)), "id")))
    special = F.col("l_linenumber") == 2
    return selection.slot_reranked(x, ["source"], "place", special, [F.when(special, -F.col("start")).otherwise(F.col("place")), F.col("place")]).select("id", "place", "new_place")


@query(f"WITH {_R} SELECT id, id || ',' || source || ',\"' || class || ',x\"\"y\"\"\"' AS line, '{{\"id\":' || id || ',\"source\":\"' || source || '\",\"class\":\"' || class || '\"}}' AS json FROM r")
def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rows(spark, sf_dir).withColumn("note", F.concat("class", F.lit(',x"y"')))
    return x.select("id", formats.csv_lines(x, ["id", "source", "note"]).alias("line"), formats.json_lines(["id", "source", "class"], {"source", "class"}).alias("json"))


@query(f"""WITH {_R}, c AS (SELECT id, source, coalesce(sum("end" - start + 0.25) OVER (PARTITION BY source ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS x FROM r) SELECT id, round(x, 6) + 0.0 AS cursor FROM c""")
def cut_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.cut_plan(rows(spark, sf_dir), ["source"], [F.asc("id")]).select("id", r6(F.col("at"), "cursor"))


@query(f"""WITH {_R}, n AS (SELECT id, floor(start * 1000 * 24 + 0.5)::BIGINT AS a, floor(start * 1000 * 29.97 + 0.5)::BIGINT AS d FROM r), q AS (SELECT *, d // 17982 AS tens, d % 17982 AS rest FROM n),
    f AS (SELECT id, a, d + tens * 18 + CASE WHEN rest >= 2 THEN (rest - 2) // 1798 * 2 ELSE 0 END AS d FROM q)
    SELECT id, format('{{:02d}}:{{:02d}}:{{:02d}}:{{:02d}}', a // 86400, a // 1440 % 60, a // 24 % 60, a % 24) AS plain, format('{{:02d}}:{{:02d}}:{{:02d}}:{{:02d}}', d // 108000, d // 1800 % 60, d // 30 % 60, d % 30) AS dropped FROM f""")
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timecodes at 24 frames and with drop-frame at 29.97."""
    s = F.col("start") * 1000
    return rows(spark, sf_dir).select("id", timecode(s, 24.0, False).alias("plain"), timecode(s, 29.97, True).alias("dropped"))


@query("""WITH f AS (SELECT p_partkey, (CASE p_partkey % 6 WHEN 0 THEN 23.976 WHEN 1 THEN 25.0 WHEN 2 THEN 29.97 WHEN 3 THEN 59.94 WHEN 4 THEN 12.3456789 ELSE CASE WHEN p_partkey % 4 = 1 THEN -1 ELSE 48.0 END END)::DOUBLE AS fps FROM part)
    SELECT p_partkey, CASE WHEN fps = 23.976 THEN '1001/24000s' WHEN fps = 29.97 THEN '1001/30000s' WHEN fps = 59.94 THEN '1001/60000s' WHEN fps <= 0 THEN '1/1s' ELSE (1000000 // gcd(round(fps * 1000000)::BIGINT, 1000000)) || '/' || (round(fps * 1000000)::BIGINT // gcd(round(fps * 1000000)::BIGINT, 1000000)) || 's' END AS duration FROM f""")
def frame_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    fps = F.when(k == 0, 23.976).when(k == 1, 25.0).when(k == 2, 29.97).when(k == 3, 59.94).when(k == 4, 12.3456789).otherwise(F.when(F.col("p_partkey") % 4 == 1, -1.0).otherwise(48.0))
    return table(spark, sf_dir, "part").select("p_partkey", frame_duration(fps).alias("duration"))


@query("SELECT p_partkey, substr(regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 48) || '_' || substr(sha256(p_name || ' / ' || p_type), 1, 8) AS file FROM part")
def export_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.file_name(F.concat_ws(" / ", "p_name", "p_type")).alias("file"))


_E = """e AS (SELECT event_id AS seq, user_id * 8 + 1 AS id, CASE event_type WHEN 'click' THEN 'review' WHEN 'view' THEN 'class' WHEN 'purchase' THEN 'start' ELSE 'undo' END AS action, value FROM events WHERE event_id < 4000),
    u AS (SELECT *, count(*) FILTER (WHERE action = 'undo') OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS undone FROM e),
    l AS (SELECT id, action, max_by(value, seq) AS value FROM u WHERE action <> 'undo' AND undone = 0 GROUP BY 1, 2)"""


@query(f"WITH {_R}, {_E} SELECT r.id, round(coalesce(s.value, r.start), 6) AS start, CASE WHEN v.value > 50 THEN 'favorite' WHEN v.value IS NOT NULL THEN 'hidden' ELSE 'unreviewed' END AS review FROM r LEFT JOIN l s ON s.id = r.id AND s.action = 'start' LEFT JOIN l v ON v.id = r.id AND v.action = 'review' WHERE r.l_linenumber = 1")
def edits_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results under a log of edits, of which an undo takes back the one before it."""
    k = F.col("event_type")
    log = table(spark, sf_dir, "events").where("event_id < 4000").select(F.col("event_id").alias("seq"), (F.col("user_id") * 8 + 1).alias("id"), F.when(k == "click", "review").when(k == "view", "class").when(k == "purchase", "start").otherwise("undo").alias("action"), "value")
    x = edits.overlaid(rows(spark, sf_dir).where("l_linenumber = 1"), edits.in_force(log), ["start", "review"])
    review = F.when(F.col("edit_review") > 50, "favorite").when(F.col("edit_review").isNotNull(), "hidden").otherwise("unreviewed")
    return x.select("id", r6(F.coalesce("edit_start", "start"), "start"), review.alias("review"))


@query(f"WITH {_R} SELECT class, count(*) AS n, count(*) FILTER (WHERE score >= 0.8) AS strong, count(*) FILTER (WHERE score >= 0.4 AND score < 0.8) AS possible, count(DISTINCT source) AS sources FROM r GROUP BY class")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.group_counts(rows(spark, sf_dir), "class", 0.8, 0.4)
