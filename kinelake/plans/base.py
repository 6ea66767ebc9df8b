"""What registered queries share: the register, the tables, and the SQL of their views.

The driver's tables stand in for the engine's: events are timelines (source = user), order lines are intervals (source = customer, from order to
shipment), embeddings are identity vectors (shot = label).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

DAY = 86400.0
TIMELINE_SQL = "timeline AS (SELECT user_id AS source, epoch_us(ts) / 1000000.0::DOUBLE AS t, event_type AS kind, value AS v, event_id FROM events)"
INTERVALS_SQL = "intervals AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, o_custkey AS source, epoch_us(o_orderdate) / 1000000.0::DOUBLE AS s, epoch_us(l_shipdate) / 1000000.0::DOUBLE AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{timeline}", TIMELINE_SQL).replace("{intervals}", INTERVALS_SQL)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1000000.0)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), seconds("ts").alias("t"), F.col("event_type").alias("kind"), F.col("value").alias("v"), "event_id")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("source"), seconds("o_orderdate").alias("s"))
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), seconds("l_shipdate").alias("e"))
    return i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("e > s").select("id", "source", "s", "e").distinct()


def r6(c, name: str):
    """Rounded to 6 decimals, without negative zero."""
    return (F.round(c, 6) + 0.0).alias(name)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("shot"), F.col("embedding").alias("v"))
