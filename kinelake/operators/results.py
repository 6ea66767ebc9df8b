"""Lists of results: filters, pages and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filtered(rows: DataFrame, source: str | None = None, facet: str | None = None, least: float | None = None, most: float | None = None, review: str | None = None) -> DataFrame:
    """rows that meet every condition given; a facet meets a compound class that holds it."""
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if facet is not None:
        rows = rows.where(F.array_contains(F.split("class", r"\+"), facet))
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    if most is not None:
        rows = rows.where(F.col("score") < most)
    if review is not None:
        rows = rows.where(F.col("review") == review)
    return rows


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of 1 to 200 rows."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("a page holds 1 to 200 rows and starts at 0 or later")
    return rows.orderBy(*order).offset(offset).limit(limit)


def group_counts(rows: DataFrame, key: str, strong: float, possible: float) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= strong).alias("strong"), F.count_if((F.col("score") >= possible) & (F.col("score") < strong)).alias("possible"), F.countDistinct("source").alias("sources"))
