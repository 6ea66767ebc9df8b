"""Edits of results as a log that is laid over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an edit log may hold in all.
MOST_UNDO, MOST_ROWS = 16, 16_384


def in_force(log: DataFrame) -> DataFrame:
    """log (seq, id, action, value) -> (id, action, value): of each result's edits the last of each kind, without those that the next edit undoes."""
    nxt = F.lead("action").over(Window.partitionBy("id").orderBy("seq"))
    x = log.withColumn("__n", nxt).where("action <> 'undo' AND NOT (__n <=> 'undo')")
    return x.groupBy("id", "action").agg(F.max_by("value", "seq").alias("value"))


def overlaid(rows: DataFrame, edits: DataFrame, actions: list[str]) -> DataFrame:
    """rows (id, ...) with edit_<action>, the edit in force (null if none): one pivot, one join."""
    wide = edits.groupBy("id").agg(*[F.max(F.when(F.col("action") == a, F.col("value"))).alias(f"edit_{a}") for a in actions])
    return rows.join(wide, "id", "left")


def without_side(rows: DataFrame, side: str) -> DataFrame:
    """Results whose one side is removed keep the other as left and become single."""
    keep = "right" if side == "left" else "left"
    cols = [c.removeprefix("left_") for c in rows.columns if c.startswith("left_")]
    return rows.select(*[F.col(f"{keep}_{c}").alias(f"left_{c}") for c in cols], *[F.lit(None).cast(dict(rows.dtypes)[f"right_{c}"]).alias(f"right_{c}") for c in cols], *[c for c in rows.columns if not c.startswith(("left_", "right_"))])


def combined_singles(rows: DataFrame, a: int, b: int) -> DataFrame:
    """Two single results become one pair with the smaller id; others stay."""
    cols = [c.removeprefix("left_") for c in rows.columns if c.startswith("left_")]
    lo, hi = min(a, b), max(a, b)
    other = rows.where(F.col("id") == hi).select(F.lit(lo).cast("long").alias("id"), *[F.col(f"left_{c}").alias(f"__{c}") for c in cols])
    x = rows.where(F.col("id") != hi).join(other, "id", "left")
    return x.select(*[F.coalesce(f"__{c[6:]}", c).alias(c) if c.startswith("right_") else F.col(c) for c in rows.columns])
