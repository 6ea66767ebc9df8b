"""Line deduplication by overlapping windows of three lines, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import Scratch


def windows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, t, h1, h2, at): every run of `size` lines that aren't blank, as a 128-bit hash of the trimmed lines, with the lines' numbers in the text."""
    line = F.split(F.col(text_col), "\n", -1)
    full = F.filter(F.transform(line, lambda x, i: F.struct(F.xxhash64(F.trim(x)).alias("a"), F.xxhash64(F.lit(1), F.trim(x)).alias("b"), i.alias("i"), (F.trim(x) != "").alias("f"))), lambda s: s.f)
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), full.alias("l")).where(F.size("l") >= size)
    # pair each line with those that follow: the shifted arrays are zipped, so each is evaluated once
    shifted = F.arrays_zip(*[F.slice("l", k + 1, F.size("l") - size + 1).alias(f"l{k}") for k in range(size)])
    d = d.select("id", "t", F.explode(shifted).alias("w"))
    part = lambda f: F.xxhash64(*[F.col(f"w.l{k}.{f}") for k in range(size)])
    return d.select("id", "t", part("a").alias("h1"), part("b").alias("h2"), F.array(*[F.col(f"w.l{k}.i") for k in range(size)]).alias("at"))


def deduplicated(scratch: Scratch, docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's later repeats removed, and n_lines and n_removed.

    A window is a run of `size` consecutive lines that aren't blank, compared trimmed of spaces. A window that occurs before, in a text with a smaller id or
    earlier in its own, is a later occurrence, and the lines it covers go; where it overlaps the first occurrence in its own text, the first one's lines stay.
    Covered lines of all windows of a text are merged. Texts with fewer lines, and null texts (n_lines 0), stay as they are; a text that loses every line
    becomes empty. Rows that share id and text are kept alike; a null id comes before others. Other columns pass through.

    The windows go to shared storage once. The first occurrence is a min-aggregation, pre-aggregated before its shuffle; a window that a third of all texts
    hold is one row on the other side of the join, whose skewed side Spark splits.
    """
    docs = docs.drop("n_lines", "n_removed")
    win = scratch.write(windows(docs, id_col, text_col, size))
    first = win.groupBy("h1", "h2").agg(F.min(F.struct("id", "t", F.col("at")[0].alias("i"), F.col("at")[size - 1].alias("z"))).alias("f"), F.count("*").alias("c")).where("c > 1").select("h1", "h2", "f")
    own = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("t") == F.col("f.t"))
    later = win.join(first, ["h1", "h2"]).where(~(own & (F.col("at")[0] == F.col("f.i"))))
    covered = F.when(own, F.filter("at", lambda i: i > F.col("f.z"))).otherwise(F.col("at"))
    gone = later.select("id", "t", F.explode(covered).alias("i")).groupBy("id", "t").agg(F.array_sort(F.collect_set("i")).alias("g"))
    # a string with 1 for every removed line, so that zipping it with the lines takes time linear in them
    steps = F.filter(F.arrays_zip(F.col("g").alias("c"), F.concat(F.array(F.lit(-1)), "g").alias("p")), lambda s: s.c.isNotNull())
    mask = F.array_join(F.transform(steps, lambda s: F.concat(F.repeat(F.lit("0"), s.c - s.p - 1), F.lit("1"))), "")
    gone = gone.select(F.col("id").alias("__id"), F.col("t").alias("__t"), F.size("g").alias("__n"), mask.alias("__mask"))
    d = docs.withColumn("__h", F.xxhash64(text_col))
    d = d.join(gone, d[id_col].eqNullSafe(gone["__id"]) & (d["__h"] == gone["__t"]), "left")
    line = F.split(F.col(text_col), "\n", -1)
    marked = F.arrays_zip(line.alias("x"), F.split(F.rpad("__mask", F.size(line), "0"), "").alias("m"))
    kept = F.array_join(F.transform(F.filter(marked, lambda s: s.x.isNotNull() & (s.m == "0")), lambda s: s.x), "\n")
    d = d.withColumn("n_lines", F.coalesce(F.size(line), F.lit(0)).cast("long")).withColumn("n_removed", F.coalesce("__n", F.lit(0)).cast("long"))
    return d.withColumn(text_col, F.when(F.col("__n").isNotNull(), kept).otherwise(F.col(text_col))).drop("__id", "__t", "__n", "__h", "__mask")
