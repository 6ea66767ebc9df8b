"""Writers' line formats and the engine's stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.functions import text
from kinelake.functions.timecode import frame_duration, timecode


def csv_lines(rows: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws(",", *[text.csv_field(F.col(c)) for c in columns])


def json_lines(columns: list[str], strings: set[str]) -> Column:
    parts = [F.concat(F.lit(f'"{c}":'), text.json_string(F.col(c)) if c in strings else F.col(c).cast("string")) for c in columns]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def edl_event(n: Column, reel: Column, start: Column, end: Column, at: Column, fps: float, drop: bool) -> Column:
    """One event line: number, reel, source range and record range as timecodes."""
    tc = lambda x: timecode(x, fps, drop)
    return F.concat_ws(" ", F.lpad(n.cast("string"), 3, "0"), F.rpad(reel, 8, " "), F.lit("V     C       "), tc(start), tc(end), tc(at), tc(at + end - start))


def cut_plan(rows: DataFrame, group: list[str], order: list, pause: float = 0.25) -> DataFrame:
    """rows (start, end, ...) with at, where each clip starts when all of its group are laid one after another with a pause between them."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", F.coalesce(F.sum(F.col("end") - F.col("start") + pause).over(w), F.lit(0.0)))


def assets(rows: DataFrame) -> DataFrame:
    """(source, asset, until): a number for each source in order of name and the latest end used of it."""
    x = rows.groupBy("source").agg(F.max("end").alias("until"))
    return x.withColumn("asset", F.dense_rank().over(Window.orderBy("source")).cast("int"))


def duration_of(fps: Column) -> Column:
    return frame_duration(fps)


WINDOW_SCHEMA = (
    "source string, scene long, track long, static boolean, sceneStart double, sceneEnd double, frames array<struct<time double, points array<array<double>>>>, "
    "face array<float>, faceConfidence double, body array<float>, bodyConfidence double, context array<float>, view array<float>"
)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Windows from the diagnostic JSON dump ({"windows": [...]}); rows that don't hold a source and frames are dropped."""
    x = spark.read.schema(f"windows array<struct<{WINDOW_SCHEMA.replace(' array', ': array').replace(' string', ': string').replace(' long', ': long').replace(' boolean', ': boolean').replace(' double', ': double')}>>").option("multiLine", True).json(path)
    return x.select(F.explode("windows").alias("w")).select("w.*").where(F.col("source").isNotNull() & (F.size("frames") > 0))


def write_generation(df: DataFrame, path: str, source_col: str, generation: int) -> None:
    """Writes one generation of each source's rows, replacing only the partitions that the rows touch."""
    df.withColumn("generation", F.lit(generation)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source_col, "generation").parquet(path)


def latest_generation(spark: SparkSession, path: str, source_col: str) -> DataFrame:
    """Each source's rows of its newest generation."""
    x = spark.read.parquet(path)
    top = x.groupBy(source_col).agg(F.max("generation").alias("generation"))
    return x.join(top, [source_col, "generation"], "left_semi")


def text_result(number, score, verified, identity, seconds, left: dict, right: dict) -> list:
    """Lines of one result in a plain text list: number and score, identity, active duration, and both sides (on, source, start, end)."""
    own = lambda s: F.greatest(F.lit(0.0), s["end"] - s["start"])
    active = F.when(left["on"] & right["on"], seconds).when(left["on"], own(left)).when(right["on"], own(right)).otherwise(0.0)
    fixed = lambda x, n: F.format_string(f"%.{n}f", x.cast("double"))
    side = lambda name, s: F.concat(F.lit(f"  {name}: "), F.when(s["on"], "").otherwise("[disabled] "), s["source"], F.lit("  "), fixed(s["start"], 3), F.lit("–"), fixed(s["end"], 3), F.lit(" s"))
    return [
        F.concat(F.lit("#"), number.cast("string"), F.lit("  "), fixed(score * 100, 1), F.lit("%")), F.concat(F.lit("  Identity: "), F.when(verified, "verified").otherwise("pose-only"), F.lit(" ("), fixed(identity, 3), F.lit(")")),
        F.concat(F.lit("  Duration: "), fixed(active, 3), F.lit(" s")), side("A", left), side("B", right),
    ]
