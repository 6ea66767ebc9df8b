import json

from pyspark.sql import functions as F

from kinelake.functions import geometry, text, vectors
from kinelake.operators import edits, gates
from kinelake.sources import formats
from kinelake.streaming import sessions

DIR = "/root/testdata/sf0.001"


def events(spark):
    return spark.read.parquet(f"{DIR}/events.parquet").select(F.col("user_id").alias("source"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))


def test_stream_of_sessions_equals_the_table(spark, tmp_path):
    e = events(spark)
    want = sorted(map(tuple, sessions.sessions(e, "12 hours", "1 day").collect()))
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = sessions.sessions(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "12 hours", "60 days")
    q = s.writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("sess").collect()))
    assert set(got) <= set(want)  # sessions that the watermark has closed
    full = s.writeStream.format("memory").queryName("sess2").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    full.awaitTermination(120)
    assert [r[:4] for r in sorted(map(tuple, spark.table("sess2").collect()))] == [r[:4] for r in want]


def test_tracks_carry_on_over_batches(spark, tmp_path):
    rows = [(1, i, float(i // 2), float(100 * (i % 2) + i), 0.0) for i in range(12)]
    schema = "source long, event_id long, t double, x double, y double"
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d"))
    q = sessions.tracks(s, 2.0, 20.0).writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.event_id: r.track for r in spark.table("tracks").collect()}
    assert len(got) == 12 and len({got[i] for i in range(0, 12, 2)}) == 1 and len({got[i] for i in range(1, 12, 2)}) == 1 and got[0] != got[1]


def test_batches_replace_what_they_wrote(spark, tmp_path):
    df = events(spark).select("event_id").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = sessions.refreshed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda d, n: d.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == df.count()


def test_generations(spark, tmp_path):
    p = str(tmp_path / "g")
    a = spark.createDataFrame([("a", 1), ("b", 2)], "source string, x long")
    formats.write_generation(a, p, "source", 1)
    formats.write_generation(a.where("source = 'a'").withColumn("x", F.lit(9)), p, "source", 2)
    assert sorted((r.source, r.x) for r in formats.latest_generation(spark, p, "source").collect()) == [("a", 9), ("b", 2)]


def test_windows_from_json(spark, tmp_path):
    w = {"source": "s", "scene": 1, "track": 2, "static": False, "sceneStart": 0.0, "sceneEnd": 2.0, "frames": [{"time": 0.1, "points": [[1.0, 2.0, 0.5]]}], "face": [0.5], "faceConfidence": 1.0}
    (tmp_path / "w.json").write_text(json.dumps({"windows": [w, {"source": None, "frames": []}]}))
    r = formats.read_windows(spark, str(tmp_path / "w.json")).collect()
    assert len(r) == 1 and r[0].frames[0].points[0] == [1.0, 2.0, 0.5] and r[0].track == 2


def test_edl_line_and_assets(spark):
    df = spark.createDataFrame([("b", 1.0, 2.0), ("a", 0.0, 3.0), ("b", 0.0, 5.0)], "source string, start double, end double")
    line = df.where("end = 2").select(formats.edl_event(F.lit(7), F.col("source"), F.col("start"), F.col("end"), F.lit(10.0), 25.0, False)).first()[0]
    assert line == "007 b        V     C        00:00:01:00 00:00:02:00 00:00:10:00 00:00:11:00"
    assert sorted(map(tuple, formats.assets(df).select("source", "until", "asset").collect())) == [("a", 3.0, 1), ("b", 5.0, 2)]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_vector_edge_cases(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = one(spark, vectors.cosine(a(1, 0), a(1, 0, 0), -2.0), vectors.cosine(a(0, 0), a(1, 0), -1.0), vectors.cosine(a(1, float("nan")), a(1, 0)), vectors.cosine(a(3, 4), a(6, 8)), vectors.bhattacharyya(a(1), F.lit(None).cast("array<double>")), vectors.rms_distance(a(1, 1), a(1, 1, 1)))
    assert list(r)[:3] == [-2.0, -1.0, 0.0] and abs(r[3] - 1) < 1e-12 and r[4] == 0.5 and abs(r[5] - (1 / 3) ** 0.5) < 1e-12


def test_rotations(spark):
    i = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    z = F.array(*[F.lit(float(x)) for x in (0, -1, 0, 1, 0, 0, 0, 0, 1)])
    r = one(spark, geometry.valid_rotation(i), geometry.valid_rotation(F.transform(i, lambda x: x * 2)), geometry.rotation_distance(i, z), geometry.rotation_angles(z).alias("a"))
    assert r[0] and not r[1] and abs(r[2] - 0.5) < 1e-9 and abs(r.a.roll - 90) < 1e-9


def test_escapes(spark):
    r = one(spark, text.csv_field(F.lit('a"b,c')), text.xml_text(F.lit("<a & 'b'>")), text.json_string(F.lit('q"\n\\')), text.class_key(F.lit("b+a+b")))
    assert list(r) == ['"a""b,c"', "&lt;a &amp; &apos;b&apos;&gt;", '"q\\"\\n\\\\"', "a+b"]


def test_identity_cascade(spark):
    n = F.lit(None).cast("double")
    e = lambda c, f, w, b: gates.identity_evidence(F.lit(c).cast("string"), n if f is None else F.lit(f), n if w is None else F.lit(w), n if b is None else F.lit(b), F.lit(True), F.lit(True))
    assert list(one(spark, e("different", 0.9, None, 0.9), e(None, 0.4, None, None), e(None, None, 0.3, 0.74), e(None, 0.1, None, 0.9), e(None, None, None, 0.8), e(None, None, None, None))) == ["rejected", "verified", "candidate", "rejected", "verified", "none"]


def test_edits_of_sides(spark):
    df = spark.createDataFrame([(1, "a", 0.0, "b", 1.0, 0.5), (2, "c", 2.0, None, None, 0.4), (3, "d", 3.0, None, None, 0.3)], "id long, left_source string, left_start double, right_source string, right_start double, score double")
    gone = edits.without_side(df.where("id = 1"), "left").first()
    assert gone.left_source == "b" and gone.right_source is None and gone.id == 1
    pair = {r.id: r for r in edits.combined_singles(df, 3, 2).collect()}
    assert set(pair) == {1, 2} and pair[2].right_source == "d" and pair[1].right_source == "b"


def test_entry_without_llm(spark):
    import subprocess
    import sys
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = """
import sys

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "kinelake.llm"):
            raise ModuleNotFoundError(name, name=name)

sys.meta_path.insert(0, Missing())
import __spark_entry__ as e

q = e.queries()
assert len(q) > 50 and not any(k.startswith("op") or k == "pipeline" for k in q)
assert set(e.oracle_sql()) <= set(q)
"""
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
