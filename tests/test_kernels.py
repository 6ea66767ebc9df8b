"""Numeric kernels and scans against plain versions and invariants."""

import numpy as np
import pytest

from kinelake.operators import gates, motion, scans, selection


def figure(n=20, phase=0.0, speed=1.0, noise=0.0, seed=0):
    r = np.random.RandomState(seed)
    t = np.arange(n) / 10.0
    base = np.array([(0, -2.2), (-0.1, -2.3), (0.1, -2.3), (-0.2, -2.2), (0.2, -2.2), (-0.5, -1.6), (0.5, -1.6), (-0.7, -1), (0.7, -1), (-0.8, -0.4), (0.8, -0.4), (-0.3, 0), (0.3, 0), (-0.3, 1), (0.3, 1), (-0.3, 2), (0.3, 2)], float)
    xy = np.repeat(base[None], n, 0)
    s = np.sin(2 * np.pi * (speed * t + phase))
    xy[:, 9, 1] += s
    xy[:, 9, 0] += 0.4 * s
    xy[:, 7, 1] += 0.5 * s
    xy += noise * r.normal(size=xy.shape)
    return t, np.concatenate([xy * 80 + 200, np.full((n, 17, 1), 0.9)], 2)


def test_equal_windows_are_alike_and_others_less():
    t, k = figure()
    same = motion.compared(t, k, t, k * [1.5, 1.5, 1])
    other = motion.compared(t, k, *figure(phase=0.25, speed=2.3))
    assert same["score"] > 0.95 and not same["mirrored"] and other["score"] < same["score"]


def test_mirroring_is_found():
    t, k = figure()
    flip = k[:, motion.MIRROR].copy()
    flip[..., 0] = 400 - flip[..., 0]
    got = motion.compared(t, k, t, flip)
    assert got["mirrored"] and got["score"] > 0.95
    assert np.allclose(motion.mirrored(motion.mirrored(motion.normalized(t, k))), motion.normalized(t, k))


def test_normalisation_does_not_depend_on_place_or_size():
    t, k = figure(noise=0.02)
    assert np.allclose(motion.normalized(t, k), motion.normalized(t, k * [3, 3, 1] + [50, -20, 0]))
    k[3, 9, 2] = 0.1
    x = motion.normalized(t, k)
    assert np.isnan(x[3, 9]).all() and np.isfinite(x[2, 9]).all()


def plain_dtw(c, w):
    best = {}

    def go(i, j):
        if (i, j) in best:
            return best[i, j]
        if i == j == 0:
            return 0.0, 0
        if i == 0 or j == 0 or abs(i - j) > w:
            return np.inf, 0
        t = min((go(i - 1, j - 1)[0], 0), (go(i - 1, j)[0], 1), (go(i, j - 1)[0], 2))
        p = ((i - 1, j - 1), (i - 1, j), (i, j - 1))[t[1]]
        best[i, j] = t[0] + c[i - 1, j - 1], go(*p)[1] + 1
        return best[i, j]

    a, n = go(*c.shape)
    return a / n


@pytest.mark.parametrize("seed", range(5))
def test_warping_equals_a_plain_version(seed):
    r = np.random.RandomState(seed)
    c = r.rand(r.randint(4, 12), r.randint(4, 12))
    w = max(2, int(np.ceil(0.2 * max(c.shape))), abs(c.shape[0] - c.shape[1]))
    assert motion.dtw(c) == pytest.approx(plain_dtw(c, w))


def test_upper_median_takes_the_element_above():
    assert motion.upper_median([1, 2, 3, 4]) == 3 and motion.upper_median([5]) == 5


def test_velocity_of_a_line_is_its_slope():
    t = np.arange(9) / 10
    xy = np.zeros((9, 17, 2))
    xy[..., 0] = 2 * t[:, None]
    assert np.allclose(motion.velocities(t, xy)[..., 0], 2) and np.allclose(motion.velocities(t, xy)[..., 1], 0)


def test_alignment_moves_forward_in_bounds():
    r = np.random.RandomState(1)
    t = np.arange(12) / 10
    run = motion.aligned(r.rand(12, 12), t, t, 0.4)
    assert len(run) >= 3 and all(0 < b[0] - a[0] <= 2 and 0 < b[1] - a[1] <= 2 for a, b in zip(run, run[1:]))
    assert motion.aligned(np.zeros((3, 3)), t[:3], t[:3], 0.5) == []


def test_sampling_does_not_drift():
    t = np.arange(0, 100, 0.37)
    s = scans.sampled(t, 1.0)
    assert abs(len(s) - 100) <= 1
    assert list(scans.sampled(np.array([0, 0.5, 1.0, 9.0, 9.2, 10.0]), 1.0)) == [0, 2, 3, 5]


def test_thinning_is_greedy():
    assert list(scans.thinned(np.array([0, 0.06, 0.12, 0.18, 0.24]), 0.1)) == [0, 2, 4]


def test_chunks_follow_the_data():
    t = np.array([0, 0.5, 1, 1.5, 2, 2.5, 3, 9, 9.5, 10])
    assert scans.chunks(t, 2.5, 0.75, 0.75, 0.6) == [(0, 6), (2, 7), (4, 7), (7, 10)]


def test_hard_cuts_stand_out_and_keep_apart():
    d = np.ones(40)
    d[10], d[13], d[30] = 50, 50, 60
    assert scans.hard_cuts(d, 20) == [10, 30]
    assert scans.hard_cuts(np.full(30, 50.0), 20) == [1]  # the first change has no past to stand out from; steady motion after it is no cut


def test_hard_cuts_beside_motion_and_between_alike_pictures():
    quiet_after = np.array([0.0] + [30.0, 28.0, 31.0, 29.0, 30.0] * 3 + [60.0] + [1.0] * 10)
    assert 16 in scans.hard_cuts(quiet_after, 27.0)  # twice the past only, but far above what follows
    between = np.array([0.0] + [6.0, 7.0, 6.5, 7.5, 6.0, 7.0] * 2 + [70.0] + [25.0, 24.0, 26.0, 25.0] * 3)
    assert 13 in scans.hard_cuts(between, 27.0)  # less than three times what follows
    alike = np.array([0.0] + [1.0] * 12 + [15.0] + [1.0] * 12)
    assert scans.hard_cuts(alike, 27.0) == [13] and scans.hard_cuts(np.where(alike == 15.0, 12.0, alike), 27.0) == []
    slower = np.array([0.0] + [1.0] * 10 + [20.0, 22.0, 24.0, 26.0, 8.0, 2.0, 1.0, 1.0])
    assert scans.hard_cuts(slower, 27.0) == []  # motion that slows down


def test_fades_and_reversals():
    assert scans.fades(np.array([0, 1, 2, 3, 4, 4, 4, 3.9]), 3) == [(0, 4)]
    assert scans.reversals(np.array([0, 5, 0, 5, 0.0]), 3) == 3 and scans.reversals(np.array([0, 1, 0, 1.0]), 3) == 0


def test_tracker_keeps_people_apart_and_retires():
    t = np.repeat(np.arange(5) / 2, 2)
    box = np.array([[10 * (i % 2) * 10 + i * 0.2, 0, 20, 40] for i in range(10)], float)
    assert list(scans.tracked(t, box)) == [0, 1] * 5
    assert list(scans.tracked(np.array([0, 5.0]), np.array([[0, 0, 9, 9], [0, 0, 9, 9.0]]))) == [0, 1]


def test_suppression_keeps_the_best():
    s, e = np.array([0, 0.5, 10, 10.2]), np.array([5, 5.5, 15, 11.0])
    assert list(selection.nms_keep(s, e, np.array([0.5, 0.9, 0.8, 0.7]), np.arange(4), 0.35, 1.5)) == [False, True, True, False]
    pairs = np.array([[0, 5, 20, 25], [20, 25, 0, 5], [0, 5, 40, 45]], float)
    assert list(selection.pair_nms_keep(pairs, np.array([0.9, 0.8, 0.7]))) == [True, False, True]


def test_quota_re_pairs_along_a_path():
    assert selection.quota_select(["A", "A", "B"], ["B", "C", "D"], 1) == [1, 2]
    assert selection.quota_select(["A", "A", "A"], ["B", "C", "D"], 2) == [0, 1]


def test_diversity_lowers_used_families():
    assert selection.diverse_order(np.array([0.9, 0.89, 0.88]), [("f", "g"), ("f", "g"), ("h", None)]) == [0, 2, 1]


def test_tour_goes_to_the_nearest():
    assert selection.continuity_order(np.array([[0.0], [5], [1], [2]])) == [0, 2, 3, 1] and selection.continuity_order(np.zeros((0, 1))) == []


def test_parameters_are_validated():
    with pytest.raises(ValueError):
        gates.parameters(similarity=float("nan"))
    with pytest.raises(ValueError):
        gates.parameters(max_unique=0)


def test_consensus_needs_repeated_support_in_both_directions(spark):
    from kinelake.operators import identity

    def verdict(rows):
        df = spark.createDataFrame([("a", "b", i, j, float(x)) for i, line in enumerate(rows) for j, x in enumerate(line)], "a string, b string, i long, j long, score double")
        r = identity.consensus(df, ["a", "b"], "i", "j", "score", 0.363, 0.25).first()
        return r.verdict, r.score

    assert verdict([[0.5, 0.6, 0.7, 0.8]] * 3) == ("same", pytest.approx((3 * 0.65 + 0.5 + 0.6 + 0.7 + 0.8) / 7))
    assert verdict([[0.9, 0.3, 0.3]] * 3)[0] == "unknown"  # each sample has one good partner only
    assert verdict([[0.9, 0.9, 0.9], [0.9, 0.9, 0.9], [0.1, 0.2, 0.25]]) == ("different", None)  # one sample contradicts
    assert verdict([[0.9, 0.9]] * 3)[0] == "unknown"  # too few partners
    t = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("a", 0.12), ("b", 0.02)], "k string, t double")
    assert sorted(map(tuple, identity.independent_samples(t, ["k"], "t").collect())) == [("a", 0.01), ("a", 0.12), ("b", 0.02)]


def test_timecodes_and_durations_at_the_edges(spark):
    from pyspark.sql import functions as F

    from kinelake.functions.timecode import frame_duration, timecode

    df = spark.createDataFrame([(0.0,), (59.999,), (60.0,), (600.0,), (90000.0,), (-3.0,)], "s double")
    got = df.select(timecode(F.col("s"), 29.97, True).alias("a"), timecode(F.col("s"), 24.0, True).alias("b"), timecode(F.col("s"), 59.94, True).alias("c")).collect()
    assert [r.a for r in got] == ["00:00:00:00", "00:00:59:28", "00:00:59:28", "00:10:00:00", "25:00:00:00", "00:00:00:00"]
    assert [r.b for r in got][2:5] == ["00:01:00:00", "00:10:00:00", "25:00:00:00"] and got[3].c == "00:10:00:00"
    rates = spark.createDataFrame([(23.976,), (25.0,), (12.3456789,), (0.0,), (float("nan"),), (float("inf"),), (None,)], "f double")
    assert [r[0] for r in rates.select(frame_duration(F.col("f"))).collect()] == ["1001/24000s", "1/25s", "1000000/12345679s", "1/1s", "1/1s", "1/1s", "1/1s"]


def test_ranks_over_many_partitions_lose_no_row(spark):
    from pyspark.sql import functions as F

    from kinelake.operators import admission

    rows = spark.range(200000, numPartitions=8).select("id", (F.col("id") * 7919 % 200000).alias("score"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = admission.ranked(rows, [F.desc("score")], "rank").select(F.count("*"), F.sum(F.abs(F.col("rank") - (200000 - F.col("score")))), F.countDistinct("rank"), F.max("wide").isNotNull()).first()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tuple(got)[:3] == (200000, 0, 200000)


def test_range_pairs_meet_in_cells_of_every_column(spark):
    import itertools

    from pyspark.sql import functions as F

    from kinelake.operators import timeline

    r = np.random.RandomState(2)
    at = [(int(k), float(x) / 10, int(z)) for k, (x, z) in enumerate(zip(r.randint(0, 400, 300), r.randint(-6, 6, 300)))]
    rows = spark.createDataFrame(at, "k long, x double, z int")
    got = timeline.range_pairs(rows, "k", {"x": 2.0, "z": 1.0})
    assert sorted((p.a, p.b) for p in got.collect()) == [(a, b) for (a, x, z), (b, u, w) in itertools.combinations(at, 2) if abs(x - u) <= 2.0 and abs(z - w) <= 1.0]
    assert all(p.a_x == at[p.a][1] and p.b_z == at[p.b][2] for p in got.collect())
    far = spark.range(40000).select("id", F.lit(1.0).alias("x"), (F.col("id") * 3).alias("z"))  # one cell of x; only z tells rows apart
    made = timeline.range_pairs(far, "id", {"x": 2.0, "z": 1.0})
    assert made.count() == 0 and "c1" in made._jdf.queryExecution().optimizedPlan().toString()


def test_quota_equals_a_plain_version_and_ends_on_many_rows():
    def plain(left, right):
        chosen, used = [], set()
        for k, (a, b) in enumerate(zip(left, right)):
            if a not in used and b not in used:
                used |= {a, b}
                chosen.append(k)
        grown = True
        while grown:
            grown, at = False, {x for k in chosen for x in (left[k], right[k])}
            free = [k for k in range(len(left)) if k not in chosen]
            for k in list(chosen):
                ends = left[k], right[k]
                a, b = ([(f, x) for f in free for own, x in ((left[f], right[f]), (right[f], left[f])) if own == e and x not in at] for e in ends)
                pick = next(((p[0], q[0]) for p in a for q in b if p[1] != q[1]), None)
                if pick:
                    chosen.remove(k)
                    chosen += pick
                    grown = True
                    break
        return sorted(chosen)

    for seed in range(60):
        r = np.random.RandomState(seed)
        left = r.randint(0, 25, r.randint(1, 60))
        right = (left + r.randint(1, 25, len(left))) % 25
        assert selection.quota_select(left.tolist(), right.tolist(), 1) == plain(left.tolist(), right.tolist())
    r = np.random.RandomState(1)
    left = r.randint(0, 6000, 40000)
    import time

    start = time.process_time()
    got = selection.quota_select(left.tolist(), ((left + r.randint(1, 6000, 40000)) % 6000).tolist(), 1)
    assert len(got) > 2500 and time.process_time() - start < 20


def test_coverage_rounds_as_its_sql(spark, tmp_path):
    import duckdb

    from kinelake.plans import catalogue

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    shares = [(41, 640), (323, 640), (333, 640), (646, 1280), (1332, 2560), (1, 128), (1, 3), (640, 640)]  # busy days of so many, the last one busy
    rows = [(2 * n + side, n, s, e) for n, (a, b) in enumerate(shares) for side, s, e in ((0, 0, a - 0.5), (1, b - 0.5, b))]
    con.execute("CREATE TABLE x (o BIGINT, c BIGINT, s DOUBLE, e DOUBLE)")
    con.executemany("INSERT INTO x VALUES (?, ?, ?, ?)", rows)
    at = lambda k: f"make_timestamp((788918400000000 + {k} * 86400000000)::BIGINT)"
    con.execute(f"CREATE TABLE orders AS SELECT o AS o_orderkey, c AS o_custkey, {at('s')} AS o_orderdate FROM x")
    con.execute(f"CREATE TABLE lineitem AS SELECT o AS l_orderkey, 1 AS l_linenumber, {at('e')} AS l_shipdate FROM x")
    for t in ("orders", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["coverage_summary"]).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["coverage_summary"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == len(shares)


def test_range_pairs_compare_equal_rows_once(spark, monkeypatch):
    import itertools

    from pyspark.sql import functions as F

    from kinelake.operators import timeline

    monkeypatch.setattr(timeline, "CHUNK", 7)  # equal rows cross chunks
    r = np.random.RandomState(6)
    at = [(int(k), None if x == 0 else float(x) / 2, int(z)) for k, (x, z) in enumerate(zip(r.randint(0, 12, 400), r.randint(0, 4, 400)))]
    got = timeline.range_pairs(spark.createDataFrame(at, "k long, x double, z int").repartition(3), "k", {"x": 1.0, "z": 1.0})
    want = [(a, b) for (a, x, z), (b, u, w) in itertools.combinations(at, 2) if x is not None and u is not None and abs(x - u) <= 1.0 and abs(z - w) <= 1]
    pairs = got.collect()
    assert sorted((p.a, p.b) for p in pairs) == want and all((p.a_x, p.b_z) == (at[p.a][1], at[p.b][2]) for p in pairs)
    monkeypatch.setattr(timeline, "CHUNK", 1024)
    same = spark.range(9000).select("id", F.lit(1.0).alias("x"), (F.col("id") % 3 * 5).alias("z"))
    made = timeline.range_pairs(same, "id", {"x": 2.0, "z": 1.0})
    assert made.count() == 3 * 3000 * 2999 // 2 and "collect_list" in made._jdf.queryExecution().optimizedPlan().toString()  # rows meet as chunks of equal ones


def test_quota_of_a_group_does_not_hold_its_rows(spark, monkeypatch):
    r = np.random.RandomState(4)
    rows = [(None if g == 3 else int(g), int(i), int(j), None if x == 0 else float(x)) for g, i, j, x in zip(r.randint(0, 4, 30000), r.randint(0, 400, 30000), r.randint(300, 4000, 30000), r.randint(0, 5000, 30000))]
    want = {1: [], 2: []}
    for g in (None, 0, 1, 2):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[3] is None, -(x[3] or 0), x[1], x[2]))
        for q in want:
            want[q] += [own[k] for k in selection.quota_select([x[1] for x in own], [x[2] for x in own], q)]
    whole = selection.quota_select

    def few(left, right, quota):
        assert len(left) < 2000  # of about 7,500 rows of the group
        return whole(left, right, quota)

    monkeypatch.setattr(selection, "quota_select", few)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = {q: selection.with_quota(spark.createDataFrame(rows, "g int, i long, j long, score double").repartition(3), "g", q).collect() for q in want}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in want:
        assert sorted(map(str, map(tuple, got[q]))) == sorted(map(str, want[q])) and len(want[q]) > 1000


def test_meetings_of_sources_make_no_row_of_each_slot(spark):
    import itertools

    from kinelake.operators import timeline

    r = np.random.RandomState(3)
    seen = {k: {int(x) for x in r.choice([-70, 0, 1, 31, 32, 33, 64, 95, 96, 5000, 9000, *range(200, 260)], r.randint(1, 25))} for k in range(1100)}
    rows = spark.createDataFrame([(k, x) for k, s in seen.items() for x in s], "source long, slot long")
    met = timeline.seen_together(rows, 3)
    both = ((a, b, seen[a] & seen[b]) for a, b in itertools.combinations(seen, 2))
    assert sorted(map(tuple, met.collect())) == [(a, b, len(s), max(s) - min(s)) for a, b, s in both if len(s) >= 3]
