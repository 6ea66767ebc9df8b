import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from kinelake.llm import bitslice, permutation
from kinelake.llm.common import Scratch


@pytest.fixture()
def odd_vectors(spark):
    r = np.random.RandomState(1)
    rows = [(i, [float(x) for x in r.normal(size=8)], "x") for i in range(60)]
    rows[7] = (7, rows[6][1], "x")  # a tie
    rows[8] = (8, rows[6][1], "x")
    rows += [(100, None, "x"), (101, [1.0, None, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], "x"), (102, [float("nan")] * 8, "x"), (103, [float("inf")] + [0.0] * 7, "x"), (104, [0.0] * 8, "x"), (105, [1.0, 2.0], "x"), (106, [], "x"), (None, [1.0] * 8, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), rows


def usable(rows, zero):
    return [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


def test_bit_slices_equal_brute_force(spark, odd_vectors):
    df, rows = odd_vectors
    got = sorted(map(tuple, bitslice.top_k(Scratch(spark), df, df.where("vec_id % 2 = 0"), k=5).collect()))
    floor = {i: [math.floor(256 * x) for x in v] for i, v in usable(rows, True)}
    want = []
    for q, v in floor.items():
        if q % 2 == 0:
            s = sorted((-sum(map(int.__mul__, v, w)), i) for i, w in floor.items() if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == sorted(want)


@pytest.mark.parametrize("scale", [0, 1, 3, 100, 10**6, 10**12])
def test_boundary_holds_the_best(scale):
    r = np.random.RandomState(scale % 97)
    x = r.randint(-scale, scale + 1, (700, 5))
    index = bitslice.BitSlices(x)
    for q in r.randint(-min(scale, 500), min(scale, 500) + 1, (20, 5)):
        s = x @ q
        kth = np.sort(s)[-6]
        assert set(np.flatnonzero(s >= kth)) <= set(index.boundary(q, 6))


def test_large_components_are_exact(spark):
    rows = [(i, [1e6 * i, -2e9 + i, 3.5]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, bitslice.top_k(Scratch(spark), df, df.where("vec_id = 3"), k=2).collect()))
    f = [[math.floor(256 * x) for x in v] for _, v in rows]
    s = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(f[3], v)))), i) for i, v in enumerate(f) if i != 3)[:2]
    assert got == [(3, k + 1, i, -x) for k, (x, i) in enumerate(s)]


def test_neighbours_are_exact_for_small_tables(spark, odd_vectors):
    df, rows = odd_vectors
    got = sorted(map(tuple, permutation.neighbours(Scratch(spark), df, df.where("vec_id % 2 = 0"), k=5).collect()))
    own, want = usable(rows, False), []
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    for q, v in own:
        if q % 2 == 0:
            s = sorted((round(-cos(v, w), 12), i) for i, w in own if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i) for k, (_, i) in enumerate(s)]
    assert [g[:3] for g in got] == sorted(want)
    assert bitslice.top_k(Scratch(spark), df.limit(0), df.limit(0)).collect() == [] == permutation.neighbours(Scratch(spark), df.limit(0), df.limit(0)).collect()


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = permutation.neighbours(Scratch(spark), df, df.where("vec_id % 50 = 0"), least=1).collect()
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        s = u @ u[ids == q][0]
        s[ids == q] = -9
        best = set(ids[np.argsort(-s)[:5]].tolist())
        own = [r for r in got if r.query_id == q]
        hit, total = hit + len(best & {r.vec_id for r in own}), total + 5
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in own)
    assert hit / total >= 0.9


def test_every_vector_length_is_searched(spark):
    rows = [(100 * d + i, [float((i * 7 + j * 3) % 11 + 1) for j in range(d)]) for d in range(1, 21) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = permutation.neighbours(Scratch(spark), df, df, k=5).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(100 * d + i, 100 * d + j) for d in range(1, 21) for i in range(3) for j in range(3) if i != j}


def test_repeated_ids_of_the_query_leave_room_for_others(spark):
    rows = [(1, [9.0, 9.0])] * 8 + [(i, [float(i % 5), 1.0]) for i in range(2, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted(map(tuple, bitslice.top_k(Scratch(spark), df, df.where("vec_id = 1"), k=5, scale=1.0).collect()))
    s = sorted((-9 * (i % 5 + 1), i) for i in range(2, 30))[:5]
    assert got == [(1, k + 1, i, -x) for k, (x, i) in enumerate(s)]
