import re

import numpy as np
import pytest

from kinelake.llm import candidates, ngram_join
from kinelake.llm.common import Scratch, components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t, k=5):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=80):
    s = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = s[a], s[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = sorted((top(a), top(b)))
                    up[q] = p
    return {i: (len(s[i]), top(i)) for i in s}


@pytest.mark.parametrize("percent", [80, 60])
def test_components_equal_brute_force(spark, docs, corpus, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(Scratch(spark), docs, percent=percent).collect()}
    assert got == brute(corpus, percent)


def test_frequent_class_does_not_change_results(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(candidates, "LOCAL", 3)
    monkeypatch.setattr(ngram_join, "frequent_filter", lambda d, tokens, buckets, f=ngram_join.frequent_filter: f(d, tokens, buckets, most=2))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(Scratch(spark), docs).collect()}
    assert got == brute(corpus)


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "A B c d e f"), (4, None)]
    got = sorted(ngram_join.joined(Scratch(spark), spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, None), (2, 2, 1), (2, 2, 1), (1, 2, 1), (4, 0, 4)], key=str)
    assert ngram_join.joined(Scratch(spark), spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefixes_of_linked_sets_share_a_signature():
    r = np.random.RandomState(3)
    for _ in range(300):
        n = r.randint(1, 60)
        x = np.unique(r.randint(1, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.rand(len(x)) > 0.1 * r.rand()], r.randint(1, 1 << 62, r.randint(0, 1 + len(x) // 8)).astype(np.uint64)]))
        n = len(np.intersect1d(x, y))
        if 100 * n < 80 * (len(x) + len(y) - n):
            continue
        often = r.randint(0, 5)
        flag = lambda h: (h >> np.uint64(7)) % np.uint64(4) < often
        sig = [set(ngram_join.signatures(h, np.array([len(h)]), flag(h), 80)[0].tolist()) for h in (x, y)]
        assert sig[0] & sig[1]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(301, 300)]
    nodes = spark.range(0, 400)
    got = {r.id: r.component for r in components(Scratch(spark), nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 150)) and got[301] == 300 and got[399] == 399 and len(got) == 400


def test_growing_versions_near_the_threshold(spark):
    r = np.random.RandomState(11)
    rows = []
    for g in range(60):  # versions of 99, 100 and 125 shingles, each within the next: the first two link, and the last two at exactly 0.80
        w = [f"g{g}x{k}" for k in r.permutation(129)]
        rows += [(3 * g + v, " ".join(w[:n])) for v, n in enumerate((103, 104, 129))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(Scratch(spark), spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
