"""What the operators share: reading tables, shared storage, and the vectorised text kernels."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Texts are worked on in pieces of about this many bytes, so that the arrays of a piece (some fifty bytes a byte of text) stay small.
PIECE_BYTES = 1 << 18


def ship(name: str) -> None:
    """Make functions of this module travel by value, so that executors need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def lean(run):
    """run, a function on Arrow batches, and afterwards the worker, which Spark keeps for later tasks, gives its free memory back to the system."""

    def inner(*args):
        try:
            yield from run(*args)
        finally:
            freed()

    return inner


def freed() -> None:
    """Empties the allocators' caches. Without glibc there is nothing to trim."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: spark.checkpoint.dir; where that is unset, the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (at or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


class Scratch:
    """Tables written to shared storage to cut lineage; drop() removes those that no longer serve."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/kinelake/{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def release(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of finished steps, which else stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            p.getFileSystem(conf).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if col.buffers()[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(off: np.ndarray, most: int = PIECE_BYTES):
    """Ranges of rows of about `most` bytes; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_tables: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64; those that only a very long text needs aren't kept."""

    def made(n: int) -> list[np.ndarray]:
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p, out=p))
        return out

    if n > 4 * PIECE_BYTES:
        return tuple(made(n))
    if "p" not in _tables:
        _tables["p"], _tables["q"] = made(4 * PIECE_BYTES)
    return _tables["p"], _tables["q"]


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, A-Z as a-z; and whether the byte belongs to a word."""
    if "t" not in _tables:
        t = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
        t[65:91] = t[97:123]
        w = np.ones(256, bool)
        w[[32, *range(9, 14)]] = False
        _tables["t"], _tables["w"] = t, w
    return _tables["t"], _tables["w"]


def words(data: np.ndarray, off: np.ndarray, trim=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of other bytes than blank and 9-13) of all rows: 64-bit hashes without regard to A-Z's case, starts, ends, and each row's first word (one more at the end).

    trim(starts, ends) may move the ends back before words are hashed.
    """
    t, is_word = _letters()
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    p, q = _powers(n + 1)
    inside = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    if trim is not None:
        end = trim(start, end)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(t[data] * p[:n], out=total[1:])
    h = mix((total[end] - total[start]) * q[start] + (end - start).astype(U64))
    return h, start, end, np.searchsorted(start, off)


_STEP = mix(np.arange(11, 16, dtype=U64))


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each row (the whole row as one where it has fewer words), and each row's number of them."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    if not len(h):
        return np.zeros(0, U64), count
    full = np.zeros(len(h), U64)
    m = len(h) - k + 1
    if m > 0:
        for j in range(k):
            full[:m] += h[j : j + m] * _STEP[j]
    for i in np.flatnonzero((n > 0) & (n < k)):
        a = first[i]
        full[a] = (h[a : a + n[i]] * _STEP[: n[i]]).sum(dtype=U64) + U64(n[i])
    at = np.repeat(first[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return mix(full[at]), count


def sets(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes in order and without repeats."""
    edge = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(edge[:-1], edge[1:]):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[edge[:-1][count > 0]] = True
    row = np.repeat(np.arange(len(count)), count)
    return h[keep], np.bincount(row[keep], minlength=len(count)).astype(np.int64)


class Memory:
    """What a worker remembers of words: at most `most` entries, forgotten together when they would become more."""

    def __init__(self, most: int, longest: int):
        self.most, self.longest, self.known = most, longest, {}

    def look(self, split: list[list], learn) -> list[list]:
        """What is known of each word of each list; learn(words) -> dict tells what isn't."""
        every = set().union(*split)
        new = list(every.difference(self.known))
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(every)
        if new:
            self.known.update(learn(new))
        get = self.known.__getitem__
        out = [list(map(get, words)) for words in split]
        for w in new:
            if len(w) > self.longest:
                del self.known[w]
        return out


def components(scratch: Scratch, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Connected components by large and small stars (Kiveris et al., 2014): nodes (id), links (a, b) -> (id, component), the smallest id reachable.

    Each step is a min-aggregation and an equi-join, so a node with very many links is pre-aggregated before any shuffle; links go to shared storage after each round.
    """
    e = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = print_of(e)
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = scratch.write(small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(small.select("a", "m")).where("a <> b").distinct())
        scratch.drop(e)
        e, was, seen = new, seen, print_of(new)
        if seen == was:  # a round that changes nothing leaves a star for each component
            break
    return nodes.join(e.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))
