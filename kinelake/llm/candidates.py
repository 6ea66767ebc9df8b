"""Candidate search over signatures: blocks of signatures from the map side, runs of equal ones found per bucket, stars instead of pairs, exact verification.

Signatures travel as arrays in binary columns, one row a bucket and flush, so a shuffle moves few rows and sorting is done on machine integers. A run of
equal signatures becomes a star: its pivot (the member with the smallest rank, then id) and its members. Nothing ever holds all pairs of a run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import U64, Scratch, lean, mix, partitions, ship

ship(__name__)

#: Signatures of a flush; a signature that occurs so often in one flush is made a star there, and only its pivot goes on.
FLUSH, LOCAL = 1 << 18, 8
#: Bytes of a membership filter in all: what goes to the driver and back is bounded by this.
FILTER_BYTES = 1 << 22
LOW = U64(0xFFFFFFFF)


def buckets_of(spark) -> int:
    """Buckets of signatures: at least one a shuffle partition, so that they grow with the input as partitions do."""
    return max(256, partitions(spark))


def placed(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high half, 32 bits of key in the low half."""
    return ((h >> U64(32)) % U64(buckets)) << U64(32) | (h & LOW)


def split(v: np.ndarray, buckets: int):
    """(bucket, from, to) of sorted placed values."""
    edge = np.searchsorted(v, np.arange(buckets + 1, dtype=U64) << U64(32))
    for b in np.flatnonzero(np.diff(edge)):
        yield int(b), edge[b], edge[b + 1]


#: Longs of a sketch: a bitmap of fixed size that travels with an id.
SKETCH = 8
STARS = "sig long, pivot long, id long"
ENTRY_NAMES = ("bucket", "keys", "ids", "ranks", "sig", "pivot", "id")
ENTRIES = f"bucket int, keys binary, ids binary, ranks binary, {STARS}"


class Signer:
    """Collects (signature, id, rank) and flushes them as blocks and local stars."""

    def __init__(self, buckets: int, names: tuple | None = None):
        self.buckets, self.held, self.n, self.names = buckets, [], 0, names or ENTRY_NAMES

    def add(self, sig: np.ndarray, ids: np.ndarray, rank: np.ndarray):
        self.held.append((placed(sig, self.buckets), ids, rank))
        self.n += len(sig)
        return self.flush() if self.n >= FLUSH else []

    def flush(self) -> list[pa.RecordBatch]:
        if not self.n:
            return []
        sig, ids, rank = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        order = np.lexsort((ids, rank, sig))
        sig, ids, rank = sig[order], ids[order], rank[order]
        keep = np.ones(len(sig), bool)  # what repeats signature and id is given once
        keep[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
        sig, ids, rank = sig[keep], ids[keep], rank[keep]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        many = np.repeat(size >= LOCAL, size)
        lead = np.zeros(len(sig), bool)
        lead[first] = True
        out = []
        if many.any():
            pivot = np.repeat(ids[first], size)
            out.append(batch(self.names, sig=sig[many].astype(np.int64), pivot=pivot[many], id=ids[many]))
        keep = lead | ~many
        sig, ids, rank = sig[keep], ids[keep], rank[keep]
        parts = list(split(sig, self.buckets))
        key = (sig & LOW).astype("<u4")
        out.append(batch(self.names, bucket=[b for b, _, _ in parts], keys=[key[a:z].tobytes() for _, a, z in parts], ids=[ids[a:z].tobytes() for _, a, z in parts], ranks=[rank[a:z].tobytes() for _, a, z in parts]))
        return out


KINDS = {"bucket": pa.int32(), "keys": pa.binary(), "ids": pa.binary(), "ranks": pa.binary(), "sig": pa.int64(), "pivot": pa.int64(), "id": pa.int64(), "n": pa.int64(), "f": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "bits": pa.binary(), "doc": pa.int64(), "t": pa.int64(), "place": pa.int64(), **{f"s{i}": pa.int64() for i in range(SKETCH)}}


def batch(names: tuple, **cols) -> pa.RecordBatch:
    """A record batch of all of `names`, null where a column isn't given."""
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[c], KINDS[c]) if c in cols else pa.nulls(n, KINDS[c]) for c in names], list(names))


def stars(scratch: Scratch, entries: DataFrame) -> DataFrame:
    """Blocks and local stars -> (sig, pivot, id), a row for each member (the pivot too) of each signature of two members or more; one pivot a signature."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        key = np.concatenate([np.frombuffer(x, "<u4") for x in t.column("keys").to_pylist()])
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("ids").to_pylist()])
        rank = np.concatenate([np.frombuffer(x, np.uint16) for x in t.column("ranks").to_pylist()])
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(first, len(k)))
        own = np.repeat(size > 1, size)
        order, k = order[own], k[own]
        order = order[np.lexsort((ids[order], rank[order], k))]
        k = key[order]
        keep = np.ones(len(k), bool)
        keep[1:] = (k[1:] != k[:-1]) | (ids[order][1:] != ids[order][:-1])
        order, k = order[keep], k[keep]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
        size = np.diff(np.append(first, len(k)))
        sig = (np.int64(t.column("bucket")[0].as_py()) << np.int64(32)) | k.astype(np.int64)
        own = np.repeat(size > 1, size)
        return pa.table({"sig": sig[own], "pivot": np.repeat(ids[order][first], size)[own], "id": ids[order][own]})

    met = scratch.write(entries.where("bucket IS NOT NULL").select("bucket", "keys", "ids", "ranks").groupBy("bucket").applyInArrow(run, STARS))
    top = met.select("sig", F.col("id").alias("pivot"), F.col("pivot").alias("top"))
    local = entries.where("sig IS NOT NULL").select("sig", "pivot", "id").join(top, ["sig", "pivot"], "left").where("top IS NULL OR pivot <> id")
    return met.union(local.select("sig", F.coalesce("top", "pivot"), "id"))


# ---- membership filters ----


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(h)
    return (x % U64(size)).astype(np.int64), ((x >> U64(32)) % U64(size)).astype(np.int64)


class Filter:
    """A Bloom filter in as many slices as there are buckets, FILTER_BYTES in all: no false negatives, and the same answer everywhere."""

    def __init__(self, buckets: int, bits: np.ndarray):
        self.buckets, self.size, self.bits = buckets, slice_bits(buckets), bits

    def test(self, h: np.ndarray) -> np.ndarray:
        v = placed(h, self.buckets)
        at = (v >> U64(32)).astype(np.int64) * self.size
        p, q = _bits(v, self.size)
        p, q = p + at, q + at
        one = (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1
        if not one.any():
            return one.astype(bool)
        return (one & (self.bits[q >> 3] >> (q & 7).astype(np.uint8))).astype(bool)


def sent(spark, rows: list, buckets: int):
    """Broadcasts a filter made of (bucket, slice) rows, as plain arrays: Filter(*value) is the filter."""
    bits = np.zeros((buckets, slice_bits(buckets) // 8), np.uint8)
    for b, x in rows:
        bits[b] = np.frombuffer(x, np.uint8)
    return spark.sparkContext.broadcast((buckets, bits.reshape(-1)))


def slice_bits(buckets: int) -> int:
    return max(512, FILTER_BYTES * 8 // buckets // 8 * 8)


def filled(v: np.ndarray, buckets: int) -> bytes:
    """The slice of a bucket that holds the placed values v."""
    size = slice_bits(buckets)
    bits = np.zeros(size, np.uint8)
    for p in _bits(v, size):
        bits[p] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def id_hash(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(U64))


def filter_of(ids: DataFrame, buckets: int = 256):
    """A filter over a table of ids, sent to all; a slice is made by the task that has its bucket."""

    def tag(batches):
        for b in batches:
            v = placed(id_hash(b.column(0).to_numpy(zero_copy_only=False)), buckets)
            v.sort()
            parts = list(split(v, buckets))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _, _ in parts], pa.int32()), "keys": pa.array([filled(v[a:z], buckets) for _, a, z in parts], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("keys").to_pylist()])
        return pa.table({"bucket": t.column("bucket")[:1].cast(pa.int32()), "keys": pa.array([out.tobytes()], pa.binary())})

    rows = ids.mapInArrow(lean(tag), "bucket int, keys binary").groupBy("bucket").applyInArrow(merge, "bucket int, keys binary").collect()
    return sent(ids.sparkSession, rows, buckets)


# ---- verification ----


def bitmaps(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A bitmap of each row's hashes, of 2 to 4 bits a hash: its size is a power of two, so larger ones fold to smaller."""
    edge, out = np.concatenate([[0], np.cumsum(n)]), []
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
        size = 1 << max(6, (2 * (z - a) - 1).bit_length())
        bits = np.zeros(size, np.uint8)
        bits[(h[a:z] & U64(size - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def sketches(h: np.ndarray, n: np.ndarray) -> dict:
    """Bitmaps of 64 * SKETCH bits of each row's hashes, as columns s0, s1, ..."""
    bits = np.zeros((len(n), 64 * SKETCH), np.uint8)
    bits[np.repeat(np.arange(len(n)), n), (h % U64(64 * SKETCH)).astype(np.int64)] = 1
    words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    return {f"s{i}": words[:, i] for i in range(SKETCH)}


def alone(x: str, y: str):
    """At least so many hashes of side x aren't of side y, as a bit that only one sketch has is a hash that it alone has."""
    return sum((F.bit_count(F.col(f"s{i}{x}").bitwiseAND(F.bitwise_not(F.col(f"s{i}{y}")))) for i in range(SKETCH)), F.lit(0))


def bounded(pairs: DataFrame, node: DataFrame) -> DataFrame:
    """pairs (a, b), node (id, n, bits) -> (a, b, na, nb, most): no more than `most` hashes can be shared, as a bit that only one side has is a hash that it alone has."""
    side = lambda k: node.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"x{k}"))

    def run(batches):
        for t in batches:
            a, b, na, nb, xa, xb = (t.column(i) for i in range(6))
            na, nb, most = na.to_numpy(), nb.to_numpy(), np.zeros(len(t), np.int64)
            for i in range(len(t)):
                x, y = np.frombuffer(xa[i].as_buffer(), np.uint64), np.frombuffer(xb[i].as_buffer(), np.uint64)
                while len(x) > len(y):
                    x = x[: len(x) // 2] | x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] | y[len(y) // 2 :]
                most[i] = min(na[i] - int(np.bitwise_count(x & ~y).sum()), nb[i] - int(np.bitwise_count(y & ~x).sum()))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(na), pa.array(nb), pa.array(most)], ["a", "b", "na", "nb", "most"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(lean(run), "a long, b long, na long, nb long, most long")


#: Ids of a verification block.
BLOCK_IDS = 128


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b), sets (id, hashes: ordered 64-bit hashes as binary) -> (a, b, na, nb, shared).

    Ids are dealt by a hash to blocks of about BLOCK_IDS, and a pair goes to its pair of blocks. A set is sent once to each pair of blocks that needs it, not once
    a pair, so an id with very many partners is neither repeated for each nor held together with all of them. Rows arrive sorted, sets before pairs, and are
    worked on as a stream that holds one pair of blocks.
    """
    blocks = max(1, -(-sets.count() // BLOCK_IDS))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    p = pairs.select("a", "b", of("a").alias("p"), of("b").alias("q"))
    needed = p.select("p", "q", F.col("a").alias("id")).union(p.select("p", "q", "b")).distinct().join(sets, "id")
    none = F.lit(None)
    rows = needed.select("p", "q", F.lit(0).alias("kind"), F.col("id").alias("a"), none.cast("long").alias("b"), "hashes").union(p.select("p", "q", F.lit(1), "a", "b", none.cast("binary")))
    rows = rows.repartition("p", "q").sortWithinPartitions("p", "q", "kind")

    def run(batches):
        at, held = None, {}
        for t in batches:
            key, kind, a, b = list(zip(t.column(0).to_pylist(), t.column(1).to_pylist())), t.column(2).to_pylist(), t.column(3).to_pylist(), t.column(4).to_pylist()
            out = []
            for i in range(len(t)):
                if key[i] != at:
                    at, held = key[i], {}
                if kind[i] == 0:
                    held.setdefault(a[i], []).append(np.frombuffer(t.column(5)[i].as_py(), U64))
                    continue
                for x in held.get(a[i], ()):
                    for y in held.get(b[i], ()):
                        u, v = (x, y) if len(x) <= len(y) else (y, x)
                        n = int((v[np.minimum(np.searchsorted(v, u), max(0, len(v) - 1))] == u).sum()) if len(u) else 0
                        out.append((a[i], b[i], len(x), len(y), n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "na", "nb", "shared"])

    return rows.mapInArrow(lean(run), "a long, b long, na long, nb long, shared long")


def similar(percent: int, shared: str = "shared"):
    """Jaccard of `percent` or more, in integers, over columns na, nb and the number of shared hashes."""
    return F.col(shared) * 100 >= (F.col("na") + F.col("nb") - F.col(shared)) * percent
