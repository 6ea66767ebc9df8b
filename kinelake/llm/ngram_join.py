"""N-gram Jaccard self-join by token-combination prefixes.

Tokens are the distinct five-word shingles of a text. A token in more than FREQUENT texts is of the frequent class, others are rare. All texts order their
tokens alike, rare ones first. Rare prefix tokens are indexed alone; frequent ones only as combinations of two that follow each other among the text's
frequent tokens, for which the prefix is extended. Why no link is lost: of two linked sets take the one whose prefix ends first. A token of it that the
other lacks removes at most one rare signature or two combinations, a token only the other has removes at most one combination; with Jaccard t the sum
2 * |x - y| + |y - x| is at most 2(1 - t)|x|. A prefix of r rare and f frequent tokens with 2r + (f - 1) above that keeps a common signature, and every
common token of it lies in the other's prefix too. Candidates are then verified on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm import candidates as C
from kinelake.llm.common import U64, Scratch, components, lean, mix, pieces, sets, shingles, ship, utf8, words

ship(__name__)

#: A token in more texts than this is frequent.
FREQUENT = 32
SKETCHED = tuple(f"s{i}" for i in range(C.SKETCH))
NAMES = ("bucket", "keys", "ids", "ranks", "sig", "pivot", "id", "n", "f", "d1", "d2", "bits", *SKETCHED)
SINGLE, COMBINED, EVEN = U64(0x2545F4914F6CDD1D), U64(0xD6E8FEB86659FD93), U64(0xFFFFFFFFFFFFFFFE)


def token_sets(col: pa.Array, k: int):
    """(first row, last row, tokens of each row in order, their numbers) for pieces of a column of texts."""
    data, off = utf8(col)
    for lo, hi in pieces(off):
        h, _, _, first = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        yield lo, hi, *sets(*shingles(h, first, k))


def frequent_filter(docs: DataFrame, tokens, buckets: int, most: int = FREQUENT):
    """A filter that holds every token in more than `most` rows of docs. tokens(batch) gives arrays of tokens, each token once a row. Counts cover all rows: tokens are
    pre-aggregated in blocks, then counted per bucket."""

    def count(batches):
        held, n = [], 0

        def flush():
            v = C.placed(np.concatenate(held), buckets)
            v.sort()
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            size = np.diff(np.append(first, len(v))).astype("<u4")
            v = v[first]
            parts = list(C.split(v, buckets))
            key = (v & C.LOW).astype("<u4")
            more = [(np.flatnonzero(size[a:z] > 1) + 0).astype("<u4") for _, a, z in parts]
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array([b for b, _, _ in parts], pa.int32()), "keys": pa.array([key[a:z].tobytes() for _, a, z in parts], pa.binary()),
                "at": pa.array([m.tobytes() for m in more], pa.binary()), "size": pa.array([size[a:z][m].tobytes() for m, (_, a, z) in zip(more, parts)], pa.binary()),
            })

        for b in batches:
            for h in tokens(b):
                if len(h):
                    held.append(h)
                    n += len(h)
                if n >= 2 * C.FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def total(t: pa.Table) -> pa.Table:
        b = t.column("bucket")[0].as_py()
        keys, sizes = [], []
        for key, at, size in zip(*(t.column(c).to_pylist() for c in ("keys", "at", "size"))):
            keys.append(np.frombuffer(key, "<u4"))
            w = np.ones(len(keys[-1]), np.uint32)
            w[np.frombuffer(at, "<u4")] = np.frombuffer(size, "<u4")
            sizes.append(w)
        key, w = np.concatenate(keys), np.concatenate(sizes)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        often = key[first][np.add.reduceat(w[order].astype(np.int64), first) > most]
        bits = [C.filled(U64(b) << U64(32) | often.astype(U64), buckets)] if len(often) else []
        return pa.table({"bucket": pa.array([b] * len(bits), pa.int32()), "keys": pa.array(bits, pa.binary())})

    rows = docs.mapInArrow(lean(count), "bucket int, keys binary, at binary, size binary").groupBy("bucket").applyInArrow(total, "bucket int, keys binary").collect()
    return C.sent(docs.sparkSession, rows, buckets)


def signatures(h: np.ndarray, n: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of rows with tokens h (n a row) of which `often` marks the frequent (single tokens even, combinations odd); the rows they come from; each row's number
    of rare tokens."""
    row = np.repeat(np.arange(len(n)), n)
    rare_n = np.bincount(row[~often], minlength=len(n))
    need = 2 * (100 - percent) * n // 100 + 1
    rare_take = np.minimum(rare_n, -(-need // 2))
    often_take = np.where(2 * rare_take >= need, 0, need - 2 * rare_n + 1)
    out, rows = [], []

    def first_of(mask, take):
        r = row[mask]
        count = np.bincount(r, minlength=len(n))
        rank = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        keep = rank < take[r]
        return h[mask][keep], r[keep]

    a, r = first_of(~often, rare_take)
    out.append(mix(a ^ SINGLE) & EVEN)
    rows.append(r)
    if often.any():
        a, r = first_of(often, often_take)
        same = r[1:] == r[:-1]
        out.append(mix(a[:-1][same] * COMBINED + a[1:][same]) | U64(1))
        rows.append(r[1:][same])
        one = np.flatnonzero((n == 1) & (rare_n == 0))
        out.append(mix(h[np.searchsorted(row, one)] ^ SINGLE) & EVEN)
        rows.append(one)
    return np.concatenate(out), np.concatenate(rows), rare_n


def indexed(docs: DataFrame, often, buckets: int, k: int, percent: int) -> DataFrame:
    """Blocks of signatures, local stars, and a row (id, n, f, d1, d2, bits) for each text: its number of tokens and of frequent ones, a 128-bit digest and a bitmap of its set."""

    def run(batches):
        signer, known = C.Signer(buckets, NAMES), C.Filter(*often.value)
        for b in batches:
            ids = b.column(0)
            for lo, hi, h, n in token_sets(b.column(1), k):
                own = ids.slice(lo, hi - lo)
                at, m = np.cumsum(n) - n, mix(h)
                d1, d2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
                full = n > 0
                if full.any():
                    d1[full] = np.add.reduceat(m, at[full])
                    d2[full] = np.add.reduceat(mix(m ^ COMBINED), at[full])
                sig, row, rare = signatures(h, n, known.test(h), percent)
                rank = (65535 * rare // np.maximum(1, n)).astype(np.uint16)
                yield C.batch(NAMES, id=own, n=n, f=n - rare, d1=d1.view(np.int64), d2=d2.view(np.int64), bits=C.bitmaps(h, n), **C.sketches(h, n))
                given = np.asarray(own.is_valid())
                ok = given[row]
                key = np.asarray(own.fill_null(0), np.int64)
                yield from signer.add(sig[ok], key[row[ok]], rank[row[ok]])
        yield from signer.flush()

    return docs.select("id", "text").mapInArrow(lean(run), f"{C.ENTRIES}, n long, f long, d1 long, d2 long, bits binary, {', '.join(f'{c} long' for c in SKETCHED)}")


def sets_of(docs: DataFrame, wanted, k: int) -> DataFrame:
    """(id, hashes) of texts whose id passes a filter (broadcast)."""

    def run(batches):
        known = C.Filter(*wanted.value)
        for b in batches:
            ids = b.column(0)
            own = np.asarray(ids.is_valid()) & known.test(C.id_hash(np.asarray(ids.fill_null(0))))
            part = b.filter(pa.array(own))
            for lo, hi, h, n in token_sets(part.column(1), k):
                edge = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), pa.array([h[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:])], pa.binary())], ["id", "hashes"])

    return docs.select("id", "text").mapInArrow(lean(run), "id long, hashes binary")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def across(scratch: Scratch, star: DataFrame, found: DataFrame, node: DataFrame, far: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) that stars leave open: members of one signature in different components, one of each set of equal texts.

    node: (id, n, f, d1, d2, a sketch); far: (a = pivot, b, least, most), bounds of the tokens that they share. Pairs with the pivot have
    been verified. Signatures whose members are all in one component, most of them, need nothing more; in others, members outside the pivot's component meet
    members of other components, unless a bound rules the link out.

    Why the rows stay in proportion to the input. A single token (even) is rare, so FREQUENT texts hold it at most. Whoever has a combination (odd) among its signatures
    has all its rare tokens among them: two texts that share a rare token meet there, so others share frequent tokens only, f of them at most, and link only if
    both f reach `percent` of 100 + `percent` parts of the sum of their sizes. Before any join this drops members for which the signature's smallest member is too large:
    of a group of copies with changes of their own, however large, all that are too far from the pivot to link with it, since what they share with any copy they share with the pivot.
    That test needs counts alone, so digests and bounds are joined to the members that pass it only, and sketches to those whose signature still has members apart once equal
    texts are one; the steps before are written, which frees their shuffles.
    What x and y share lies in the pivot, or it is a token of x that the pivot doesn't hold; so they share at most what y and the pivot do and the number of such tokens
    of x. That a token of x's prefix met no other prefix says nothing: others may hold it beyond theirs. Sketches bound it too.
    """
    main = F.max(F.when(F.col("pivot") == F.col("id"), F.col("component"))).alias("main")
    open_ = scratch.write(star.join(found, "id").groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), main).where("lo <> hi").select("sig", "main"))
    scratch.release()
    size = node.select("id", "n", "d1", "d2")
    far = far.groupBy(F.col("a").alias("pivot"), F.col("b").alias("id")).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    reach = lambda f, n, m: f * (100 + percent) >= (n + m) * percent
    shared = F.when(F.col("sig") % 2 == 0, F.col("n")).otherwise(F.col("f")).alias("f")
    every = scratch.write(star.where("pivot <> id").select("sig", "pivot", "id").join(open_, "sig").join(found, "id").join(node.select("id", "n", "f"), "id").select("sig", "main", "pivot", "id", "component", "n", shared))
    scratch.release()
    low = every.groupBy("sig").agg(F.min("n").alias("low"))
    own = scratch.write(every.join(low, "sig").where(reach(F.col("f"), F.col("n"), F.col("low"))).drop("n", "low"))
    scratch.drop(every, open_)
    scratch.release()
    own = own.join(size, "id").join(far, ["pivot", "id"], "left").withColumn("most", F.coalesce("most", "n")).withColumn("other", F.col("n") - F.coalesce("least", F.lit(0)))
    kept = ("n", "f", "id", "component", "most", "other", *SKETCHED)
    own = scratch.write(own.groupBy("sig", "main", "n", "d1", "d2").agg(F.min(F.struct("f", "id", "component", "most", "other")).alias("m")).select("sig", "main", "n", "m.*"))
    scratch.release()
    apart = own.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.col("component") != F.col("main")).alias("far")).where("lo <> hi AND far").select("sig")
    own = own.join(apart, "sig", "left_semi").join(node.select("id", *SKETCHED), "id")
    x = own.where("component <> main").select("sig", *[F.col(c).alias(f"{c}1") for c in kept])
    y = own.select("sig", *[F.col(c).alias(f"{c}2") for c in kept])
    share = F.least("f1", "f2", F.col("most1") + F.col("other2"), F.col("most2") + F.col("other1"), F.col("n1") - C.alone("1", "2"), F.col("n2") - C.alone("2", "1"))
    near = share * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent
    return x.join(y, "sig").where((F.col("id1") != F.col("id2")) & (F.col("component1") != F.col("component2")) & near).select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()


def joined(scratch: Scratch, docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, n_shingles, component_id), a row for each row of docs; component_id is the smallest id reachable by links, its own included.

    Two texts link when their sets of distinct k-word shingles (words as runs of other characters than blank and 9-13, A-Z in lower case; fewer than k words
    are one shingle) have a Jaccard similarity of percent/100 or more. Null texts and texts without words have an empty set and no links. Rows that share an id
    are one node of the graph and keep a row each; a null id has no links and a null component_id. Other columns are left out; empty tables give no rows.
    Sets are of 64-bit hashes. percent must be above 50.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = C.buckets_of(spark)
    often = frequent_filter(docs.select("text"), lambda b: (h for _, _, h, _ in token_sets(b.column(0), k)), buckets)
    scratch.release()
    index = scratch.write(indexed(docs, often, buckets, k, percent))
    info = scratch.write(index.where("n IS NOT NULL").select("id", "n", "f", "d1", "d2", "bits", *SKETCHED))
    star = scratch.write(C.stars(scratch, index))
    scratch.drop(index)
    scratch.release()
    node = info.where("id IS NOT NULL AND n > 0")
    side = lambda s: node.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.struct("d1", "d2").alias(f"d{s}"))
    pairs = star.where("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    pairs = scratch.write(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("da") == F.col("db")).alias("same")))
    fresh = scratch.write(C.bounded(pairs.where("NOT same").select("a", "b"), node))
    open_ = fresh.where(C.similar(percent, "most")).select("a", "b")
    whole = scratch.write(sets_of(docs, C.filter_of(ends(open_)), k))
    met = scratch.write(C.verified(open_, whole))
    scratch.drop(whole)
    scratch.release()
    far = met.select("a", "b", F.col("shared").alias("least"), F.col("shared").alias("most")).union(fresh.where(~C.similar(percent, "most")).select("a", "b", F.lit(0).cast("long"), "most"))
    far = far.union(pairs.where("same").join(side("a"), "a").select("a", "b", "na", "na"))
    copies = node.join(node.groupBy("n", "d1", "d2").agg(F.min("id").alias("a"), F.count("*").alias("c")).where("c > 1"), ["n", "d1", "d2"]).select("a", F.col("id").alias("b"))
    links = scratch.write(copies.union(met.where(C.similar(percent)).select("a", "b")).where("a <> b").distinct())
    every = node.select("id").distinct()
    found = scratch.write(components(scratch, every, links))
    rest = scratch.write(C.bounded(across(scratch, star, found, node, far, percent), node).where(C.similar(percent, "most")).select("a", "b"))
    scratch.drop(star)
    scratch.release()
    if not rest.isEmpty():
        whole = scratch.write(sets_of(docs, C.filter_of(ends(rest)), k))
        more = scratch.write(C.verified(rest, whole).where(C.similar(percent)).select("a", "b"))
        scratch.drop(whole)
        scratch.release()
        found = scratch.write(components(scratch, every, links.union(more)))
    return info.join(found, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
