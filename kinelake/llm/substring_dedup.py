"""Substring deduplication by MinHash banding of paragraphs.

A paragraph is a line that holds words. Paragraphs of the same words in the same order are one node, told by a 128-bit digest. Nodes that agree in a MinHash band (ROWS minima
of their five-word shingles) are candidates; their shingle sets are compared exactly; connected nodes form a cluster, whose first paragraph (smallest document, then place) stays.
Of the others, runs of RUN words or more are removed: a short sentence that texts share by custom is left alone.

Passages are also found without regard to paragraphs. Of each WINDOW stretches of GRAM words that follow each other, the one with the smallest hash is an anchor, so every
passage of GRAM + WINDOW - 1 words (51) has an anchor that depends on nothing outside it. A copy is matched with its anchor's first place, word by word in both directions.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm import candidates as C
from kinelake.llm.common import U64, Scratch, components, lean, mix, pieces, sets, shingles, ship, utf8, words
from kinelake.llm.ngram_join import EVEN, SINGLE, SKETCHED, across, ends, frequent_filter

ship(__name__)

#: Words of a run that is removed. Bands and minima of each: paragraphs of similarity s meet with probability 1 - (1 - s**ROWS)**BANDS,
#: which is 0.997 at 0.8, 0.66 at 0.5 and 0.06 at 0.2.
RUN, BANDS, ROWS = 20, 8, 3
#: Turns in which the members that are still apart meet another pivot each, before they are compared with each other: more leave fewer to compare. Results don't depend on them.
TURNS = 2
SEEDS = mix(np.arange(101, 101 + BANDS * ROWS, dtype=U64)) | U64(1)
STEPS = mix(np.arange(201, 221, dtype=U64)) | U64(1)
#: Words of an anchor, and stretches of which one is an anchor: also the words that a match is extended by on either side, where the next anchor's match takes over.
GRAM, WINDOW = 20, 32
NONE = U64(0xFFFFFFFFFFFFFFFF)
DIGEST = U64(0xA0761D6478BD642F)
NAMES = (*C.ENTRY_NAMES, "d1", "d2", "doc", "t", "place")
LINE = "d1 long, d2 long, doc long, t long, place long"


def breaks(data: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First words of lines, and the number of words."""
    n = len(start)
    hard = np.zeros(n + 1, bool)  # a line starts at this word
    hard[first[:-1][np.diff(first) > 0]] = True
    hard[n] = True
    if n:
        feeds = np.flatnonzero(data == 10)
        lines = np.searchsorted(feeds, start)
        hard[1:n] |= lines[1:] != lines[:-1]
    return np.flatnonzero(hard)


def digests(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each line's words in order; at: first words, and the number of words."""
    place = np.arange(len(h), dtype=U64) - np.repeat(at[:-1], np.diff(at)).astype(U64)
    x = mix(h + place * DIGEST)
    return np.add.reduceat(x, at[:-1]), np.add.reduceat(mix(x ^ DIGEST), at[:-1])


def paragraphs(batch: pa.RecordBatch):
    """For pieces of a batch (id, t, text): (ids, t, text and place of each paragraph, shingles, their numbers, digests)."""
    batch = batch.filter(batch.column(0).is_valid())
    data, off = utf8(batch.column(2))
    ids, t = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64)
    for lo, hi in pieces(off):
        h, start, _, first = words(piece := data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        if not len(h):
            continue
        at = breaks(piece, start, first)
        text = np.searchsorted(first, at[:-1], "right") - 1
        s, count = shingles(h, at)
        yield ids[lo:hi][text], t[lo:hi][text], np.arange(len(text)) - np.searchsorted(text, text), s, count, *digests(h, at)


def banded(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of band signatures and local stars over nodes (a node's number is half of its digest), and a row (d1, d2, doc, t, place) for each paragraph."""

    def run(batches):
        signer = C.Signer(buckets, NAMES)
        for b in batches:
            for ids, t, place, s, count, d1, d2 in paragraphs(b):
                yield C.batch(NAMES, d1=d1.view(np.int64), d2=d2.view(np.int64), doc=ids, t=t, place=place)
                edge = np.cumsum(count) - count
                own = np.unique(d1, return_index=True)[1]
                node = d1[own].view(np.int64)
                for i in range(BANDS):
                    sig = np.full(len(own), i, U64)
                    for seed in SEEDS[i * ROWS : (i + 1) * ROWS]:
                        sig = mix(sig + np.minimum.reduceat(s * seed, edge)[own])
                    yield from signer.add(sig | U64(1), node, np.zeros(len(own), np.uint16))
        yield from signer.flush()

    return docs.select("id", "t", "text").mapInArrow(lean(run), f"{C.ENTRIES}, {LINE}")


def sets_of(docs: DataFrame, wanted) -> DataFrame:
    """(id, hashes, n, a sketch) of the nodes that pass a filter (broadcast): their ordered distinct shingles. A node may be given more than once."""
    kind = f"id long, hashes binary, n long, {', '.join(f'{c} long' for c in SKETCHED)}"

    def run(batches):
        known = C.Filter(*wanted.value)
        for b in batches:
            for _, _, _, s, count, d1, _ in paragraphs(b):
                own = np.unique(d1, return_index=True)[1]
                own = own[known.test(C.id_hash(d1[own].view(np.int64)))]
                if not len(own):
                    continue
                edge = np.cumsum(count) - count
                idx = np.concatenate([np.arange(edge[i], edge[i] + count[i]) for i in own])
                h, n = sets(s[idx], count[own])
                cut = np.concatenate([[0], np.cumsum(n)])
                sketch = C.sketches(h, n)
                cols = [pa.array(d1[own].view(np.int64)), pa.array([h[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary()), pa.array(n), *[pa.array(sketch[c]) for c in SKETCHED]]
                yield pa.RecordBatch.from_arrays(cols, ["id", "hashes", "n", *SKETCHED])

    return docs.select("id", "t", "text").mapInArrow(lean(run), kind)


def central(star: DataFrame) -> DataFrame:
    """(sig, pivot, id) with the member as pivot that meets most others over all its signatures: of copies with changes of their own, one with few changes, which links with most others.

    Signatures are counted, members' counts added up and the largest taken: aggregations that are pre-aggregated before their shuffles, and one row a member.
    """
    member = star.select("sig", "id").distinct()
    met = member.join(member.groupBy("sig").agg(F.count("*").alias("c")), "sig").groupBy("id").agg(F.sum("c").alias("met"))
    best = member.join(met, "id").groupBy("sig").agg(F.max(F.struct("met", "id")).alias("m"))
    return member.join(best, "sig").select("sig", F.col("m.id").alias("pivot"), "id")


def open_members(star: DataFrame, found: DataFrame) -> DataFrame:
    """(sig, pivot, id, component): members of signatures that hold more than one component."""
    member = star.join(found, "id")
    held = member.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    return member.join(held, "sig", "left_semi").select("sig", "pivot", "id", "component")


def rare_first(whole: DataFrame, often, percent: int, buckets: int) -> DataFrame:
    """Blocks and local stars of the rare shingles (even signatures) among the first that nodes need, rare ones first, and a row (id, d1: number of frequent shingles) for each node.

    Linked nodes of n shingles or more share `percent` of n at least, so the first shingle that they share, in the order of all, is not behind these of either.
    """

    def run(batches):
        signer, known = C.Signer(buckets, NAMES), C.Filter(*often.value)
        for b in batches:
            ids, sigs, rows, f = np.asarray(b.column(0), np.int64), [], [], []
            for i, x in enumerate(b.column(1)):
                h = np.frombuffer(x.as_buffer(), U64)
                rare = h[~known.test(h)]
                f.append(len(h) - len(rare))
                sigs.append(rare[: len(h) - -(-len(h) * percent // 100) + 1])
                rows.append(np.full(len(sigs[-1]), ids[i]))
            yield C.batch(NAMES, id=ids, d1=np.array(f, np.int64))
            if sigs:
                yield from signer.add(mix(np.concatenate(sigs) ^ SINGLE) & EVEN, np.concatenate(rows), np.zeros(sum(map(len, rows)), np.uint16))
        yield from signer.flush()

    return whole.select("id", "hashes").mapInArrow(lean(run), f"{C.ENTRIES}, {LINE}")


def cleanest(star: DataFrame, size: DataFrame, found: DataFrame, apart: bool) -> DataFrame:
    """star with another pivot: of each signature's members (apart: of those outside its pivot's component) the one with the largest share of frequent shingles, then the largest."""
    member = star.join(found, "id").join(size.select("id", (F.col("f") / F.col("n")).alias("share"), "n"), "id")
    if apart:
        main = member.groupBy("sig").agg(F.max(F.when(F.col("pivot") == F.col("id"), F.col("component"))).alias("main"))
        member = member.join(main, "sig")
        best = member.where("component <> main")
    else:
        best = member
    best = best.groupBy("sig").agg(F.max(F.struct("share", "n", "id", "component")).alias("m")).select("sig", F.col("m.id").alias("pivot"), F.col("m.component").alias("own"))
    return member.drop("pivot").join(best, "sig").select("sig", "pivot", "id", "component", "own")


def left_open(scratch: Scratch, star: DataFrame, found: DataFrame, whole: DataFrame, node: DataFrame, far: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Candidate pairs (a, b) that share a signature and that the pivots left in different components.

    Of the members that are still open, a shingle that more than FREQUENT of them hold is frequent, others are rare. Two members that share a rare shingle meet there, in a
    group of FREQUENT at most. Others first meet new pivots, in TURNS turns: the cleanest member of each signature, which of copies with changes of their own links with
    most; that is one row a member and turn. Two that share frequent shingles only can't share more than either has of them, which `across` asks of those that are still
    apart, before its join: copies with changes of their own, however many, mostly have too few left.
    """
    star = scratch.write(open_members(star, found))
    held = scratch.write(star.select("id", "component").distinct())
    sets_ = scratch.write(whole.select("id", "hashes").join(held, "id", "left_semi"))
    often = frequent_filter(sets_.select("hashes"), lambda b: (np.frombuffer(x.as_buffer(), U64) for x in b.column(0)), buckets)
    index = scratch.write(rare_first(sets_, often, percent, buckets))
    size = scratch.write(node.drop("f").join(index.where("d1 IS NOT NULL").select("id", F.col("d1").alias("f")), "id"))
    side = lambda k: size.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}{k}") for c in ("n", *SKETCHED)])
    bound = F.least(F.col("na") - C.alone("a", "b"), F.col("nb") - C.alone("b", "a"))
    star, out = star.select("sig", "pivot", "id"), []
    for turn in range(TURNS):
        led = scratch.write(cleanest(star, size, held, turn > 0))
        star = led.select("sig", "pivot", "id")
        pairs = led.where("component <> own").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
        bounds = scratch.write(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", bound.alias("most")))
        met = scratch.write(C.verified(bounds.where(C.similar(percent, "most")).select("a", "b"), sets_))
        far = far.union(met.select("a", "b", F.col("shared").alias("least"), F.col("shared").alias("most"))).union(bounds.where(~C.similar(percent, "most")).select("a", "b", F.lit(0).cast("long"), "most"))
        links = met.where(C.similar(percent)).select("a", "b")
        out.append(links)
        of = lambda k, held=held: held.select(F.col("id").alias(k), F.col("component").alias(f"c{k}"))
        ties = links.join(of("a"), "a").join(of("b"), "b").select("ca", "cb")
        # those that link with a pivot take its component; that some stay apart that a chain of links joins costs comparisons only
        top = ties.join(ties.select(F.col("ca").alias("cb")), "cb", "left_anti").groupBy(F.col("cb").alias("component")).agg(F.min("ca").alias("top"))
        held = scratch.write(held.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component")))
    rare = C.stars(scratch, index).join(held, "id").join(size.select("id", "n", *SKETCHED), "id").select("sig", "id", "component", "n", *SKETCHED).distinct()
    x, y = (rare.select("sig", *[F.col(c).alias(f"{c}{k}") for c in ("id", "component", "n", *SKETCHED)]) for k in "12")
    share = F.least(F.col("n1") - C.alone("1", "2"), F.col("n2") - C.alone("2", "1"))
    near = share * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent
    out.append(x.join(y, "sig").where((F.col("id1") < F.col("id2")) & (F.col("component1") != F.col("component2")) & near).select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    out.append(across(scratch, star, held, size, far, percent))
    return reduce(DataFrame.union, out).distinct()


def clusters(scratch: Scratch, docs: DataFrame, percent: int) -> DataFrame:
    """(id, t, gone): of each text, the paragraphs (p: place) that equal, or are linked with, an earlier one, and the document that keeps it (keep)."""
    buckets = C.buckets_of(docs.sparkSession)
    index = scratch.write(banded(docs, buckets))
    line = index.where("d1 IS NOT NULL").select("d1", "d2", "doc", "t", "place")
    star = scratch.write(central(scratch.write(C.stars(scratch, index))))
    scratch.release()
    pairs = scratch.write(star.where("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    wanted = ends(pairs)
    whole = scratch.write(sets_of(docs, C.filter_of(wanted)).join(wanted, "id", "left_semi").dropDuplicates(["id"]))
    scratch.release()
    node = whole.select("id", "n", F.col("n").alias("f"), F.xxhash64("hashes").alias("d1"), F.xxhash64(F.lit(1), "hashes").alias("d2"), *SKETCHED)
    side = lambda k: node.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), *[F.col(c).alias(f"{c}{k}") for c in SKETCHED])
    bound = F.least(F.col("na") - C.alone("a", "b"), F.col("nb") - C.alone("b", "a"))
    every = node.select("id")
    copies = node.groupBy("n", "d1", "d2").agg(F.min("id").alias("a"), F.count("*").alias("c")).where("c > 1").join(node, ["n", "d1", "d2"]).select("a", F.col("id").alias("b")).where("a <> b")
    # pairs that sketches rule out need no sets
    bounds = scratch.write(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", bound.alias("most")))
    met = scratch.write(C.verified(bounds.where(C.similar(percent, "most")).select("a", "b"), whole.select("id", "hashes")))
    far = met.select("a", "b", F.col("shared").alias("least"), F.col("shared").alias("most")).union(bounds.where(~C.similar(percent, "most")).select("a", "b", F.lit(0).cast("long"), "most"))
    links = scratch.write(copies.union(met.where(C.similar(percent)).select("a", "b")))
    found = scratch.write(components(scratch, every, links))
    scratch.release()
    rest = scratch.write(left_open(scratch, star, found, whole, node, far, percent, buckets))
    scratch.release()
    if not rest.isEmpty():
        more = scratch.write(C.verified(rest, whole.select("id", "hashes")).where(C.similar(percent)).select("a", "b"))
        found = scratch.write(components(scratch, every, links.union(more)))
    scratch.drop(whole)
    linked = found.join(found.where("id <> component").select("component").distinct(), "component").select(F.col("id").alias("d1"), "component")
    first = line.groupBy("d1", "d2").agg(F.min(F.struct("doc", "t", "place")).alias("f"), F.count("*").alias("c")).join(linked, "d1", "left").where("c > 1 OR component IS NOT NULL")
    first = scratch.write(first)
    best = first.where("component IS NOT NULL").groupBy("component").agg(F.min("f").alias("best"))
    keep = scratch.write(first.join(best, "component", "left").select("d1", "d2", F.coalesce("best", "f").alias("keep")))
    own = (F.col("doc") == F.col("keep.doc")) & (F.col("t") == F.col("keep.t")) & (F.col("place") == F.col("keep.place"))
    out = line.join(keep, ["d1", "d2"]).where(~own).groupBy(F.col("doc").alias("id"), "t").agg(F.collect_set(F.struct(F.col("place").alias("p"), F.col("keep.doc").alias("keep"))).alias("gone"))
    out = scratch.write(out)
    scratch.drop(index, first, keep)
    scratch.release()
    return out


def grams(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of GRAM words from each word on, NONE where its text ends before; and each text's number of them."""
    n = np.maximum(np.diff(first) - GRAM + 1, 0)
    g = np.full(len(h), NONE, U64)
    m = len(h) - GRAM + 1
    if m > 0:
        x = np.zeros(m, U64)
        for j in range(GRAM):
            x += h[j : j + m] * STEPS[j]
        g[:m] = mix(x)
    ok = np.zeros(len(h) + 1, np.int64)
    np.add.at(ok, first[:-1], n > 0)
    np.add.at(ok, first[:-1] + n, -(n > 0).astype(np.int64))
    g[np.cumsum(ok[:-1]) == 0] = NONE
    return g, n


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words at which anchors begin, and the anchors' hashes. A text of fewer stretches than WINDOW has the smallest of them."""
    g, n = grams(h, first)
    least = np.zeros(len(g), U64)  # of the window that begins here
    if len(g) >= WINDOW:
        x, w = g, 1
        while w < WINDOW:
            x = np.minimum(x[:-w], x[w:])
            w *= 2
        least[: len(x)] = x
    text = np.repeat(np.arange(len(n)), np.diff(first))
    at = np.arange(len(g)) - first[text]
    least[at + WINDOW > n[text]] = 0
    x, w = least, 1
    while w < WINDOW:  # the largest of the windows that hold this stretch
        x, w = np.maximum(x, np.concatenate([np.zeros(w, U64), x[:-w]])), w * 2
    own = (g == x[: len(g)]) & (at < n[text])
    for i in np.flatnonzero((n > 0) & (n < WINDOW)):
        a = first[i]
        own[a : a + n[i]] = g[a : a + n[i]] == g[a : a + n[i]].min()
    at = np.flatnonzero(own)
    return at, g[at]


def copied(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(id, t, near): of each text that holds anchors of an earlier place, for each anchor (sig, at: its places, keep: the first place's id, left, right: low halves of the hashes of the words around that)."""

    def anchored(b):
        b = b.filter(b.column(0).is_valid())
        data, off = utf8(b.column(2))
        ids, t = np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64)
        for lo, hi in pieces(off):
            h, _, _, first = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            if len(h):
                at, sig = anchors(h, first)
                text = np.searchsorted(first, at, "right") - 1
                yield h, first, at, text, sig.view(np.int64), ids[lo:hi][text], t[lo:hi][text]

    def run(batches):
        for b in batches:
            for _, first, at, text, sig, ids, t in anchored(b):
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(ids), pa.array(t), pa.array(at - first[text])], ["sig", "id", "t", "at"])

    def around(batches):
        known = C.Filter(*wanted.value)
        for b in batches:
            for h, first, at, text, sig, ids, t in anchored(b):
                own = np.flatnonzero(known.test(C.id_hash(sig ^ (at - first[text]))))
                low = (h & C.LOW).astype("<u4")
                left = [low[max(first[i], k - WINDOW) : k].tobytes() for k, i in zip(at[own], text[own])]
                right = [low[k + GRAM : min(first[i + 1], k + GRAM + WINDOW)].tobytes() for k, i in zip(at[own], text[own])]
                yield pa.RecordBatch.from_arrays([pa.array(sig[own]), pa.array(ids[own]), pa.array(t[own]), pa.array((at - first[text])[own]), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["sig", "keep", "kt", "from", "left", "right"])

    texts = docs.select("id", "t", "text")
    all_ = scratch.write(texts.mapInArrow(lean(run), "sig long, id long, t long, at long"))
    first = all_.groupBy("sig").agg(F.min(F.struct("id", "t", "at")).alias("f"), F.count("*").alias("c")).where("c > 1").select("sig", F.col("f.id").alias("keep"), F.col("f.t").alias("kt"), F.col("f.at").alias("from"))
    first = scratch.write(first)
    # the words around first places, from those texts again: a filter of (anchor, place) tells which anchors are wanted
    wanted = C.filter_of(first.select(F.col("sig").bitwiseXOR(F.col("from")).alias("id")))
    context = texts.mapInArrow(lean(around), "sig long, keep long, kt long, `from` long, left binary, right binary")
    context = scratch.write(first.join(context, ["sig", "keep", "kt", "from"]).dropDuplicates(["sig"]))
    member = all_.join(first, "sig").where("id <> keep OR t <> kt OR at <> from").groupBy("id", "t", "sig", "keep").agg(F.collect_set("at").alias("at"))
    out = scratch.write(member.join(context.select("sig", "left", "right"), "sig").groupBy("id", "t").agg(F.collect_list(F.struct("sig", "at", "keep", "left", "right")).alias("near")))
    scratch.drop(all_, first, context)
    scratch.release()
    return out


def matched(h: np.ndarray, g: np.ndarray, near: list) -> list[tuple[int, int, list[int]]]:
    """(first word, end, documents kept) of the copies in a text of words h: anchors that really lie there, extended while the words are equal."""
    low, out = (h & C.LOW).astype("<u4"), []
    for x in near:
        left, right = np.frombuffer(x["left"], "<u4"), np.frombuffer(x["right"], "<u4")
        for k in x["at"]:
            if k + GRAM > len(h) or int(g[k : k + 1].view(np.int64)[0]) != x["sig"]:
                continue
            n = min(k, len(left))
            off = np.flatnonzero(low[k - n : k][::-1] != left[::-1][:n])
            a = k - (int(off[0]) if len(off) else n)
            z = k + GRAM
            n = min(len(h) - z, len(right))
            off = np.flatnonzero(low[z : z + n] != right[:n])
            out.append((a, z + (int(off[0]) if len(off) else n), [x["keep"]]))
    return out


SPANS = "start_char long, end_char long, n_words long, keep_doc_id long, keep_doc_ids array<long>"


def spans(scratch: Scratch, docs: DataFrame, percent: int = 80, run_words: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, start_char, end_char, n_words, keep_doc_id, keep_doc_ids): every stretch to remove, in code points, and the documents that keep its paragraphs.

    Paragraphs link when they are equal word by word (A-Z as a-z), or share a band and the Jaccard similarity of their sets of distinct five-word shingles (all words where fewer)
    is percent/100 or more; clusters are connected components; their smallest (id, text hash, place) stays. Copies of anchors are removed with the words around that equal those of the
    anchor's first place. What is removed and overlaps or follows each other forms a stretch, given if it has run_words words or more; keep_doc_id is that of its first part.
    Null and empty texts have no paragraphs; a very long text or line is one row and is worked on whole; rows with a null id take no part. Texts are told by id and a hash of the text: rows
    that repeat both are one text, whose stretches are given for each of the rows, and other texts under the same id are documents of their own. Any long is an id. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    by = clusters(scratch, docs, percent).join(copied(scratch, docs), ["id", "t"], "full")

    def run(batches):
        for b in batches:
            data, off = utf8(b.column(1))
            out = []
            for lo, hi in pieces(off):
                piece, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                h, start, end, first = words(piece, o)
                g, _ = grams(h, first)
                edges = breaks(piece, start, first)
                lead = np.searchsorted(edges, first)  # each text's first line, by its first word
                chars = np.concatenate([[0], np.cumsum((piece & 0xC0) != 0x80)])
                for i in range(hi - lo):
                    w = int(first[i])
                    parts = [(a + w, z + w, keep) for a, z, keep in matched(h[w : first[i + 1]], g[w : first[i + 1]], b.column(3)[lo + i].as_py() or ())]
                    for x in b.column(2)[lo + i].as_py() or ():
                        k = int(lead[i]) + x["p"]
                        if k < lead[i + 1]:
                            parts.append((int(edges[k]), int(edges[k + 1]), [x["keep"]]))
                    runs: list[list] = []
                    for a, z, keep in sorted(parts):
                        if runs and runs[-1][1] >= a:
                            runs[-1][1] = max(runs[-1][1], z)
                            runs[-1][2] += keep
                        else:
                            runs.append([a, z, list(keep)])
                    for a, z, keep in runs:
                        if z - a >= run_words:
                            out.append((b.column(0)[lo + i].as_py(), int(chars[start[a]] - chars[o[i]]), int(chars[end[z - 1]] - chars[o[i]]), int(z - a), keep[0], sorted(set(keep))))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "start_char", "end_char", "n_words", "keep_doc_id", "keep_doc_ids"])

    return docs.join(by, ["id", "t"]).select("id", "text", "gone", "near").mapInArrow(lean(run), f"id long, {SPANS}").withColumnRenamed("id", id_col)


def removed(docs: DataFrame, stretches: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the stretches (of spans()) cut out of their texts; other rows and columns stay as they are."""
    by = stretches.groupBy(F.col(id_col).alias("__id")).agg(F.array_sort(F.collect_set(F.struct(F.col("start_char").cast("int").alias("s"), F.col("end_char").cast("int").alias("e")))).alias("__cut"))
    d = docs.join(by, F.col(id_col) == F.col("__id"), "left")
    text = F.col(text_col)
    step = lambda acc, x: F.struct(x.e.alias("at"), F.concat(acc.out, F.substring(text, acc.at + 1, x.s - acc.at)).alias("out"))
    new = F.aggregate("__cut", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a.out, F.substring(text, a.at + 1, F.length(text))))
    return d.withColumn(text_col, F.when(F.col("__cut").isNotNull(), new).otherwise(text)).drop("__id", "__cut")
