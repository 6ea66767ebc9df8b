"""Packing by lexical retrieval: each window starts with a seed document and is filled by the unused neighbours that a BM25 index returns for it.

Document frequencies, lengths and their mean are counted over all documents. The index is sharded by content: documents are sorted by minima of hashes of their
terms (token ids), so that documents with many terms in common meet wherever they lie in the input, and every task cuts its sorted range into shards of bounded size, indexes a
shard's terms in an inverted file and packs the shard. Documents are cut where a window ends; the last window of a shard is split at powers of two, so nothing is padded.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import U64, Scratch, lean, mix, pieces, ship, words

ship(__name__)

#: Tokens of a window; documents and tokens of a shard; minima that documents are sorted by; BM25's constants.
WINDOW, SHARD_DOCS, SHARD_TOKENS, MINIMA, K1, B = 2048, 1024, 1 << 22, 4, 1.2, 0.75
#: Distinct words that a worker remembers (forgotten together when they become more), and slots of its hash table.
REMEMBERED, SLOTS = 1 << 20, 1 << 22


def keeper() -> dict:
    """What a Python worker keeps from one task to the next (this module is shipped anew with each task). It holds one encoder at most, whose memory of words is bounded."""
    import sys
    import types

    return sys.modules.setdefault("_kept_by_packing", types.ModuleType("_kept_by_packing")).__dict__.setdefault("kept", {})


class Encoder:
    """Ids of whole texts.

    The tokenizer's tokens never hold blanks, so each run of other characters is encoded once and remembered: texts are cut and hashed as arrays (words()), and words
    are looked up in an open hash table of 64-bit hashes, A-Z as a-z, as the tokenizer lowers them anyway. A full stop or comma after an ASCII letter or digit is a pre-token of its
    own. New words of letters alone are one pre-token each: they are encoded as one text and told apart by the tokens that end a word. Texts that hold "<|", where special
    tokens may begin, go to the tokenizer whole.
    """

    def __init__(self, spec: str):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        own = json.loads(spec)
        model = own["model"]
        kinds = [p["type"] for p in (own.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        #: the same model over blank-separated lower-case words, without the general normaliser and pre-tokenizer
        split = [{"type": "WhitespaceSplit"}, *[p for p in (own.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "ByteLevel"]]
        self.fast = Tokenizer.from_str(json.dumps(own | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": split}, "added_tokens": []})) if kinds == ["Split", "ByteLevel"] else self.tok
        suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self.alnum = np.zeros(256, bool)
        self.alnum[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        self.forget()

    def forget(self) -> None:
        """Empties the memory. Entries 0 and 1 are the full stop and the comma; entry k's ids are flat[edge[k]:edge[k + 1]]."""
        self.keys, self.entry = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        stops = [np.frombuffer(x, "<u4") for x in self.single([".", ","])]
        self.flat, self.used = np.zeros(1 << 20, "<u4"), 0
        self.edge, self.n = np.zeros(REMEMBERED + (1 << 18), np.int64), 0
        for x in stops:
            self.append(x, np.array([len(x)]))

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        while self.n + len(sizes) + 1 > len(self.edge):
            self.edge = np.concatenate([self.edge, np.zeros_like(self.edge)])
        self.edge[self.n + 1 : self.n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.n = self.used + len(ids), self.n + len(sizes)

    @staticmethod
    def plain(s: str) -> bool:
        """Only Latin letters, in lower case too: characters that every Unicode version knows as letters."""
        return s.isalpha() and (s.isascii() or max(s) < "\u0250" and s.lower().isalpha())

    def single(self, words: list[str]) -> list[bytes]:
        return [np.array(g.ids, "<u4").tobytes() for g in self.tok.encode_batch_fast(words, add_special_tokens=False)] if words else []

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters alone, and each word's number of them."""
        ids = np.array(self.fast.encode_batch_fast([" ".join(words).lower()], add_special_tokens=False)[0].ids, "<u4")
        edge = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        if len(edge) != len(words):
            got = self.single(words)
            return np.frombuffer(b"".join(got), "<u4"), np.array([len(g) // 4 for g in got])
        return ids, np.diff(edge, prepend=0)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entries of words, -1 for new ones. Slots are probed one after another until the key or an empty one."""
        out, left, slot = np.full(len(h), -1, np.int32), np.arange(len(h)), (h & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            k = self.keys[slot]
            hit = k == h[left]
            out[left[hit]] = self.entry[slot[hit]]
            more = ~hit & (k != 0)
            left, slot = left[more], (slot[more] + 1) & (SLOTS - 1)
        return out

    def insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        left, slot = np.arange(len(h)), (h & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.entry[slot[won]] = h[left[won]], entry[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & (SLOTS - 1)

    def learn(self, h: np.ndarray, new: list[bytes]) -> None:
        letters, odd = [], []
        for i, w in enumerate(new):
            if w.isalpha():
                letters.append((i, w.decode()))
            else:
                s = w.decode("utf-8", "replace")
                (letters if self.plain(s) else odd).append((i, s))
        first = self.n
        if letters:
            self.append(*self.joined([s for _, s in letters]))
        if odd:
            got = self.single([s for _, s in odd])
            self.append(np.frombuffer(b"".join(got), "<u4"), np.array([len(g) // 4 for g in got]))
        self.insert(h[[i for i, _ in [*letters, *odd]]], np.arange(first, self.n, dtype=np.int32))

    def piece(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, one after another, and where each text's begin (one more at the end)."""
        mark = None

        def trim(start, end):
            nonlocal mark
            last = data[end - 1]
            mark = ((last == 46) | (last == 44)) & (end - start > 1) & self.alnum[data[np.maximum(end - 2, 0)]]
            return end - mark

        h, start, end, first = words(data, off, trim)
        if not len(h):
            return np.zeros(0, "<u4"), np.zeros(len(off), np.int64)
        h |= np.uint64(1)  # 0 stands for an empty slot
        got = self.find(h)
        lacking = np.flatnonzero(got < 0)
        if len(lacking):
            new, at = np.unique(h[lacking], return_index=True)
            if self.n + len(new) > REMEMBERED:
                self.forget()
                lacking = np.arange(len(h))
                new, at = np.unique(h, return_index=True)
            at, raw = lacking[at], data.tobytes()
            self.learn(new, [raw[a:z] for a, z in zip(start[at].tolist(), end[at].tolist())])
            got[lacking] = self.find(h[lacking])
        count = 1 + mark
        place = np.cumsum(count) - count
        entry = np.empty(int(count.sum()), np.int64)
        entry[place] = got
        entry[place[mark] + 1] = (data[end[mark]] == 44).astype(np.int64)
        size = self.edge[entry + 1] - self.edge[entry]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.edge[entry] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.append(place, len(entry))[first]]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        easy = [i for i, t in enumerate(texts) if b"<|" not in t]
        for i in set(range(len(texts))).difference(easy):
            out[i] = self.single([texts[i].decode("utf-8", "replace")])[0]
        off = np.cumsum([0, *[len(texts[i]) for i in easy]])
        data = np.frombuffer(b"".join([texts[i] for i in easy]), np.uint8)
        for lo, hi in pieces(off):
            ids, at = self.piece(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            blob, at = ids.tobytes(), (at * 4).tolist()
            for k in range(hi - lo):
                out[easy[lo + k]] = blob[at[k] : at[k + 1]]
        return out


def counted(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    v = np.sort(v, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    return v[first], np.diff(np.append(first, len(v)))


def rarity(df: np.ndarray, n: int) -> np.ndarray:
    """BM25's inverse document frequency of terms that df of n documents hold."""
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Shard:
    """An inverted file over a shard's documents with BM25 weights; documents are numbered from 0. idf and mean (of the lengths) are those of all documents."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        terms = [counted(i) for i in ids]
        size = np.array([len(i) for i in ids], np.float64)
        term, tf = np.concatenate([t for t, _ in terms]), np.concatenate([c for _, c in terms])
        own = np.array([len(t) for t, _ in terms])
        doc = np.repeat(np.arange(len(ids)), own)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(1.0, mean)))
        slot_df = counted(term)[1]
        by = np.argsort(term, kind="stable")
        self.slot = np.empty(len(term), np.int64)
        self.slot[by] = np.repeat(np.arange(len(slot_df)), slot_df)
        self.edge = np.concatenate([[0], np.cumsum(own)])
        # terms that a quarter of the shard holds are rows of a matrix, at most four times as large as their postings; the others' postings are gathered
        wide = slot_df > max(1, len(ids) // 4)
        self.row = np.where(wide, np.cumsum(wide) - 1, -1)
        self.matrix, common = np.zeros((int(wide.sum()), len(ids))), wide[self.slot]
        self.matrix[self.row[self.slot[common]], doc[common]] = weight[common]
        own = by[~common[by]]
        self.df = np.where(wide, 0, slot_df)
        self.first = np.cumsum(self.df) - self.df
        self.doc, self.weight, self.n, self.held = doc[own], weight[own], len(ids), len(ids)

    def drop(self, alive: np.ndarray) -> None:
        """Forgets the postings of documents that are used up; those of others keep their weights."""
        own = alive[self.doc]
        slot = np.repeat(np.arange(len(self.df)), self.df)[own]
        self.doc, self.weight, self.held = self.doc[own], self.weight[own], int(alive.sum())
        self.df = np.bincount(slot, minlength=len(self.df))
        self.first = np.cumsum(self.df) - self.df

    def neighbours(self, doc: int) -> np.ndarray:
        """Other documents with a positive score for all of the document's terms, best first, ties by number."""
        t = self.slot[self.edge[doc] : self.edge[doc + 1]]
        common = self.row[t]
        score = self.matrix[common[common >= 0]].sum(0)
        t = t[self.df[t] > 0]
        if len(t):
            size = self.df[t]
            end = np.cumsum(size)
            at = np.repeat(self.first[t] - end + size, size) + np.arange(end[-1])
            score += np.bincount(self.doc[at], self.weight[at], self.n)
        score[doc] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack(ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard; ids holds each document's tokens, the last of which is the end id and no term."""
    out, seq = [], 0
    start = [0] * len(ids)
    for d, i in enumerate(ids):
        for _ in range(len(i) // window):
            out.append((d, start[d], window, seq, 0))
            start[d], seq = start[d] + window, seq + 1
    left = np.array([len(i) - s for i, s in zip(ids, start)])
    index = Shard([i[:-1] for i in ids], idf, mean) if (left > 0).any() else None
    seeds = list(np.argsort(-left, kind="stable"))
    tail: list[tuple[int, int, int]] = []
    alive = int((left > 0).sum())
    for at, seed in enumerate(seeds):
        while left[seed] > 0:
            took, room = [], window

            def take(d):
                nonlocal room, alive
                n = int(min(room, left[d]))
                took.append((int(d), start[d], n))
                start[d] += n
                left[d] -= n
                room -= n
                alive -= int(left[d] == 0)

            take(seed)
            if room:
                if 2 * alive < index.held:
                    index.drop(left > 0)
                near = index.neighbours(seed)
                near = near[left[near] > 0]
                rest = left[near].tolist()
                least = min(rest, default=0)
                for d, n in zip(near.tolist(), rest):  # whole rests first
                    if room < least or not room:
                        break
                    if n <= room:
                        take(d)
                if room:  # then the nearest is cut
                    near = near[left[near] > 0]
                    if len(near):
                        take(near[0])
            k = at + 1
            while room and k < len(seeds):  # no neighbour is left: the next seeds
                if left[seeds[k]] > 0:
                    take(seeds[k])
                k += 1
            if room:
                tail = took
                break
            offset = 0
            for d, s, n in took:
                out.append((d, s, n, seq, offset))
                offset += n
            seq += 1
    total = sum(n for _, _, n in tail)
    sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
    offset = 0
    for d, s, n in tail:
        while n:
            m = min(n, sizes[0] - offset)
            out.append((d, s, m, seq, offset))
            s, n, offset = s + m, n - m, offset + m
            if offset == sizes[0]:
                sizes, offset, seq = sizes[1:], 0, seq + 1
    return out


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, spec: str, end: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(key, row, a, b, n, ids, df) and the bound of the ids. A row for each document: its id, a number of its own, its sorting keys, its number of ids (the end id included), and them;
    and a row for each task: the number of its documents that hold each id, the end ids left out."""
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_str(spec).get_vocab(True).values(), default=0) + 1
    size = max(size, end + 1)
    kind, sent = "<u2" if size <= 1 << 16 else "<u4", docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept, name = keeper(), hashlib.sha256(sent.value.encode()).digest()
        if name not in kept:
            kept.clear()
            kept[name] = Encoder(sent.value)
        row, df = TaskContext.get().partitionId() << 40, np.zeros(size, np.int64)
        lots = [(mix(np.arange(1, size + 1, dtype=U64) * U64(2 * j + 3)) >> U64(33)).astype(np.int64) for j in range(MINIMA)]
        for batch in batches:
            for lo in range(0, len(batch), 128):
                part = batch.slice(lo, 128)
                ids = [np.frombuffer(x, "<u4") for x in kept[name](part.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist())]
                own = [counted(i.astype(kind))[0] for i in ids]
                n = np.array([len(t) for t in own])
                term, full = np.concatenate(own), np.flatnonzero(n)
                df += np.bincount(term, minlength=size)
                low = np.zeros((MINIMA, len(n)), np.int64)
                if len(full):
                    first = (np.cumsum(n) - n)[full]
                    for j, lot in enumerate(lots):
                        low[j, full] = np.minimum.reduceat(lot[term], first)
                blobs = [np.append(i, end).astype(kind).tobytes() for i in ids]
                yield pa.RecordBatch.from_pydict({
                    "key": part.column(0), "row": pa.array(np.arange(row, row + len(n))), "a": pa.array(low[0] << 31 | low[1]), "b": pa.array(low[2] << 31 | low[3]),
                    "n": pa.array([len(i) + 1 for i in ids], pa.int64()), "ids": pa.array(blobs, pa.binary()), "df": pa.nulls(len(n), pa.binary()),
                })
                row, key = row + len(n), part.column(0).type
        if df.any():
            none = {c: pa.nulls(1, pa.int64()) for c in ("row", "a", "b", "n")}
            yield pa.RecordBatch.from_pydict({"key": pa.nulls(1, key), **none, "ids": pa.nulls(1, pa.binary()), "df": pa.array([df.tobytes()], pa.binary())})

    key = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"key {key}, row long, a long, b long, n long, ids binary, df binary"), size


def frequencies(index: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each id; what reaches the driver is bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "c"])

    out = np.zeros(size, np.int64)
    for r in index.where("df IS NOT NULL").select("df").mapInArrow(run, "term int, c long").groupBy("term").agg(F.sum("c").alias("c")).collect():
        out[r["term"]] = r["c"]
    return out


def packed(docs: DataFrame, spec: str, end: int = 1, window: int = WINDOW, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the ids (of the tokenizer whose JSON is `spec`, without special tokens, then the id `end`) of all documents into sequences of at most `window`.

    Returns a row for each piece: the id column, start (ids of its document before it), length, ids_crc32 (of its ids as little-endian unsigned 32-bit
    integers), doc_tokens, sequence_id (unique over all tasks) and offset in the sequence, gapless from 0. Each id lies in exactly one piece. Null and empty
    texts are the end id alone; repeated and null ids are documents of their own; other columns are ignored; an empty table gives no rows.

    A seed's neighbours are all documents of its shard with a term in common. A shard is a run of `shard_docs` documents at most in the order of MINIMA minima of hashes of their sets of
    terms: two documents agree in one with the probability of their sets' Jaccard similarity. Documents that differ in the first minima lie in different shards and do not meet.
    Ties in that order go by a number that each document is given once, so a group of copies of any size is dealt over several tasks.
    """
    index, size = encoded(docs, spec, end, id_col, text_col)
    spark = docs.sparkSession
    index = Scratch(spark).write(index)
    df, kind = frequencies(index, size), "<u2" if size <= 1 << 16 else "<u4"
    rows = index.where("row IS NOT NULL").select("key", "a", "b", "row", "n", "ids")
    whole = rows.agg(F.count("*").alias("n"), F.sum(F.col("n") - 1).alias("tokens")).first()
    sent = spark.sparkContext.broadcast((rarity(df, whole["n"]), (whole["tokens"] or 0) / max(1, whole["n"])))
    names = [id_col, *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batches):
        from pyspark import TaskContext

        keeper().clear()  # all texts are encoded
        base, (idf, mean) = TaskContext.get().partitionId() << 34, sent.value
        keys, blobs, tokens = [], [], 0

        def flush():
            nonlocal base
            ids = [np.frombuffer(b, kind) for b in blobs]
            rows = pack(ids, idf, mean, window)
            crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in rows]
            cols = [pa.array(x, pa.int64()) for x in zip(*((s, n, c, len(ids[d]), base + q, o) for (d, s, n, q, o), c in zip(rows, crc)))]
            base += max(r[3] for r in rows) + 1
            return pa.RecordBatch.from_arrays([pa.array([keys[r[0]] for r in rows]).cast(key_type), *cols], names)

        for b in batches:
            key_type = b.schema.field(0).type
            for lo in range(0, len(b), 128):
                part = b.slice(lo, 128)
                for k, blob, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    keys.append(k)
                    blobs.append(blob)
                    tokens += n
                    if len(keys) >= shard_docs or tokens >= SHARD_TOKENS:
                        yield flush()
                        keys, blobs, tokens = [], [], 0
        if keys:
            yield flush()

    order = ("a", "b", "row")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "ids", "n")
    return dealt.mapInArrow(lean(run), f"`{id_col}` {dict(docs.select(id_col).dtypes)[id_col]}, {SCHEMA}")
