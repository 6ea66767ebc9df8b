import hashlib
import random
import struct
import zlib

import pytest

from kinelake.llm import packing, pieces
from kinelake.llm.queries import tokenizer_file

ODD = ["", " ", "  ", "a  b", " a", "a ", "▁", "▁▁a ▁b", "é́\n\n x", "\x00a b", "日本 語", " \n ", "a b\xa0c", "😀 😀😀", " " * 40 + "x", "<|endoftext|> A<|ENDOFTEXT|>", "fΣİ.\tςé́a>", "don't I'M 12.5,x", "x" * 3000]


def texts():
    r = random.Random(4)
    return [*ODD, *("".join(r.choice(" ab▁\n\té日😀.,  xA'S5\x1c\xa0Σς<|>") for _ in range(r.randrange(30))) for _ in range(2000)), " ".join(f"word{r.randrange(99)}" for _ in range(20000))]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(tokenizer_file("piece_bpe_32k.model"))


def test_pieces_equal_the_library(codec):
    ts = texts()
    for t, (n, ids, out) in zip(ts, codec.digests(ts)):
        want = codec.whole.encode(t)
        assert (n, ids, out) == (len(want), ",".join(map(str, want)), codec.whole.decode(want))


def test_spans_cover_the_source(codec):
    for t in texts()[:600]:
        ids, p, spans = codec.encode(t)
        assert ids == codec.whole.encode(t) and len(p) == len(spans)
        data = t.encode()
        assert "".join(data[a:b].decode("utf-8", "ignore") for a, b in spans if b > a) == t or any(codec.sp.is_byte(i) for i in ids)
        assert all(a <= b for a, b in spans) and all(x[1] <= y[0] or x[1] == y[1] for x, y in zip(spans, spans[1:]))
        assert not spans or (spans[0][0] == 0 and spans[-1][1] == len(data))


def test_digests_come_from_the_alignment_path(codec, monkeypatch):
    ts, seen, whole = texts()[:200], [], codec.normalise
    monkeypatch.setattr(codec, "normalise", lambda t: seen.append(t) or whole(t))
    want = codec.digests(ts)
    assert seen == ts and [",".join(map(str, ids)) for ids, _, _, _ in codec.encoded(ts)] == [ids for _, ids, _ in want]
    monkeypatch.setattr(codec, "normalise", lambda t: (whole(t)[0], whole(t)[1][1:]))
    with pytest.raises(ValueError):
        codec.digests(["a wrong alignment"])


def double_array(entries):
    """A compiled map of byte prefixes to replacements, built by placing each trie node at the first free base."""
    out = b"\0".join(v for _, v in entries) + b"\0"
    at, values = 0, {}
    for k, v in entries:
        values[k] = at
        at += len(v) + 1
    trie = {}
    for k in values:
        node = trie
        for c in k:
            node = node.setdefault(c, {})
        node[None] = values[k]
    units, used = [0] * 4096, {0}

    def place(node, pos):
        marks = [0 if c is None else c for c in node]
        base = next(b for b in range(256, 4000) if all((b ^ m) not in used for m in marks) and ((b ^ pos) < 1 << 21))
        used.update(b ^ m for b in [base] for m in marks)
        units[pos] |= (base ^ pos) << 10 | (256 if None in node else 0)
        if None in node:
            units[base] = 1 << 31 | node[None]
        for c, child in node.items():
            if c is not None:
                units[base ^ c] = c
                place(child, base ^ c)

    place(trie, 0)
    blob = struct.pack("<4096I", *units)
    return struct.pack("<I", len(blob)) + blob + out


def test_longest_prefix_normalisation_keeps_offsets():
    m = pieces.Charsmap(double_array([(b"a", b"A"), (b"ab", b"X"), ("ﬁ".encode(), b"fi"), (b"abc", "é".encode()), (b"\t", b" ")]))
    assert m.longest(b"abd", 0) == (2, b"X") and m.longest(b"abcd", 0) == (3, "é".encode()) and m.longest(b"xa", 1) == (1, b"A") and m.longest(b"x", 0) is None

    class Spec:
        class normalizer_spec:
            precompiled_charsmap = double_array([(b"a", b"A"), (b"ab", b"X"), ("ﬁ".encode(), b"fi"), (b"\t", b" ")])
            add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = True, True, True

        class trainer_spec:
            treat_whitespace_as_suffix = False

    out, at = pieces.Normalizer(Spec)(" \tab ﬁ  z ")
    assert out == "▁X▁fi▁z"
    assert list(at) == [2, 2, 2, 2, 4, 4, 4, 5, 5, 8, 8, 8, 10, 12]


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, "ab cd", 5), (1, None, 6), (None, "", 7)], "doc_id long, text string, ids long")
    model = tokenizer_file("piece_bpe_32k.model")
    got = sorted(map(tuple, pieces.encode(df, model, digests=True).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert (1, 0, empty, empty) in got and (None, 0, empty, empty) in got and len(got) == 3
    full = pieces.encode(df, model).where("doc_id = 1 AND decoded <> ''").first()
    assert full.decoded == "ab cd" and full.ends[-1] == 5
    assert pieces.encode(df.limit(0), model, digests=True).collect() == []


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_file("word_bpe_49k.json").decode())


def test_word_memory_equals_the_tokenizer(encoder):
    import numpy as np

    ts = texts()
    for t, got in zip(ts, encoder([t.encode() for t in ts])):
        assert got == np.array(encoder.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_packing_places_every_id_once(spark, docs, corpus, encoder):
    small = docs.union(docs.where("doc_id = 5"))
    rows = packing.packed(small, tokenizer_file("word_bpe_49k.json").decode(), shard_docs=64).collect()
    ids = {i: encoder([(t or "").encode()])[0] + b"\1\0\0\0" for i, t in corpus}
    seqs, per = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per.setdefault(r.doc_id, []).append((r.start, r.length))
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(ids[r.doc_id]) // 4
    for parts in seqs.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end == 2048 or end & (end - 1) == 0 and end < 2048
    for i, parts in per.items():
        assert sum(n for _, n in parts) == len(ids[i]) // 4 * (2 if i == 5 else 1)
    assert set(per) == set(ids)
    assert packing.packed(docs.limit(0), tokenizer_file("word_bpe_49k.json").decode()).collect() == []


def test_neighbours_equal_plain_bm25():
    from collections import Counter
    from math import log1p

    import numpy as np

    r = np.random.RandomState(2)
    topic = [r.randint(2, 4000, 200) + 4000 * k for k in range(5)]
    ids = [np.append(r.choice(topic[i % 5], r.randint(1, 200)), r.randint(30000, 30040, r.randint(0, 80))) for i in range(50)] + [np.zeros(0, np.int64), np.array([7, 30000])]
    ids.append(ids[3])
    count = [Counter(i.tolist()) for i in ids]
    df = Counter(t for c in count for t in c)
    table = packing.rarity(np.bincount(list(df), list(df.values()), 40000), len(ids))
    mean = sum(map(len, ids)) / len(ids)
    index = packing.Shard(ids, table, mean)
    for d, c in enumerate(count):
        score = {}
        for e, o in enumerate(count):
            if e != d and c.keys() & o.keys():
                score[e] = sum(log1p((len(ids) - df[t] + 0.5) / (df[t] + 0.5)) * o[t] * 2.2 / (o[t] + 1.2 * (0.25 + 0.75 * len(ids[e]) / mean)) for t in c if t in o)
        got = index.neighbours(d).tolist()
        assert set(got) == set(score)
        assert all(score[x] >= score[y] - 1e-9 for x, y in zip(got, got[1:]))


def test_copies_meet_from_anywhere(spark):
    """Copies that lie 400 documents apart, with shards of 50, share their sequences, but for those of which one was used up as another seed's neighbour."""
    r = random.Random(4)
    text = [" ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('klmnp')}{r.randrange(5000)}" for _ in range(60)) for _ in range(400)]
    docs = spark.createDataFrame([(i, text[i % 400]) for i in range(800)], "doc_id long, text string").repartitionByRange(4, "doc_id")
    of = {}
    for row in packing.packed(docs, tokenizer_file("word_bpe_49k.json").decode(), shard_docs=50).collect():
        of.setdefault(row.doc_id, set()).add(row.sequence_id)
    assert sum(bool(of[i] & of[i + 400]) for i in range(400)) >= 300
