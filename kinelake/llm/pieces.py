"""SentencePiece encoding that keeps offsets, and decoding.

Text is normalised here: at every place the longest prefix found in the model's compiled character map is replaced, blanks become the model's blank
mark, and every normalised byte remembers the source byte it came from. The normalised text is then segmented by the library under a copy of the model
without a normaliser, so each piece projects through the alignment to a span of source bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinelake.llm.common import Memory, lean, ship

ship(__name__)

BLANK = "▁"
#: Distinct words that a worker remembers, and the longest word (characters) that it remembers.
REMEMBERED, LONGEST = 250_000, 64


class Charsmap:
    """The compiled character map: a double-array trie of prefixes whose values are offsets of null-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.out = blob[4 + size :] if blob else b""
        self.first = frozenset(c for c in range(256) if self.units and self._step(self._base(0, 0), c) is not None)

    def _base(self, node: int, unit: int | None = None) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))

    def _step(self, base: int, c: int) -> int | None:
        node = base ^ c
        return node if node < len(self.units) and self.units[node] & ((1 << 31) | 0xFF) == c else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of data[at:] in the map."""
        found, base = None, self._base(0)
        for i in range(at, len(data)):
            node = self._step(base, data[i])
            if node is None:
                break
            base = self._base(node)
            if self.units[node] >> 8 & 1:
                v = self.units[base] & 0x7FFFFFFF
                found = i + 1 - at, self.out[v : self.out.index(b"\0", v)]
        return found


class Normalizer:
    def __init__(self, proto):
        n = proto.normalizer_spec
        self.map, self.dummy, self.squeeze, self.escape = Charsmap(n.precompiled_charsmap), n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.starts = np.zeros(256, bool)
        self.starts[list(self.map.first)] = True

    def mapped(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The text with the longest prefix replaced at every place, and the source byte of each byte."""
        out, at, i = [], [], 0
        while i < len(data):
            hit = self.map.longest(data, i) if data[i] in self.map.first else None
            if hit:
                n, new = hit
            else:
                n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                new = data[i : i + n]
            out += new
            at += [i] * len(new) if hit else range(i, i + n)
            i += n
        return np.array(out, np.uint8), np.array(at, np.int64)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its UTF-8 bytes (and its end) the source byte it stands for."""
        data = text.encode("utf-8", "replace")
        out = np.frombuffer(data, np.uint8)
        if self.map.first and self.starts[out].any():
            out, at = self.mapped(data)
        else:  # no prefix of the map begins anywhere
            at = np.arange(len(out))
        if self.squeeze:
            keep = out != 32
            keep[1:] |= out[:-1] != 32
            out, at = out[keep], at[keep]
            if len(out) and out[-1] == 32:
                out, at = out[:-1], at[:-1]
        if self.dummy and len(out):
            if self.suffix:
                out, at = np.append(out, np.uint8(32)), np.append(at, len(data))
            else:
                out, at = np.insert(out, 0, 32), np.insert(at, 0, at[0])
        text = out.tobytes()
        if self.escape:
            at = np.repeat(at, np.where(out == 32, 3, 1))
            text = text.replace(b" ", BLANK.encode())
        return text.decode(), np.append(at, len(data))


#: A word with the blank marks before it, or marks at the end.
UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Codec:
    """Encodes and decodes with one model. Words are encoded one at a time and remembered where no piece holds a blank mark after another character."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.normalise = Normalizer(proto)
        pieces = [p.piece for p in proto.pieces if p.type in (1, 4)]
        self.by_word = proto.trainer_spec.model_type == 2 and BLANK in pieces and not any(BLANK in p.lstrip(BLANK) for p in pieces) and not any(p.type == 4 for p in proto.pieces)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = proto.normalizer_spec
        n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = b"", False, False, False
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.memory = Memory(REMEMBERED, LONGEST)
        self.pieces = [p.piece for p in proto.pieces]
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self.byte = np.array([p.type == 6 for p in proto.pieces])
        self.size = np.where(self.byte, 1, [len(p.encode()) for p in self.pieces]).astype("<i4")

    def learn(self, units: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """For each unit, its ids and how many normalised bytes each stands for, as 32-bit integers."""
        known = {}
        for u, i in zip(units, self.sp.encode(units, num_threads=1)):
            i = np.array(i, "<i4")
            n = self.size[i]
            if (i == self.sp.unk_id()).any():
                n = np.where(self.byte[i], 1, [len(p.surface.encode()) for p in self.sp.encode(u, return_type="proto").pieces]).astype("<i4")
            known[u] = i.tobytes(), n.tobytes()
        return known

    def encoded(self, texts: list[str | None]):
        """Of each text: ids, pieces, and where the span of source bytes of each starts and ends. Every text is normalised whole, then cut in units that no piece crosses."""
        norms = [self.normalise(t or "") for t in texts]
        split = [UNIT.findall(n) if self.by_word else [n] if n else [] for n, _ in norms]
        for (_, at), got in zip(norms, self.memory.look(split, self.learn)):
            ids = np.frombuffer(b"".join([g[0] for g in got]), "<i4").tolist()
            edge = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(np.frombuffer(b"".join([g[1] for g in got]), "<i4"), out=edge[1:])
            if edge[-1] != len(at) - 1:
                raise ValueError("the pieces do not cover the normalised text")
            place = at[edge]
            yield ids, [self.pieces[i] for i in ids], place[:-1], place[1:]

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, their decimals joined by commas, and the decoded text."""
        rows = [ids for ids, _, _, _ in self.encoded(texts)]
        return [(len(i), ",".join([self.decimals[k] for k in i]), out) for i, out in zip(rows, self.whole.decode(rows, num_threads=1) if rows else [])]

    def encode(self, text: str | None) -> tuple[list[int], list[str], list[tuple[int, int]]]:
        """Ids, pieces, and each piece's span of source bytes."""
        ids, pieces, start, end = next(self.encoded([text]))
        return ids, pieces, list(zip(start.tolist(), end.tolist()))

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "ids array<int>, pieces array<string>, starts array<int>, ends array<int>, decoded string"


def encode(docs: DataFrame, model: bytes, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text whole with a SentencePiece model (its file's bytes), without begin or end ids, and decodes the ids again.

    Returns the id and, with digests, n_tokens and SHA-256 digests of the ids (decimals joined by commas) and of the decoded text; else ids, pieces, their
    spans of source bytes [starts, ends) and the decoded text. Null text is empty: no ids, empty decoded text. One row for each input row, repeated and null
    ids included; other columns are left out. A map over the scan: no shuffle, nothing held but a word memory of bounded size.
    """
    held: list[Codec] = []

    def run(batches):
        if not held:
            held.append(Codec(model))
        codec, sha = held[0], hashlib.sha256
        for b in batches:
            for lo in range(0, len(b), 128):
                part = b.slice(lo, 128)
                texts = part.column(1).to_pylist()
                if digests:
                    rows = [(n, sha(ids.encode()).hexdigest(), sha(out.encode()).hexdigest()) for n, ids, out in codec.digests(texts)]
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    got = list(codec.encoded(texts))
                    ints = pa.list_(pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([g[0] for g in got], ints), pa.array([g[1] for g in got], pa.list_(pa.string())), pa.array([g[2].tolist() for g in got], ints), pa.array([g[3].tolist() for g in got], ints), pa.array([codec.decode(g[0]) for g in got], pa.string())],
                        [id_col, "ids", "pieces", "starts", "ends", "decoded"],
                    )

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, {DIGESTS if digests else TOKENS}")
