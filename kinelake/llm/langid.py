"""Language identification by a convolutional network over bytes.

Bytes are folded to 64 classes; filters of several widths slide over them; each filter's maximum over a window goes to a softmax over the languages.
Training runs in numpy over windows of a bounded sample of labelled texts; prediction covers every whole text in windows of a fixed length, in batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import lean, pieces, ship, utf8

ship(__name__)

#: Bytes of a window (the last of a text may overlap the one before), filter widths, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: The bounded training sample: texts a language, languages, windows a text; passes, batch, rate.
SAMPLE, LANGUAGES, WINDOWS, EPOCHS, BATCH, RATE = 400, 64, 4, 12, 64, 0.03
CLASSES = 64
UNDETERMINED = "und"


def folded() -> np.ndarray:
    """Byte classes: 0 padding and blanks, letters without case, digits, other ASCII; of other bytes the low five bits, which leave out the case of Latin letters, and leads."""
    c = np.zeros(256, np.int16)
    c[65:91] = c[97:123] = np.arange(1, 27)
    c[48:58] = 27
    c[[i for i in range(33, 127) if not c[i]]] = 28
    c[128:192] = 29 + (np.arange(64) & 31)
    c[192:224], c[224:240], c[240:] = 61, 62, 63
    return c


FOLD = folded()


def init(labels: list[str], seed: int = 7) -> dict:
    r = np.random.RandomState(seed)
    return {"labels": labels, "w": [r.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS], "b": [np.zeros(FILTERS, np.float32) for _ in WIDTHS], "out": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32), "bias": np.zeros(len(labels), np.float32)}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, labels: list[str], seed: int = 7) -> dict:
    """x: byte classes, windows by WINDOW; y: positions in labels. Adam on the cross-entropy; a filter's gradient goes to its place of maximum."""
    m = init(labels, seed)
    parts = [*m["w"], *m["b"], m["out"], m["bias"]]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    r, step, nw = np.random.RandomState(seed), 0, len(WIDTHS)
    for _ in range(EPOCHS if len(labels) > 1 else 0):
        order = r.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            own = order[lo : lo + BATCH]
            xb, n = x[own], len(own)
            pooled, places = [], []
            for w, f, b in zip(WIDTHS, m["w"], m["b"]):
                z = sum(f[j][xb[:, j : WINDOW - w + 1 + j]] for j in range(w))
                at = z.argmax(1)
                places.append(at)
                pooled.append(np.tanh(np.take_along_axis(z, at[:, None], 1)[:, 0] + b))
            h = np.concatenate(pooled, 1)
            d = softmax(h @ m["out"] + m["bias"])
            d[np.arange(n), y[own]] -= 1
            d /= n
            grads = [np.zeros_like(p) for p in parts]
            grads[2 * nw], grads[2 * nw + 1] = h.T @ d, d.sum(0)
            back = (d @ m["out"].T) * (1 - h * h)
            for i, (w, at) in enumerate(zip(WIDTHS, places)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[nw + i] = g.sum(0)
                for j in range(w):
                    np.add.at(grads[i][j], (np.take_along_axis(xb, at + j, 1), np.arange(FILTERS)[None]), g)
            step += 1
            for p, g, a, b in zip(parts, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (1 - step / (EPOCHS * (len(x) / BATCH + 1))) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


class Model:
    """The trained network with the filters' tables laid out for pairs of classes."""

    def __init__(self, m: dict):
        self.labels, self.m = m["labels"], m
        a, b = np.divmod(np.arange(CLASSES * CLASSES), CLASSES)
        w2, w3, w4 = m["w"]
        self.head = np.concatenate([w2[0][a] + w2[1][b], w3[0][a] + w3[1][b], w4[0][a] + w4[1][b]], 1)
        self.tail = np.concatenate([w4[2][a] + w4[3][b]], 1)
        self.third = w3[2]
        self.bias = np.concatenate(m["b"])

    def windows(self, c: np.ndarray) -> np.ndarray:
        """Log probabilities of windows of byte classes."""
        out = np.empty((len(c), len(self.labels)), np.float32)
        for lo in range(0, len(c), 64):
            x = c[lo : lo + 64].astype(np.int32)
            pair = x[:, :-1] * CLASSES + x[:, 1:]
            z = self.head[pair]
            k = FILTERS
            two = z[:, :, :k].max(1)
            three = (z[:, :-1, k : 2 * k] + self.third[x[:, 2:]]).max(1)
            four = (z[:, :-2, 2 * k :] + self.tail[pair[:, 2:]]).max(1)
            h = np.tanh(np.concatenate([two, three, four], 1) + self.bias)
            out[lo : lo + 64] = np.log(softmax(h @ self.m["out"] + self.m["bias"]) + 1e-9)
        return out

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Label (-1 without letters) and score of each row: the windows' mean log probability, renormalised."""
        n = np.diff(off)
        c = FOLD[data].astype(np.uint8)
        count = np.maximum(1, -(-n // WINDOW))
        row = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = off[:-1][row] + np.minimum(k * WINDOW, np.maximum(0, n[row] - WINDOW))
        padded = np.concatenate([c, np.zeros(WINDOW, np.uint8)])
        x = padded[start[:, None] + np.arange(WINDOW)]
        short = np.flatnonzero(n < WINDOW)
        for i in short[np.isin(short, row)]:
            x[np.searchsorted(row, i), n[i] :] = 0
        p = np.zeros((len(n), len(self.labels)))
        np.add.at(p, row, self.windows(x))
        p = softmax(p / count[:, None])
        return p.argmax(1), p.max(1)


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> dict | None:
    """Trains on at most `sample` labelled texts of each of the LANGUAGES commonest labels, chosen by a hash of the id, with WINDOWS windows spread over each whole text.

    Rows with a null label or text are left out; without any labelled text there is no model (None). What reaches the driver is bounded by these parameters.
    """
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(label_col).count().orderBy(F.desc("count"), label_col).limit(LANGUAGES).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, 1.5 * sample / n))])
    unit = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 24)) / float(1 << 24)
    some = known.where(unit <= F.coalesce(F.try_element_at(share, F.col(label_col)), F.lit(0.0))).select(F.col(label_col).cast("string").alias("y"), F.col(text_col).alias("t"))

    def cut(batches):
        for b in batches:
            data, off = utf8(b.column("t"))
            xs, ys = [], []
            for y, a, z in zip(b.column("y").to_pylist(), off[:-1], off[1:]):
                for i in range(min(WINDOWS, max(1, -(-int(z - a) // WINDOW)))):
                    at = a + i * max(0, z - a - WINDOW) // max(1, WINDOWS - 1)
                    w = np.zeros(WINDOW, np.uint8)
                    part = FOLD[data[at : min(z, at + WINDOW)]]
                    w[: len(part)] = part
                    xs.append(w.tobytes())
                    ys.append(y)
            if xs:
                yield pa.RecordBatch.from_pydict({"y": ys, "x": xs})

    rows = sorted((r["y"], bytes(r["x"])) for r in some.mapInArrow(lean(cut), "y string, x binary").limit(2 * sample * WINDOWS * len(sizes)).collect())
    labels = sorted({y for y, _ in rows})
    if not labels:
        return None
    return train(np.array([np.frombuffer(x, np.uint8) for _, x in rows]).astype(np.int64), np.array([labels.index(y) for y, _ in rows]), labels)


def predict(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1) to every row, from its whole text alone.

    Null texts and texts without a letter are `und` with score 0, as are all texts without a model; columns named lang_pred or score are replaced; other
    columns pass through. A map over the scan: no shuffle.
    """
    docs = docs.drop("lang_pred", "score")
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    kept = docs.withColumn("__letters", letters)
    names = kept.columns
    held: list[Model] = []

    def run(batches):
        if not held and model:
            held.append(Model(model))
        for b in batches:
            data, off = utf8(b.column(names.index(text_col)))
            has = b.column(len(names) - 1).to_pylist()
            pred, score = [], []
            for lo, hi in pieces(off):
                if held:
                    label, p = held[0](data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    pred += [held[0].labels[i] for i in label]
                    score += p.tolist()
                else:
                    pred += [UNDETERMINED] * (hi - lo)
                    score += [0.0] * (hi - lo)
            pred = [p if h else UNDETERMINED for p, h in zip(pred, has)]
            score = [s if h else 0.0 for s, h in zip(score, has)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names[:-1], "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    out = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return kept.mapInArrow(lean(run), out)


def held_out(id_col: str = "doc_id", parts: int = 5):
    """Whether the CRC-32 of the id as text leaves no remainder by `parts`; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == 0, F.lit(True))


def identify(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "lang") -> DataFrame:
    """Trains on the rows that aren't held out and predicts every row; see fit() and predict()."""
    model = fit(docs.where(~held_out(id_col)), id_col=id_col, text_col=text_col, label_col=label_col)
    return predict(docs, model, text_col)
