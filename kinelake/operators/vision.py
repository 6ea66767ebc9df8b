"""Kernels on frames and detections: colour grids, scene descriptors, copied footage, detection suppression, body yaw."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def grid(rgb: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """The nearest pixels of a coarser grid."""
    h, w = rgb.shape[:2]
    return rgb[(np.arange(rows) * h // rows)[:, None], (np.arange(cols) * w // cols)[None]]


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue 0..1, saturation and value 0..255."""
    x = rgb.astype(float)
    hi, lo = x.max(-1), x.min(-1)
    d = hi - lo
    safe = np.where(d == 0, 1, d)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    h = np.where(hi == r, ((g - b) / safe) % 6, np.where(hi == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    return np.stack([np.where(d == 0, 0, h), np.where(hi == 0, 0, d / np.where(hi == 0, 1, hi) * 255), hi], -1)


def hsv_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Mean of the wrapped hue difference (in 255ths), saturation and value differences, over a third each."""
    d = np.abs(hsv(a) - hsv(b))
    d[..., 0] = np.minimum(d[..., 0], 1 - d[..., 0]) * 255
    return float(d.sum(-1).mean() / 3)


def view_descriptor(rgb: np.ndarray, rows: int = 9, cols: int = 16) -> np.ndarray:
    """Mean colours of a grid of cells, 0..1; empty where the picture is dark or flat."""
    h, w = rgb.shape[:2]
    x = rgb.astype(float) / 255
    ys, xs = np.arange(rows + 1) * h // rows, np.arange(cols + 1) * w // cols
    out = np.array([[x[ys[i] : max(ys[i] + 1, ys[i + 1]), xs[j] : max(xs[j] + 1, xs[j + 1])].mean((0, 1)) for j in range(cols)] for i in range(rows)])
    return np.zeros(0) if out.mean() < 0.035 or out.var() < 0.0004 else out.ravel()


def without_bars(rgb: np.ndarray, dark: int = 16) -> np.ndarray:
    """Without the dark bars that lie alike at the top and bottom, or at both sides."""
    lit = rgb.max(-1) > dark
    for axis in (1, 0):
        line = lit.any(axis)
        if line.any():
            k = min(int(np.argmax(line)), int(np.argmax(line[::-1])))
            if 0 < k < len(line) // 3:
                rgb = rgb[k : len(line) - k] if axis == 1 else rgb[:, k : len(line) - k]
                lit = rgb.max(-1) > dark
    return rgb


def colour_histogram(rgb: np.ndarray, border: float = 0.25) -> np.ndarray:
    """44 bins over the border of a picture: 12 hues by 3 saturations weigh 0.75, 8 values 0.25."""
    h, w = rgb.shape[:2]
    mask = np.ones((h, w), bool)
    mask[int(h * border) : h - int(h * border), int(w * border) : w - int(w * border)] = False
    c = hsv(rgb)[mask]
    a = np.minimum((c[:, 0] * 12).astype(int), 11) * 3 + np.minimum((c[:, 1] / 256 * 3).astype(int), 2)
    b = np.minimum((c[:, 2] / 256 * 8).astype(int), 7)
    return np.concatenate([0.75 * np.bincount(a, minlength=36), 0.25 * np.bincount(b, minlength=8)]) / max(1, len(c))


def same_camera(a: np.ndarray, b: np.ndarray, limit: float = 0.035) -> bool:
    """Two view descriptors (rows x columns x 3) are one camera's if they differ little at a shift of at most one column."""
    if a.size == 0 or a.shape != b.shape:
        return False
    x, y = a.reshape(9, 16, 3), b.reshape(9, 16, 3)
    return min(float(np.abs(x[:, max(0, s) : 16 + min(0, s)] - y[:, max(0, -s) : 16 - max(0, s)]).mean()) for s in (-1, 0, 1)) <= limit


def copied(a: np.ndarray, b: np.ndarray, run: int = 3, limit: float = 0.02, mirror: bool = True) -> bool:
    """Two sequences of view descriptors share `run` frames in a row that are equal up to a gain (0.8 to 1.25) and a bias (at most 0.1), mirrored or not."""

    def equal(x, y):
        mx, my = x.mean(), y.mean()
        v = float(((x - mx) ** 2).sum())
        gain = float(((x - mx) * (y - my)).sum()) / v if v > 1e-9 else 1.0
        bias = my - gain * mx
        return 0.8 <= gain <= 1.25 and abs(bias) <= 0.1 and float(np.abs(gain * x + bias - y).mean()) <= limit

    forms = [b] + ([b.reshape(len(b), 9, 16, 3)[:, :, ::-1].reshape(len(b), -1)] if mirror and b.shape[1] == 432 else [])
    for y in forms:
        ok = np.array([[equal(p, q) for q in y] for p in a])
        for i in range(len(a) - run + 1):
            for j in range(len(y) - run + 1):
                if all(ok[i + k, j + k] for k in range(run)):
                    return True
    return False


def nms(box: np.ndarray, score: np.ndarray, limit: float) -> list[int]:
    """Greedy suppression of boxes (x, y, w, h), best first: a box falls to a kept one that it overlaps by `limit` or more."""
    kept: list[int] = []
    for i in np.lexsort((np.arange(len(score)), -score)):
        a, ok = box[i], True
        for k in kept:
            b = box[k]
            w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
            inter = max(0, w) * max(0, h)
            union = a[2] * a[3] + b[2] * b[3] - inter
            if union > 0 and inter / union >= limit:
                ok = False
                break
        if ok:
            kept.append(int(i))
    return kept


def decoded(raw: np.ndarray, least: float, scale: float, pad_x: float, pad_y: float, limit: float = 0.45) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boxes (x, y, w, h), scores and joints from a pose network's rows (cx, cy, w, h, score, 17 joints of x, y, c; channels first or last): threshold, undone
    letterbox, suppression."""
    rows = raw.T if raw.shape[0] == 56 and raw.shape[1] != 56 else raw
    rows = rows[rows[:, 4] >= least]
    box = np.stack([(rows[:, 0] - rows[:, 2] / 2 - pad_x) / scale, (rows[:, 1] - rows[:, 3] / 2 - pad_y) / scale, rows[:, 2] / scale, rows[:, 3] / scale], 1)
    joints = rows[:, 5:].reshape(len(rows), -1, 3).copy()
    joints[..., 0], joints[..., 1] = (joints[..., 0] - pad_x) / scale, (joints[..., 1] - pad_y) / scale
    keep = nms(box, rows[:, 4], limit)
    return box[keep], rows[keep, 4], joints[keep]


def suppressed_detections(rows: DataFrame, limit: float = 0.45) -> DataFrame:
    """rows (source, t, id, x, y, w, h, score) that survive suppression within their frame."""

    def run(p):
        return p.iloc[sorted(nms(p[["x", "y", "w", "h"]].to_numpy(), p.score.to_numpy(), limit))]

    return rows.groupBy("source", "t").applyInPandas(run, rows.schema)


def rotation_excursion(r: np.ndarray) -> float:
    """Largest geodesic distance, in degrees, between any two of some 3x3 rotations."""
    trace = np.einsum("aij,bij->ab", r, r)
    return float(np.degrees(np.arccos(np.clip((trace - 1) / 2, -1, 1))).max()) if len(r) else 0.0
