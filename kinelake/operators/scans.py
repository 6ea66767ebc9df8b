"""Sequential scans of one source's timeline: sampling, thinning, chunks, cuts, fades, reversals, tracking. Each depends on its own earlier choices, so it is a
fold over a source's rows in time, one source a task group."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sampled(t: np.ndarray, step: float) -> np.ndarray:
    """Positions kept at a fixed cadence: the next due time moves on by whole steps, so it doesn't drift; a jump past it starts anew."""
    out, due = [], -np.inf
    for i, x in enumerate(t):
        if x + 1e-9 >= due:
            out.append(i)
            due = x + step if not np.isfinite(due) or x - due > step else due + step
    return np.array(out, int)


def thinned(t: np.ndarray, apart: float) -> np.ndarray:
    """Positions kept greedily at least `apart` seconds from the last kept one."""
    out: list[int] = []
    for i, x in enumerate(t):
        if not out or x - t[out[-1]] >= apart - 1e-9:
            out.append(i)
    return np.array(out, int)


def chunks(t: np.ndarray, window: float, stride: float, least: float, gap: float) -> list[tuple[int, int]]:
    """Sliding windows anchored to the data: within stretches without a gap, a window starts at the first frame a stride after the last start and takes the frames up to its
    length; kept if it spans `least` seconds. Ranges of positions, the end exclusive."""
    out = []
    edges = [0, *(np.flatnonzero(np.diff(t) > gap) + 1).tolist(), len(t)]
    for a, z in zip(edges[:-1], edges[1:]):
        due = -np.inf
        for i in range(a, z):
            if t[i] + 1e-9 < due:
                continue
            j = int(np.searchsorted(t[:z], t[i] + window + 1e-9))
            if j > i and t[j - 1] - t[i] >= least - 1e-9:
                out.append((i, j))
            due = t[i] + stride
    return out


def _median(x) -> float:
    x = sorted(x)
    return x[len(x) // 2] if x else 0.0


def hard_cuts(delta: np.ndarray, threshold: float, spacing: int = 8, multiplier: float = 3.0) -> list[int]:
    """Positions of cuts, at least `spacing` frames apart. delta[i] is the change from frame i - 1; delta[0] is none.

    A change at the threshold is a cut if it stands out: no past yet, `multiplier` times the median of the last five changes since the last cut, or times the next three's and 1.5 times
    the change before (a cut from a moving shot into a quiet one), or twice the threshold and beyond both medians by their spread (a cut between two moving shots). A change at
    half the threshold is one if it stands out against both sides (a cut between alike pictures).
    """
    spread = lambda x, mid: _median([abs(v - mid) for v in x])
    out, past, since = [], [], spacing
    for i in range(1, len(delta)):
        d, after = delta[i], delta[i + 1 : i + 4]
        before, ahead = (_median(past) if past else d), _median(after)
        jump = i <= 1 or d >= 1.5 * delta[i - 1]
        outlier = len(after) >= 2 and d >= multiplier * ahead and jump
        noise = max(0.25 * threshold, spread(past, before), spread(after, ahead))
        steady = multiplier > 0 and len(past) >= 3 and len(after) >= 2 and d >= 2 * threshold and d >= max(before, ahead) + multiplier * noise and d >= 1.5 * delta[i - 1]
        stands_out = multiplier == 0 or not (past or out) or d >= multiplier * before or outlier or steady
        alike = bool(past) and outlier and d >= multiplier * before and d >= 0.5 * threshold
        if stands_out and (d >= threshold or alike) and since >= spacing:
            out.append(i)
            past, since = [], 1
        else:
            past, since = [*past[-4:], d], since + 1
    return out


def fades(level: np.ndarray, least: float, most_gap: int = 1) -> list[tuple[int, int]]:
    """Runs of steady rise or fall whose accumulated change reaches `least`: (first, last) positions."""
    out, a = [], 0
    step = np.sign(np.diff(level))
    for i in range(1, len(step) + 1):
        if i == len(step) or step[i] != step[a]:
            if step[a] != 0 and abs(level[i] - level[a]) >= least and i - a > most_gap:
                out.append((a, i))
            a = i
    return out


def reversals(x: np.ndarray, prominence: float) -> int:
    """Turns of a zig-zag whose legs are at least `prominence` long."""
    turns, way, top = 0, 0, x[0] if len(x) else 0.0
    for v in x[1:]:
        if way == 0:
            if abs(v - top) >= prominence:
                way, top = (1 if v > top else -1), v
        elif (v - top) * way > 0:
            top = v
        elif (top - v) * way >= prominence:
            way, top, turns = -way, v, turns + 1
    return turns


def tracked(t: np.ndarray, box: np.ndarray, timeout: float = 1.0, least: float = 0.3) -> np.ndarray:
    """Track numbers of detections (t, box x y w h): per frame a greedy one-to-one assignment by overlap and closeness to each live track's last box; a track that
    isn't seen for `timeout` seconds retires."""
    out, last, seen, n = np.full(len(t), -1), {}, {}, 0
    order = np.argsort(t, kind="stable")
    for x in np.unique(t):
        own = [i for i in order if t[i] == x]
        live = [k for k in last if x - seen[k] <= timeout]
        cand = []
        for i in own:
            for k in live:
                a, b = box[i], last[k]
                w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
                inter = max(0.0, w) * max(0.0, h)
                union = a[2] * a[3] + b[2] * b[3] - inter
                size = np.sqrt(max(a[2] * a[3], b[2] * b[3], 1e-9))
                d = np.hypot(a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2)
                s = 0.7 * (inter / union if union > 0 else 0) + 0.3 * np.exp(-2.5 * d / size)
                if s >= least:
                    cand.append((-s, i, k))
        taken, busy = set(), set()
        for _, i, k in sorted(cand):
            if i not in taken and k not in busy:
                out[i] = k
                taken.add(i)
                busy.add(k)
        for i in own:
            if out[i] < 0:
                out[i], n = n, n + 1
            last[out[i]], seen[out[i]] = box[i], x
    return out


def per_source(rows: DataFrame, schema: str, fold, order: list[str]) -> DataFrame:
    """fold(pandas rows of one source in order) -> pandas rows, for every source."""
    return rows.groupBy("source").applyInPandas(lambda p: fold(p.sort_values(order, kind="stable").reset_index(drop=True)), schema)
