"""Streaming forms: sessions of a source's events, tracker state, and incremental refresh of stored results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """(source, s, e, n, total) of sessions that a gap ends; works on a stream (rows later than `late` are dropped) and on a table."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.session_window("ts", gap)
    return x.groupBy("source", w.alias("w")).agg(F.count("*").alias("n"), F.sum("v").alias("total")).select("source", F.col("w.start").alias("s"), F.col("w.end").alias("e"), "n", "total")


def windowed(events: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    """Counts in sliding windows."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy("source", F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n")).select("source", F.col("w.start").alias("s"), F.col("w.end").alias("e"), "n")


TRACKS = "source long, event_id long, track long"
STATE = "next long, tracks array<struct<track:long,x:double,y:double,t:double>>"


def tracks(detections: DataFrame, timeout: float, reach: float, idle: str = "1 hour") -> DataFrame:
    """Track numbers for a stream of detections (source, event_id, t, x, y): the nearest live track within `reach` takes a detection, each once a frame; tracks not
    seen for `timeout` seconds retire. State is kept per source, so micro-batches carry on where the last one ended; the state of a
    source without detections for `idle` (by the clock) goes."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        nxt, held = state.get if state.exists else (0, [])
        live = {r["track"] if isinstance(r, dict) else r[0]: tuple(r.values() if isinstance(r, dict) else r)[1:] for r in held}
        rows = pd.concat(list(parts)).sort_values(["t", "event_id"], kind="stable")
        out = []
        for t, frame in rows.groupby("t", sort=True):
            live = {k: v for k, v in live.items() if t - v[2] <= timeout}
            pairs = sorted((((x - v[0]) ** 2 + (y - v[1]) ** 2, e, k, x, y) for e, x, y in zip(frame.event_id, frame.x, frame.y) for k, v in live.items()), key=lambda p: p[:3])
            done, busy = {}, set()
            for d, e, k, x, y in pairs:
                if d <= reach * reach and e not in done and k not in busy:
                    done[e] = k
                    busy.add(k)
            for e, x, y in zip(frame.event_id, frame.x, frame.y):
                if e not in done:
                    done[e], nxt = nxt, nxt + 1
                live[done[e]] = (float(x), float(y), float(t))
                out.append((key[0], int(e), int(done[e])))
        state.update((int(nxt), [(int(k), *v) for k, v in live.items()]))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["source", "event_id", "track"])

    return detections.groupBy("source").applyInPandasWithState(step, TRACKS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def refreshed(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs `write` on every available micro-batch and ends; write must replace what a repeated batch number wrote, which makes the whole exactly-once."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
