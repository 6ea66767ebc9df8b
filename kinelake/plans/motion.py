"""Queries that run numeric kernels and sequential scans; SQL cannot express them, tests hold the kernels against plain versions."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.operators import motion, scans, selection, similarity
from kinelake.plans.base import DAY, intervals, query, timeline, vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@query()
def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three days, a new one a day, broken at gaps of two days."""

    def fold(p):
        t = p.t.to_numpy()
        c = scans.chunks(t, 3 * DAY, DAY, DAY, 2 * DAY)
        return pd.DataFrame({"source": [p.source[0]] * len(c), "s": [t[a] for a, _ in c], "e": [t[z - 1] for _, z in c], "frames": [z - a for a, z in c]}).astype({"source": "int64", "s": "float64", "e": "float64", "frames": "int64"})

    return scans.per_source(timeline(spark, sf_dir), "source long, s double, e double, frames long", fold, ["t", "event_id"])


def _marked(name: str, mark):
    def fold(p):
        keep = np.asarray(mark(p.t.to_numpy(), p.v.to_numpy()), int)
        return p.iloc[keep][["source", "event_id", "t"]]

    fold.__name__ = name
    return fold


@query()
def fixed_cadence_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.per_source(timeline(spark, sf_dir), "source long, event_id long, t double", _marked("sampled", lambda t, v: scans.sampled(t, DAY)), ["t", "event_id"])


@query()
def thinned_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.per_source(timeline(spark, sf_dir), "source long, event_id long, t double", _marked("thinned", lambda t, v: scans.thinned(t, DAY)), ["t", "event_id"])


@query()
def adaptive_cut_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = lambda t, v: scans.hard_cuts(np.abs(np.diff(v, prepend=v[:1])), 40.0, 4)
    return scans.per_source(timeline(spark, sf_dir), "source long, event_id long, t double", _marked("cuts", cuts), ["t", "event_id"])


@query()
def soft_fade_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fold(p):
        f = scans.fades(p.v.to_numpy(), 60.0)
        t = p.t.to_numpy()
        return pd.DataFrame({"source": [p.source[0]] * len(f), "s": [t[a] for a, _ in f], "e": [t[z] for _, z in f]}).astype({"source": "int64", "s": "float64", "e": "float64"})

    return scans.per_source(timeline(spark, sf_dir), "source long, s double, e double", fold, ["t", "event_id"])


@query()
def zigzag_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fold(p):
        return pd.DataFrame({"source": [p.source[0]], "turns": [scans.reversals(p.v.to_numpy(), 30.0)], "n": [len(p)]})

    return scans.per_source(timeline(spark, sf_dir), "source long, turns long, n long", fold, ["t", "event_id"])


@query()
def tracked_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections of boxes, several people a source; tracks retire after a day."""

    def fold(p):
        box = np.stack([p.v.to_numpy(), p.v.to_numpy() * 0.5, np.full(len(p), 20.0), np.full(len(p), 20.0)], 1)
        return p.assign(track=scans.tracked(p.t.to_numpy(), box, DAY))[["source", "event_id", "track"]]

    return scans.per_source(timeline(spark, sf_dir), "source long, event_id long, track long", fold, ["t", "event_id"])


@query()
def greedy_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = intervals(spark, sf_dir).select("source", "id", "s", "e", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("score"))
    return selection.suppressed(i, "source", 0.35, DAY).select("source", "id", "score")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the shot of their left vector. Shots are a number for each vector, so they go to the pairs, of which there are many for each vector, and pairs are not shuffled for them."""
    shot = vectors(spark, sf_dir).select(F.col("id").alias("i"), F.col("shot").alias("g"))
    return similarity.pairs_above(vectors(spark, sf_dir), 0.3).join(F.broadcast(shot), "i").select("g", "i", "j", "score")


@query()
def quota_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair for each endpoint, with re-pairing."""
    return selection.with_quota(_scored(spark, sf_dir), "g", 1)


@query()
def diverse_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scored(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "i", "j"))).where("n <= 60").drop("n")
    return selection.diversified(x.withColumn("fa", F.col("i") % 7).withColumn("fb", F.col("j") % 7), "g", "fa", "fb")


@query()
def continuity_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tour of each shot's vectors by nearest neighbours."""

    def run(p):
        p = p.sort_values("id").reset_index(drop=True)
        order = selection.continuity_order(np.stack(p.v.to_numpy()).astype(float))
        return pd.DataFrame({"shot": p["shot"], "id": p["id"].to_numpy()[order], "place": np.arange(1, len(p) + 1)})

    return vectors(spark, sf_dir).groupBy("shot").applyInPandas(run, "shot int, id long, place long")


def _skeletons(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A made-up window of 16 frames from a vector: joints swing about a standing figure."""
    t = np.arange(16) / 10.0
    base = np.array([(0, -2.2), (-0.1, -2.3), (0.1, -2.3), (-0.2, -2.2), (0.2, -2.2), (-0.5, -1.6), (0.5, -1.6), (-0.7, -1), (0.7, -1), (-0.8, -0.4), (0.8, -0.4), (-0.3, 0), (0.3, 0), (-0.3, 1), (0.3, 1), (-0.3, 2), (0.3, 2)])
    swing = v[:34].reshape(17, 2)
    xy = base[None] + np.sin(2 * np.pi * (t[:, None, None] * (1 + abs(v[40])) + v[41])) * swing[None] * 2
    return t, np.concatenate([xy * 100 + 300, np.full((16, 17, 1), 0.9)], 2)


@query()
def dtw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of windows verified by warping, alignment and direction; features join the pairs only here, just before the kernel."""
    pairs = similarity.capped_neighbours(vectors(spark, sf_dir), per_shot=1, k=2, least=0.3)
    v = vectors(spark, sf_dir)
    x = pairs.join(v.select(F.col("id").alias("left_id"), F.col("v").alias("a")), "left_id").join(v.select(F.col("id").alias("right_id"), F.col("v").alias("b")), "right_id")

    def run(parts):
        for p in parts:
            rows = []
            for i, j, a, b in zip(p.left_id, p.right_id, p.a, p.b):
                ta, ka = _skeletons(np.asarray(a, float))
                tb, kb = _skeletons(np.asarray(b, float))
                rows.append({"left_id": i, "right_id": j, **motion.compared(ta, ka, tb, kb)})
            yield pd.DataFrame(rows, columns=["left_id", "right_id", "score", "dtw", "temporal", "direction", "shape", "active", "run", "mirrored"])

    schema = "left_id long, right_id long, score double, dtw double, temporal double, direction double, shape double, active double, run long, mirrored boolean"
    return x.select("left_id", "right_id", "a", "b").mapInPandas(run, schema)
