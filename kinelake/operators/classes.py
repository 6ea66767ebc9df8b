"""Labels of movements, postures and views as column expressions over measured scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def measured(walk: Column, run: Column, sit: Column, stand: Column, margin: float = 0.1) -> Column:
    """The action whose score is high enough and leads its rival; null if none."""
    leads = lambda a, b, least: (a >= least) & (a - b >= margin)
    return F.when(leads(run, walk, 0.5), "running").when(leads(walk, run, 0.5), "walking").when(leads(sit, stand, 0.6), "seated").when(leads(stand, sit, 0.6), "standing")


def direction(first: Column, last: Column, samples: Column, least: float) -> Column:
    d = last - first
    return F.when(samples < 3, "unknown").when(F.abs(d) < least, "static").when(d > 0, "right").otherwise("left")


def confirmed_static(direction: Column, gesture: Column, confidence: Column) -> Column:
    return (direction == "static") & (gesture == "static") & (confidence > 0)


def combined(a: Column, b: Column) -> Column:
    """The shared facets of two compound labels in order, or null (a conflict) if they share none."""
    shared = F.array_sort(F.array_intersect(F.split(a, r"\+"), F.split(b, r"\+")))
    return F.when(F.size(shared) > 0, F.array_join(shared, "+"))
