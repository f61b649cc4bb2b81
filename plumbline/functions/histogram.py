"""Latency histograms of seven exponential buckets and percentiles read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the buckets in microseconds (the last has none), and what a percentile in each reports.
BOUNDS = [10, 100, 1_000, 10_000, 100_000, 1_000_000]
MIDPOINTS = [5, 50, 500, 5_000, 50_000, 500_000, 2_000_000]
BUCKETS = [f"h{i}" for i in range(7)]


def bucket(micros: Column) -> Column:
    out = F.when(micros < BOUNDS[0], 0)
    for i, bound in enumerate(BOUNDS[1:], 1):
        out = out.when(micros < bound, i)
    return out.when(micros.isNotNull(), 6)


def counts(micros: Column, condition: Column) -> list[Column]:
    """Aggregates h0 to h6 over the rows that meet ``condition``."""
    return [F.sum(F.when(condition & (bucket(micros) == i), 1).otherwise(0)).cast("long").alias(name) for i, name in enumerate(BUCKETS)]


def percentile(p: int) -> Column:
    """The midpoint of the first bucket at which the running count reaches ceil(total * p / 100); 0 without counts."""
    total = sum((F.col(b) for b in BUCKETS[1:]), F.col(BUCKETS[0]))
    rank = F.floor((total * p + 99) / 100)
    out, running = F.when(total == 0, 0), F.lit(0)
    for name, middle in zip(BUCKETS, MIDPOINTS, strict=True):
        running = running + F.col(name)
        out = out.when(running >= rank, middle)
    return out.cast("long")


def ratio(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses == 0, F.lit(0.0)).otherwise(hits / (hits + misses)).cast("double")
