"""Operation metrics: counters of one second, rolling sums of them, percentiles and rates.

Operations are rows (domain, ts, kind, micros, hit): kind is read, write or rejected; only reads have a latency that counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import histogram

RETAINED_SECONDS = 60
COUNTERS = ["reads", "writes", "hits", "misses", "rejections"]


def counters() -> list[Column]:
    kind = F.col("kind")
    ones = {"reads": kind == "read", "writes": kind == "write", "hits": (kind == "read") & F.col("hit"), "misses": (kind == "read") & ~F.col("hit"), "rejections": kind == "rejected"}
    return [F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in ones.items()]


def per_second(operations: DataFrame) -> DataFrame:
    """Counters and histogram of each domain and second."""
    second = F.date_trunc("second", "ts").alias("second")
    return operations.groupBy("domain", second).agg(*counters(), *histogram.counts(F.col("micros"), F.col("kind") == "read"))


def rolling(seconds: DataFrame, width: int = RETAINED_SECONDS) -> DataFrame:
    """At each second with data, sums over the seconds of the ``width`` before and with it."""
    at = F.col("second").cast("timestamp").cast("long")
    by = Window.partitionBy("domain").orderBy(at).rangeBetween(-(width - 1), 0)
    return seconds.select("domain", "second", *[F.sum(c).over(by).cast("long").alias(c) for c in [*COUNTERS, *histogram.BUCKETS]])


def summary(seconds: DataFrame, until: Column | None = None, width: int = RETAINED_SECONDS) -> DataFrame:
    """One row for each domain over the retained seconds: counters, hit rate, p50 and p99."""
    if until is not None:
        seconds = seconds.where((F.col("second") > until - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(width))) & (F.col("second") <= until))
    out = seconds.groupBy("domain").agg(*[F.sum(c).cast("long").alias(c) for c in [*COUNTERS, *histogram.BUCKETS]])
    return out.select("domain", *COUNTERS, histogram.ratio(F.col("hits"), F.col("misses")).alias("hit_rate"), histogram.percentile(50).alias("p50"), histogram.percentile(99).alias("p99"))


def heartbeat(operations: DataFrame) -> DataFrame:
    """Totals over all domains, and the seconds from the first operation to the last."""
    uptime = F.max(F.col("ts").cast("timestamp").cast("long")) - F.min(F.col("ts").cast("timestamp").cast("long"))
    return operations.agg(F.count(F.lit(1)).alias("operations"), *counters(), F.coalesce(uptime, F.lit(0)).cast("long").alias("uptime"))
