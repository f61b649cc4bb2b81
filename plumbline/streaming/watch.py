"""Streams over version logs and operations."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import metrics
from plumbline.operators import versions as V


def events(log: DataFrame, prefix: str = "") -> DataFrame:
    """key, event (set or delete) and ts of each version; a null counts as set. Works on a table and on a stream alike."""
    found = log.where(F.col("key").startswith(prefix)) if prefix else log
    return found.select("key", F.when(F.col("op") == V.DELETE, "delete").otherwise("set").alias("event"), "ts")


def changes(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """The change feed of a domain as a stream over its append-only log: nothing is lost, and it can start from the beginning."""
    return events(spark.readStream.schema(V.SCHEMA).parquet(path), prefix)


def watch(spark: SparkSession, path: str, prefix: str, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Call ``handle`` with each batch of changes under a prefix."""
    writer = changes(spark, path, prefix).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ticker(operations: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Counters of each domain over the last minute, every second. The watermark is an addition of a stream's own."""
    window = F.window("ts", f"{metrics.RETAINED_SECONDS} seconds", "1 second")
    return operations.withWatermark("ts", late).groupBy("domain", window.alias("w")).agg(*metrics.counters()).select("domain", F.col("w.end").alias("until"), *metrics.COUNTERS)


class TokenBucket:
    """Admits up to ``capacity`` operations a second; tokens return with time up to the capacity."""

    def __init__(self, capacity: int, millis=lambda: int(time.time() * 1000)):
        self.capacity, self.tokens, self._millis = capacity, float(capacity), millis
        self._at, self._lock = millis(), threading.Lock()

    def admit(self, n: int = 1) -> bool:
        with self._lock:
            now = self._millis()
            self.tokens = min(self.capacity, self.tokens + max(0, now - self._at) * self.capacity / 1000)
            self._at = now
            if self.tokens < n:
                return False
            self.tokens -= n
            return True
