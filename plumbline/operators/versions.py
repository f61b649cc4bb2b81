"""Version logs: rows (key, value, ts, op, expire_at) of puts, nulls and deletions, resolved at a snapshot.

The newest version that a snapshot sees decides alone: if it is a deletion or has expired, older ones stay hidden. It is
found by one partially aggregated maximum, so a key with very many versions is combined before the shuffle.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key string, value binary, ts long, op string, expire_at long"
PUT, NULL, DELETE = "put", "null", "del"


def latest(log: DataFrame, snapshot: int | None = None, keys: list[str] | None = None, order: str = "ts") -> DataFrame:
    """The deciding version of each key, deletions included."""
    keys = keys or ["key"]
    if snapshot is not None:
        log = log.where(F.col(order) <= snapshot)
    rest = [c for c in log.columns if c not in keys and c != order]
    newest = log.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("__v"))
    return newest.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in log.columns if c not in keys])


def is_live(now: int):
    """Not a deletion, and without an expiry or before it (seconds)."""
    return (F.col("op") != DELETE) & ((F.col("expire_at") == 0) | (F.col("expire_at") > now))


def live(log: DataFrame, snapshot: int | None = None, now: int | None = None) -> DataFrame:
    """key, status (present or null), value, ts, expire_at of the visible keys."""
    now = int(time.time()) if now is None else now
    found = latest(log, snapshot).where(is_live(now))
    return found.select("key", F.when(F.col("op") == NULL, "null").otherwise("present").alias("status"), F.when(F.col("op") == PUT, F.col("value")).alias("value"), "ts", "expire_at")


def merge(*sources: DataFrame) -> DataFrame:
    """One log of several sources; a version that several have counts once."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["key", "ts"])


def compact(log: DataFrame, watermark: int | None, now: int, keys: list[str] | None = None, order: str = "ts") -> DataFrame:
    """The versions that an open snapshot, of which ``watermark`` is the oldest, or a later reader can still need.

    All versions above the watermark stay, and of those at or below it the newest, which shadows the rest; without a watermark the newest
    version alone. The shadowing version goes as well if it has expired, or is a deletion older than the watermark; a deletion stays
    without a watermark, and null markers are data. One partially aggregated maximum finds it, so a key with very many versions is no task of its own.
    """
    expired = (F.col("op") != DELETE) & (F.col("expire_at") != 0) & (F.col("expire_at") <= now)
    last = latest(log, watermark, keys, order).where(~expired)
    if watermark is None:
        return last
    last = last.where(~((F.col("op") == DELETE) & (F.col(order) < watermark)))
    return log.where(F.col(order) > watermark).select(*log.columns).unionByName(last.select(*log.columns))


class Clock:
    """Hybrid logical timestamps: 48 bits of milliseconds, 16 bits of a counter; each is greater than all before."""

    def __init__(self, millis=lambda: int(time.time() * 1000)):
        self._millis, self._last, self._lock = millis, 0, threading.Lock()

    def tick(self) -> int:
        with self._lock:
            self._last = max(self._last + 1, self._millis() << 16)
            return self._last

    def observe(self, ts: int) -> None:
        with self._lock:
            self._last = max(self._last, ts)

    @property
    def now(self) -> int:
        return self._last


class Snapshots:
    """Open snapshots; the oldest bounds what compaction may drop."""

    def __init__(self):
        self._open: dict[int, int] = {}

    def open(self, ts: int) -> int:
        self._open[ts] = self._open.get(ts, 0) + 1
        return ts

    def close(self, ts: int) -> None:
        self._open[ts] -= 1
        if not self._open[ts]:
            del self._open[ts]

    def watermark(self) -> int | None:
        return min(self._open, default=None)
