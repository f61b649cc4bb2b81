"""Key-value domains: an append-only version log in Parquet and reads that resolve it."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import errors
from plumbline.operators import versions as V
from plumbline.sources.store import Store

MAX_KEY, MAX_VALUE = 256, 512 * 1024


@dataclass(frozen=True)
class Value:
    """What a read finds: absent, null or present."""

    status: str
    value: bytes | None = None


class KeyValues:
    """One domain. Writes append one file for each batch; a batch has one timestamp.

    The log lies in a folder that a small file names; compaction writes another folder, then replaces the file, so a crash leaves one of both whole.
    """

    def __init__(self, spark: SparkSession, path: str, clock: V.Clock | None = None, max_key: int = MAX_KEY, max_value: int = MAX_VALUE):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock or V.Clock()
        self.max_key, self.max_value = max_key, max_value
        self.store = Store(spark, self.path)
        self.snapshots = V.Snapshots()
        self._current = f"{self.path}/_current"
        if self.store.exists(self.folder):
            self.clock.observe(self.log().agg(F.coalesce(F.max("ts"), F.lit(0))).head()[0])

    @property
    def folder(self) -> str:
        """Where the version log lies now; a change stream reads here."""
        return f"{self.path}/{self.store.read(self._current) if self.store.exists(self._current) else 'log-0'}"

    def log(self) -> DataFrame:
        if not self.store.exists(self.folder):
            return self.spark.createDataFrame([], V.SCHEMA)
        return self.spark.read.schema(V.SCHEMA).parquet(self.folder)

    # writes

    def batch(self, ops: list[tuple]) -> int:
        """Apply (key, op, value, expire_at) together; returns the timestamp."""
        ts, rows = self.clock.tick(), {}
        for key, op, value, expire in ops:
            if not key or len(key.encode()) > self.max_key:
                raise errors.KeyTooLong(key)
            if value is not None and len(value) > self.max_value:
                raise errors.ValueTooLarge(key)
            rows[key] = (key, None if value is None else bytearray(value), ts, op, expire)
        self.spark.createDataFrame(list(rows.values()), V.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        return ts

    def put(self, key: str, value: bytes, ttl: int | None = None) -> int:
        """With a time to live in seconds, the key expires one second after it has passed; zero expires now."""
        expire = 0 if ttl is None else int(time.time()) + (ttl + 1 if ttl else 0)
        return self.batch([(key, V.PUT, value, expire)])

    def delete(self, key: str) -> int:
        return self.batch([(key, V.DELETE, None, 0)])

    def set_null(self, key: str) -> int:
        """The key exists without a value; its time to live is lifted."""
        return self.batch([(key, V.NULL, None, 0)])

    # reads

    def live(self, snapshot: int | None = None, now: int | None = None) -> DataFrame:
        return V.live(self.log(), snapshot, now)

    def keys(self) -> DataFrame:
        return self.live().select("key")

    def get(self, key: str, snapshot: int | None = None, now: int | None = None) -> Value:
        found = V.live(self.log().where(F.col("key") == key), snapshot, now).head()
        return Value("absent") if found is None else Value(found["status"], None if found["value"] is None else bytes(found["value"]))

    def prefix(self, text: str, snapshot: int | None = None) -> DataFrame:
        """Live keys with a prefix, in order, keys without a value included."""
        return V.live(self.log().where(F.col("key").startswith(text)), snapshot).orderBy("key")

    def snapshot(self) -> int:
        return self.snapshots.open(self.clock.now)

    def compact(self, now: int | None = None) -> None:
        """Rewrite the log without what no open snapshot can need."""
        old = self.folder
        kept = V.compact(self.log(), self.snapshots.watermark(), int(time.time()) if now is None else now)
        name = f"log-{int(old.rsplit('-', 1)[1]) + 1}"
        kept.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.store.write(self._current, name)
        self.store.delete(old)

    def snapshot_table(self, path: str) -> DataFrame:
        """The live keys with their values at one instant, in key order, as a table of its own that later writes leave alone."""
        at = self.snapshot()
        try:
            self.live(at).where(F.col("status") == "present").select("key", "value", "expire_at", F.lit(at).alias("snapshot")).orderBy("key").write.mode("overwrite").parquet(path)
        finally:
            self.snapshots.close(at)
        return self.spark.read.parquet(path)


class Domains:
    """Names of domains: active, or deleting until their data is purged."""

    def __init__(self, spark: SparkSession, root: str, make=KeyValues):
        self.spark, self.root, self.make = spark, root.rstrip("/"), make
        self.store = Store(spark, self.root)
        self._held = f"{self.root}/_domains.json"
        self.states: dict[str, str] = json.loads(self.store.read(self._held)) if self.store.exists(self._held) else {}

    def _keep(self) -> None:
        self.store.write(self._held, json.dumps(self.states))

    def create(self, name: str):
        if not re.fullmatch(r"[a-zA-Z0-9_-]{1,50}", name):
            raise errors.InvalidDomain(name)
        if name in self.states:
            raise errors.AlreadyExists(name)
        self.states[name] = "active"
        self._keep()
        return self.get(name)

    def get(self, name: str):
        if name not in self.states:
            raise errors.UnknownDomain(name)
        if self.states[name] != "active":
            raise errors.DomainDeleting(name)
        return self.make(self.spark, f"{self.root}/{name}")

    def listed(self) -> list[tuple[str, str]]:
        """All names with their states, those being deleted included."""
        return sorted(self.states.items())

    def names(self) -> list[str]:
        return sorted(n for n, s in self.states.items() if s == "active")

    def delete(self, name: str) -> None:
        self.get(name)
        self.states[name] = "deleting"
        self._keep()

    def purge(self) -> list[str]:
        """Remove the data of deleting domains; their names are free again."""
        gone = sorted(n for n, s in self.states.items() if s == "deleting")
        for name in gone:
            self.store.delete(f"{self.root}/{name}")
            del self.states[name]
        self._keep()
        return gone
