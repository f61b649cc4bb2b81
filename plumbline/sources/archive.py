"""Backup archives: typed JSON lines that end in the SHA-256 of what stands before."""

from __future__ import annotations

import hashlib
import json
import time
from datetime import datetime

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from plumbline import errors
from plumbline.functions import cron
from plumbline.operators import versions as V
from plumbline.operators.documents import Documents
from plumbline.operators.kv import KeyValues
from plumbline.sources.ndjson import numbered
from plumbline.sources.store import Store

#: Digests below one node of the digest tree.
FAN_OUT = 4096


def export(spark: SparkSession, path: str, kv: dict[str, KeyValues] | None = None, docs: dict[str, Documents] | None = None) -> int:
    """Write a manifest, then each domain with its keys or documents at one snapshot, as ordered part files, and the digest beside them.

    Lines are ordered within a domain by key; executors write them, and the digest is a tree over the lines' digests in order.
    """
    now = int(time.time())
    header = [{"t": "manifest", "format": 1, "created": now}]
    frames = []
    for name, domain in sorted((kv or {}).items()):
        header.append({"t": "kv-domain", "domain": name})
        live = domain.live(domain.clock.now, now)
        frames.append(live.select(F.lit(f"1{name}").alias("o"), "key", F.to_json(F.struct(F.lit("kv").alias("t"), F.lit(name).alias("domain"), "key", "status", F.base64("value").alias("value"), "expire_at")).alias("value")))
    for name, domain in sorted((docs or {}).items()):
        header.append({"t": "json-domain", "domain": name})
        header += [{"t": "json-index", "domain": name, "path": p, "kind": i.kind} for p, i in sorted(domain.indexes.items())]
        frames.append(domain.live(domain.clock.now).select(F.lit(f"2{name}").alias("o"), "key", F.to_json(F.struct(F.lit("doc").alias("t"), F.lit(name).alias("domain"), "key", "content", "version", "generation")).alias("value")))
    lines = spark.createDataFrame([("0", f"{i:06d}", json.dumps(h)) for i, h in enumerate(header)], "o string, key string, value string")
    for f in frames:
        lines = lines.unionByName(f)
    lines.orderBy("o", "key").select("value").write.mode("overwrite").text(f"{path}/lines")
    Store(spark, path).write(f"{path}/checksum", json.dumps({"t": "checksum"} | _digest(spark, path)))
    return lines.count()


def _digest(spark: SparkSession, path: str) -> dict:
    """Lines and the root of a tree of SHA-256 in the order of the lines: a node is the digest of up to ``FAN_OUT`` digests below it, one after the other.

    So executors compute it in any split, and a line that is changed, moved, lost or added shows.
    """
    lines = numbered(spark, f"{path}/lines")
    files = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file
    files = files.select("file", F.coalesce(before, F.lit(0)).alias("before"), "n")
    count = files.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    nodes = lines.join(files.drop("n"), "file").select((F.col("before") + F.col("line") - 1).alias("i"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    left = count
    while left > 1:
        nodes = nodes.groupBy(F.floor(F.col("i") / FAN_OUT).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("below"))
        nodes = nodes.select("i", F.sha2(F.array_join("below.h", "").cast("binary"), 256).alias("h"))
        left = -(-left // FAN_OUT)
    root = nodes.head()
    return {"lines": count, "sha256": root["h"] if root else hashlib.sha256(b"").hexdigest()}


def read(spark: SparkSession, path: str):
    """The archive's lines with their type, after the digest has been checked."""
    held = json.loads(Store(spark, path).read(f"{path}/checksum"))
    if {k: held[k] for k in ("lines", "sha256")} != _digest(spark, path):
        raise errors.ArchiveCorrupt(path)
    return spark.read.text(f"{path}/lines").withColumn("t", F.get_json_object("value", "$.t"))


def restore(spark: SparkSession, path: str, kv=None, docs=None, replace: bool = False, only: str | None = None, rename: str | None = None) -> dict:
    """Restore into the registries ``kv`` and ``docs``; expired keys are skipped and counted. One domain may go under another name."""
    lines = read(spark, path)
    now, report = int(time.time()), {"kv": 0, "doc": 0, "expired": 0}
    heads = [json.loads(r["value"]) for r in lines.where(F.col("t").isin("kv-domain", "json-domain", "json-index")).collect()]
    indexes = []
    for head in heads:
        name = head["domain"]
        if only is not None and name != only:
            continue
        target = rename if rename is not None and name == only else name
        registry = kv if head["t"] == "kv-domain" else docs
        if head["t"] == "json-index":
            indexes.append((target, head["path"], head["kind"]))
            continue
        if target in registry.states:
            if not replace:
                raise errors.AlreadyExists(target)
            registry.delete(target)
            registry.purge()
        domain = registry.create(target)
        own = lines.where(F.get_json_object("value", "$.domain") == name)
        if head["t"] == "kv-domain":
            rows = own.where(F.col("t") == "kv").select(F.from_json("value", "key string, status string, value string, expire_at long").alias("r")).select("r.*")
            gone = (F.col("expire_at") != 0) & (F.col("expire_at") <= now)
            report["expired"] += rows.where(gone).count()
            rows = rows.where(~gone).select("key", F.unbase64("value").alias("value"), F.lit(domain.clock.tick()).alias("ts"), F.when(F.col("status") == "null", V.NULL).otherwise(V.PUT).alias("op"), "expire_at")
            rows.write.mode("append").parquet(domain.folder)
            report["kv"] += rows.count()
        else:
            rows = own.where(F.col("t") == "doc").select(F.from_json("value", "key string, content string, version long, generation long").alias("r")).select("r.*")
            rows = rows.select("key", "content", "version", "generation", F.lit(domain.clock.tick()).alias("ts"), F.lit(V.PUT).alias("op"), F.lit(0).cast("long").alias("expire_at"))
            rows.write.mode("append").parquet(domain.path)
            report["doc"] += rows.count()
    for target, index_path, kind in indexes:
        domain = docs.get(target)
        domain.create_index(index_path, kind)
        domain.reindex()
    return report


class Scheduler:
    """Backups by cron expressions: at most one at a time, and a minute starts each schedule once.

    ``tick`` is called with the time, say once a minute by a host; it runs what is due, then removes what retention does not keep.
    """

    def __init__(self, schedules: dict[str, str], run, remove=None, keep: int = 7):
        """``run(name, at)`` makes a backup, ``remove(name, started)`` deletes one; expressions are checked here."""
        self.schedules = {name: (text, cron.parse(text))[0] for name, text in schedules.items()}
        self.run, self.remove, self.keep = run, remove, keep
        self.done: list[tuple[str, datetime]] = []
        self.running: str | None = None

    def tick(self, at: datetime) -> list[str]:
        minute = at.replace(second=0, microsecond=0)
        due = [n for n, text in sorted(self.schedules.items()) if cron.matches(text, minute) and (n, minute) not in self.done]
        if due and self.running is not None:
            raise errors.BackupRunning(self.running)
        for name in due:
            self.running = name
            try:
                self.run(name, minute)
                self.done.append((name, minute))
            finally:
                self.running = None
            own = sorted(t for n, t in self.done if n == name)
            for old in own[: -self.keep] if self.keep else own:
                if self.remove:
                    self.remove(name, old)
                self.done.remove((name, old))
        return due


def retained(backups, keep: int):
    """Of (schedule, started, complete, uploaded) rows, those that retention removes: complete, not uploaded, beyond the newest ``keep``."""
    own = backups.where(F.col("complete") & ~F.col("uploaded"))
    return own.withColumn("__n", F.row_number().over(Window.partitionBy("schedule").orderBy(F.col("started").desc()))).where(F.col("__n") > keep).drop("__n")


