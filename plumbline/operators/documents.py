"""JSON documents on a version log: optimistic concurrency, typed indexes, conjunctive search, paging."""

from __future__ import annotations

import json
import secrets
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import errors
from plumbline.functions import jsonpath
from plumbline.operators import versions as V
from plumbline.sources.store import Store

SCHEMA = "key string, content string, version long, generation long, ts long, op string, expire_at long"
DEFAULT_PAGE, MAX_PAGE = 50, 1_000
OPERATORS = {"$eq": lambda a, b: a == b, "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
_PYTHON = {"string": str, "number": (int, float), "boolean": bool}


@dataclass(frozen=True)
class Document:
    key: str
    content: object
    version: int
    generation: int

    @property
    def etag(self) -> str:
        return f"{self.generation:x}-{self.version}"


@dataclass
class Index:
    kind: str
    since: int  # versions from here on are indexed; 0 after a re-index


@dataclass(frozen=True)
class Page:
    documents: list[Document]
    total: int
    offset: int
    limit: int
    keys: tuple[str, ...] = ()


def condition(indexes: dict[str, str], filters: dict, document=None):
    """The conjunction of ``filters`` (path to value, or to one operator and value), typed by the index of each path."""
    if not filters:
        raise errors.EmptyFilter("a search needs a filter")
    document = F.col("content") if document is None else document
    out = F.lit(True)
    for path, wanted in filters.items():
        if path not in indexes:
            raise errors.UnknownIndex(path)
        op, value = next(iter(wanted.items())) if isinstance(wanted, dict) and len(wanted) == 1 else ("$eq", wanted)
        kind = indexes[path]
        if op not in OPERATORS or not isinstance(value, _PYTHON[kind]) or (kind == "number" and isinstance(value, bool)):
            raise errors.TypeMismatch(f"{path}: {wanted!r}")
        out = out & OPERATORS[op](jsonpath.typed(document, path, kind), F.lit(float(value) if kind == "number" else value))
    return out


def page(found: DataFrame, limit: int | None, offset: int) -> tuple[DataFrame, int, int]:
    """One page in key order, the total before paging and the limit that held."""
    limit = min(DEFAULT_PAGE if limit is None else limit, MAX_PAGE)
    ordered = found.orderBy("key")
    return (ordered.offset(offset) if offset else ordered).limit(limit), found.count(), limit


class Documents:
    def __init__(self, spark: SparkSession, path: str, clock: V.Clock | None = None):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock or V.Clock()
        self.store = Store(spark, self.path)
        self._held = f"{self.path}/_indexes.json"  # Parquet readers pass over names with an underscore
        held = json.loads(self.store.read(self._held)) if self.store.exists(self._held) else {}
        self.indexes: dict[str, Index] = {p: Index(**i) for p, i in held.items()}
        self.tasks: dict[str, dict] = {}
        self._running: str | None = None

    def _keep_indexes(self) -> None:
        self.store.write(self._held, json.dumps({p: vars(i) for p, i in self.indexes.items()}))

    def log(self) -> DataFrame:
        if not self.store.exists(self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def live(self, snapshot: int | None = None) -> DataFrame:
        return V.latest(self.log(), snapshot).where(F.col("op") != V.DELETE)

    def keys(self) -> DataFrame:
        return self.live().select("key")

    def _append(self, frame: DataFrame) -> None:
        frame.write.mode("append").parquet(self.path)

    def _write(self, key: str, content, version: int, generation: int, op: str = V.PUT) -> Document:
        self._append(self.spark.createDataFrame([(key, None if op == V.DELETE else json.dumps(content, ensure_ascii=False), version, generation, self.clock.tick(), op, 0)], SCHEMA).coalesce(1))
        return Document(key, content, version, generation)

    def get(self, key: str) -> Document | None:
        found = V.latest(self.log().where(F.col("key") == key)).where(F.col("op") != V.DELETE).head()
        return found and Document(key, json.loads(found["content"]), found["version"], found["generation"])

    def create(self, content, key: str | None = None) -> Document:
        key = key or str(uuid.uuid4())
        if self.get(key):
            raise errors.AlreadyExists(key)
        return self._write(key, content, 1, secrets.randbits(48))

    def upsert(self, key: str, content, expected: str | None = None) -> Document:
        """Create or replace; with an expected tag only if it is the present document's."""
        now = self.get(key)
        if expected is not None and (now is None or now.etag != expected):
            raise errors.VersionConflict(key)
        return self._write(key, content, 1 if now is None else now.version + 1, secrets.randbits(48) if now is None else now.generation)

    def delete(self, key: str, expected: str | None = None) -> bool:
        now = self.get(key)
        if expected is not None and (now is None or now.etag != expected):
            raise errors.VersionConflict(key)
        if now is not None:
            self._write(key, None, now.version + 1, now.generation, V.DELETE)
        return now is not None

    def load(self, lines: DataFrame) -> int:
        """Bulk load of (line, key, content) rows: a later line of a key replaces an earlier one, and each counts as a version."""
        now = self.live().select("key", F.col("version").alias("__version"), F.col("generation").alias("__generation"))
        base = self.clock.tick()
        fresh = F.pmod(F.xxhash64("key", F.lit(base)), F.lit(1 << 48))
        # the last line and the number of lines of a key are partially aggregated, so a key with very many lines is no task of its own
        last = lines.groupBy("key").agg(F.max(F.struct("line", "content")).alias("__last"), F.count(F.lit(1)).alias("__n"))
        rows = last.withColumn("content", F.col("__last.content")).join(now, "key", "left")
        rows = rows.select("key", "content", (F.coalesce("__version", F.lit(0)) + F.col("__n")).cast("long").alias("version"), F.coalesce("__generation", fresh).alias("generation"), F.lit(base).alias("ts"), F.lit(V.PUT).alias("op"), F.lit(0).cast("long").alias("expire_at"))
        self._append(rows)
        return lines.count()

    # indexes and search

    def create_index(self, path: str, kind: str) -> None:
        jsonpath.check_path(path)
        if kind not in jsonpath.KINDS:
            raise errors.InvalidIndexField(kind)
        if path in self.indexes:
            raise errors.AlreadyExists(path)
        self.indexes[path] = Index(kind, self.clock.tick())
        self._keep_indexes()

    def drop_index(self, path: str) -> None:
        if self.indexes.pop(path, None) is None:
            raise errors.UnknownIndex(path)
        self._keep_indexes()

    def reindex(self, path: str | None = None) -> dict:
        """From now on all documents are found by all indexes, or by one. Doing it again changes nothing.

        A task of the domain, one at a time, whose state ``tasks`` holds by its id: running, completed with the documents it covered, or failed with the reason.
        """
        if self._running is not None:
            raise errors.ReindexRunning(self._running)
        if path is not None and path not in self.indexes:
            raise errors.UnknownIndex(path)
        task, began = str(uuid.uuid4()), time.time()
        self._running = task
        status = self.tasks[task] = {"task": task, "status": "running", "documents": 0}
        before = {p: i.since for p, i in self.indexes.items()}
        try:
            documents = self.count()
            for name, index in self.indexes.items():
                if path in (None, name):
                    index.since = 0
            self._keep_indexes()
            status |= {"status": "completed", "documents": documents, "seconds": int(time.time() - began)}
        except Exception as e:
            for name, since in before.items():
                self.indexes[name].since = since
            status |= {"status": "failed", "error": str(e)}
            raise
        finally:
            self._running = None
        return status

    def search(self, filters: dict, limit: int | None = None, offset: int = 0) -> Page:
        wanted = condition({p: i.kind for p, i in self.indexes.items()}, filters)
        since = max(self.indexes[p].since for p in filters)
        return self._page(self.live().where((F.col("ts") >= since) & wanted), limit, offset)

    def list(self, limit: int | None = None, offset: int = 0, keys_only: bool = False) -> Page:
        return self._page(self.live(), limit, offset, keys_only)

    def count(self) -> int:
        return self.live().count()

    def _page(self, found: DataFrame, limit: int | None, offset: int, keys_only: bool = False) -> Page:
        rows, total, held = page(found.select("key", *([] if keys_only else ["content", "version", "generation"])), limit, offset)
        rows = rows.collect()
        documents = [] if keys_only else [Document(r["key"], json.loads(r["content"]), r["version"], r["generation"]) for r in rows]
        return Page(documents, total, offset, held, tuple(r["key"] for r in rows))
