"""Helpers shared by the corpus operators: shared storage and Arrow text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import plumbline

#: Rows of one Arrow batch and bytes of text that a Python worker holds as objects at a time.
BATCH_ROWS = 1000
SLICE_BYTES = 1 << 20
#: A-Z to a-z, other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Ship this package to the workers, once, and keep Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if not getattr(context, "_plumbline_shipped", False):
        root = Path(plumbline.__file__).parent
        target = Path(tempfile.mkdtemp(prefix="plumbline-code-")) / "plumbline_code.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        context.addPyFile(str(target))
        context._plumbline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary folder in local mode and a refusal on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("plumbline.shared.dir", None)
    if not found:
        local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="plumbline-shared-")
        spark.conf.set("plumbline.shared.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """What one application writes lies in one folder in the shared one, named by its id, which may be deleted when it has ended."""
    return f"{shared_dir(spark)}/plumbline-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(docs: DataFrame, name: str) -> str:
    """``name``, or where ``docs`` has such a column the first of its kind that it lacks."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def spread(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, with the rows of very common keys dealt over many tasks.

    ``counts`` is a written table of the key and the number ``rows`` of rows that ``left`` has of it. A key with over twice
    a partition's share of the rows is cut in as many pieces as shares it has. There are fewer such keys than half the
    partitions, so what is broadcast to find them is bounded, and at most twice as many pieces as partitions. Columns but the key have different names.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("rows")).head()[0] or 0
    hot = counts.where(F.col("rows") * parts > 2 * total).select(F.col(key).alias("__hot"), F.ceil(F.col("rows") * parts / max(total, 1)).cast("int").alias("__pieces"))

    def dealt(rows: DataFrame, piece: Column) -> DataFrame:
        return rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__piece", piece).drop("__hot", "__pieces")

    pieces = F.coalesce("__pieces", F.lit(1))
    # a row's piece follows from its partition and values, so a task that runs again gives the same
    one = F.pmod(F.xxhash64(*[c for c in left.columns if c != key]) + F.spark_partition_id(), pieces).cast("int")
    return dealt(left, one).join(dealt(right, F.explode(F.sequence(F.lit(0), pieces - 1))), [key, "__piece"], how).drop("__piece")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def binary_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as bytes, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """[start, end) row ranges of at most ``limit`` bytes of text each (one row at least)."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += int(size)
    if len(sizes) > start:
        yield start, len(sizes)


def texts(column: pa.Array, start: int, end: int) -> list[bytes]:
    """The texts of a row range as bytes; null is empty."""
    return [x or b"" for x in column.slice(start, end - start).to_pylist()]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length) over all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of the sums below count."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


class WordHash(dict):
    """Stable 64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.ones(batch.num_rows, bool)
        changes[1:] = False
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            changes[1:] |= v[1:] != v[:-1]
        last = int(np.flatnonzero(changes)[-1])
        same = held and all(held[-1].column(held[-1].schema.get_field_index(k))[-1] == batch.column(batch.schema.get_field_index(k))[0] for k in keys)
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if last and (held or last):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last) if last else batch)
    if held:
        yield pa.Table.from_batches(held)


def group_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's group, from 0."""
    change = np.zeros(table.num_rows, bool)
    for k in keys:
        v = table[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change)
