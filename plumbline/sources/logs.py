"""Log files: the newest lines that match, and the files themselves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.ndjson import numbered

SCAN_BYTES = 4 * 1024 * 1024


@dataclass(frozen=True)
class Tail:
    lines: list[str]
    truncated: bool


def last(lines: DataFrame, n: int, contains: str | None = None) -> DataFrame:
    """The last ``n`` of (line, text) rows that contain a text, oldest first."""
    if contains is not None:
        lines = lines.where(F.col("text").contains(contains))
    return lines.orderBy(F.col("line").desc()).limit(n).orderBy("line")


def tail(spark: SparkSession, path: str, n: int, contains: str | None = None, budget: int = SCAN_BYTES) -> Tail:
    """The last ``n`` matching lines among the last ``budget`` bytes; truncated if the file has more and too few were found."""
    sizes = files(spark, path).select("path", F.col("bytes").alias("length"), "modified")
    # a folder is read as one log, its files by age and name; one row for each file
    order = Window.orderBy("modified", "path")
    sizes = sizes.select(F.col("path").alias("file"), F.row_number().over(order).alias("nth"), F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), "length")
    total = sizes.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    rows = numbered(spark, path).join(F.broadcast(sizes), "file")
    # positions from here on are those in the whole log; a line is found by its file and number
    rows = rows.withColumn("line", F.struct("nth", "line"))
    if total > budget:
        # only blocks that reach into the budget are ordered, so the window's rows are bounded by a block and the budget
        rows = rows.where(F.col("before") + F.col("start") + F.col("size") > total - budget)
        behind = F.sum(F.octet_length("text") + 1).over(Window.orderBy(F.col("line").desc()))
        rows = rows.withColumn("__behind", behind).where(F.col("__behind") <= budget)
    found = [r["text"] for r in last(rows.select("line", "text"), n, contains).collect()]
    return Tail(found, total > budget and len(found) < n)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, bytes of the files of a folder (or of one file), newest first, then by name from the last."""
    found = spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return found.orderBy(F.col("modified").desc(), F.col("path").desc())
