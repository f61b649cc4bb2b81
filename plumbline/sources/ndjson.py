"""Newline-delimited JSON as a source and a sink of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """line, text, and the file, start and size of the block of each line; lines are numbered from 1 in each file's order.

    Blocks are read in parallel: lines are counted by block, and a line's number is its place in the block after all earlier blocks.
    """
    lines = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("size"), F.monotonically_increasing_id().alias("__id"))
    blocks = lines.groupBy("file", "start").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("__before", F.coalesce(before, F.lit(0)))
    return lines.join(blocks, ["file", "start"]).select((F.col("__id") - F.col("__first") + F.col("__before") + 1).alias("line"), "text", "file", "start", "size")


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line, key, content) of good lines and (line, error) of bad ones; blank lines are neither.

    ``_key`` names the document, or else a new key is made; ``_version`` is dropped; an object with ``_content`` alone stands for its value.
    """
    rows = lines.where(F.trim("text") != "").withColumn("__v", F.try_parse_json("text"))
    kind = F.schema_of_variant("__v")
    good = rows.where(F.col("__v").isNotNull() & kind.startswith("OBJECT"))
    bad = rows.where(~F.coalesce(F.col("__v").isNotNull() & kind.startswith("OBJECT"), F.lit(False)))
    fields = F.from_json("text", "map<string,string>")
    inner = F.map_filter(fields, lambda k, _: ~k.isin("_key", "_version"))
    key = F.try_variant_get("__v", "$._key", "string")
    # values are cut out of the line as JSON, so nothing is converted on the way
    members = F.transform(F.map_keys(inner), lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), F.to_json(F.try_variant_get("__v", "$", "map<string,variant>")[k])))
    alone = (F.size(inner) == 1) & F.array_contains(F.map_keys(inner), "_content")
    content = F.when(alone, F.to_json(F.try_variant_get("__v", "$._content", "variant"))).otherwise(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")))
    return good.select("line", F.coalesce(key, F.uuid()).alias("key"), content.alias("content")), bad.select("line", F.concat(F.lit("line "), F.col("line")).alias("error"))


def lines_of(documents: DataFrame) -> DataFrame:
    """One line for each document: its content with _key and _version; what is not an object stands under _content."""
    tag = F.to_json(F.struct(F.col("key").alias("_key"), F.col("version").alias("_version")))
    body = F.col("content")
    open_tag = F.substring(tag, F.lit(1), F.length(tag) - 1)
    is_object = F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT")
    empty = F.regexp_replace(body, r"\s", "") == "{}"
    inner = F.regexp_replace(F.regexp_replace(body, r"^\s*\{", ""), r"\}\s*$", "")
    text = F.when(is_object & empty, tag).when(is_object, F.concat(open_tag, F.lit(","), inner, F.lit("}"))).otherwise(F.concat(open_tag, F.lit(',"_content":'), body, F.lit("}")))
    return documents.select("key", text.alias("value"))


def write(documents: DataFrame, path: str) -> None:
    lines_of(documents).orderBy("key").select("value").write.mode("overwrite").text(path)
