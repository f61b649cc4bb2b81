"""Link columns between the engines: masks, and expansion of what they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import errors
from plumbline.functions import hashing, timestamps
from plumbline.plans.catalog import Table
from plumbline.plans.planner import Planned


def mask(frame: DataFrame, table: Table, no_kv: bool, no_docs: bool) -> DataFrame:
    """Link cells of a domain that is gone read as null, right after the scan and so before any filter."""
    gone = [c.name for c in table.columns if (c.link == "kv" and no_kv) or (c.link == "json" and no_docs)]
    return frame.withColumns({c: F.lit(None).cast("string") for c in gone}) if gone else frame


def targets(planned: Planned, wanted: str | list[str], joins: int, most: int) -> list[int]:
    """Output positions to expand: all link columns for a star, or the named ones."""
    def linked(i: int) -> bool:
        c = planned.flat.tables[planned.refs[i].binding].column(planned.refs[i].column)
        return bool(c.references or c.link)

    if wanted == "*":
        out = [i for i in range(len(planned.names)) if linked(i)]
    else:
        out = []
        for name in [wanted] if isinstance(wanted, str) else wanted:
            found = [i for i, n in enumerate(planned.names) if n == name]
            if len(found) != 1 or not linked(found[0]):
                raise errors.InvalidExpand(name)
            out.append(found[0])
    if joins + len(out) > most:
        raise errors.JoinDepthExceeded(joins + len(out))
    return out


def row_object(table: Table, name=lambda c: c) -> Column:
    """A row as a JSON text; instants are rendered."""
    cells = [(timestamps.rendered(F.col(name(c.name))) if c.type == "TIMESTAMP" else F.col(name(c.name))).alias(c.name) for c in table.columns]
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def reference_lookup(target: DataFrame, table: Table) -> DataFrame:
    """__key, __object of every row that a reference can name."""
    return target.select(F.col(table.primary_key).alias("__key"), row_object(table).alias("__object"))


def kv_lookup(live: DataFrame) -> DataFrame:
    """__key, __object of every live key (key, status, value)."""
    text, encoding = hashing.as_text(F.col("value"))
    body = F.struct(F.lit(True).alias("exists"), text.alias("value"), encoding.alias("encoding"))
    return live.select(F.col("key").alias("__key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("__object"))


def doc_lookup(live: DataFrame) -> DataFrame:
    """__key, __object of every live document (key, content)."""
    return live.select(F.col("key").alias("__key"), F.concat(F.lit('{"exists":true,"document":'), F.col("content"), F.lit("}")).alias("__object"))


def expand(frame: DataFrame, planned: Planned, positions: list[int], engine, bounded: bool = False) -> DataFrame:
    """``frame`` with one JSON text for each target: the row, value or document that a cell names, null for null.

    With ``bounded`` the frame has been limited, so its keys are broadcast and only what they name is rendered.
    """
    names = [f"__o{i}" for i in range(len(planned.names))]
    order = frame.toDF(*names).withColumn("__n", F.monotonically_increasing_id()) if planned.ordered else frame.toDF(*names)
    for k, i in enumerate(positions):
        table = planned.flat.tables[planned.refs[i].binding]
        column = table.column(planned.refs[i].column)
        if column.references:
            target = engine.catalog.table(column.references)
            rows = engine.scan(target)
            if bounded:
                rows = rows.join(F.broadcast(order.select(F.col(f"__o{i}").alias(target.primary_key)).distinct()), target.primary_key, "left_semi")
            found, missing = reference_lookup(rows, target), F.lit(None).cast("string")
        else:
            domain = engine.kv if column.link == "kv" else engine.docs
            if domain is None:
                order = order.withColumn(f"__x{k}", F.lit(None).cast("string"))
                continue
            live = domain.live()
            if bounded:
                live = live.join(F.broadcast(order.select(F.col(f"__o{i}").alias("key")).distinct()), "key", "left_semi")
            found = kv_lookup(live) if column.link == "kv" else doc_lookup(live)
            missing = F.when(F.col(f"__o{i}").isNotNull(), F.lit('{"exists":false}'))
        found = found.withColumnsRenamed({"__key": f"__k{k}", "__object": f"__x{k}"})
        order = order.join(found, F.col(f"__o{i}") == F.col(f"__k{k}"), "left").withColumn(f"__x{k}", F.coalesce(f"__x{k}", missing)).drop(f"__k{k}")
    if planned.ordered:
        order = order.orderBy("__n").drop("__n")
    return order.select(*names, *[f"__x{k}" for k in range(len(positions))])
