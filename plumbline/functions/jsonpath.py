"""Typed values at dot paths of JSON documents. A path goes through objects only."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import errors

KINDS = ("string", "number", "boolean")
MAX_PATH = 128
_SPARK = {"string": "string", "number": "double", "boolean": "boolean"}
#: What schema_of_variant calls the kinds.
_NAMED = {"string": "^STRING$", "number": "^(BIGINT|DOUBLE|FLOAT|INT|SMALLINT|TINYINT|DECIMAL.*)$", "boolean": "^BOOLEAN$"}


def check_path(path: str) -> list[str]:
    steps = path.split(".")
    if not path or len(path.encode()) > MAX_PATH or not all(steps):
        raise errors.InvalidIndexField(path)
    return steps


def typed(document: Column, path: str, kind: str) -> Column:
    """The scalar at ``path`` if it has the kind, else null. Other kinds never convert."""
    if kind not in KINDS:
        raise errors.InvalidIndexField(kind)
    steps = "".join("[{}]".format(json.dumps(s)) for s in check_path(path))
    value = F.try_variant_get(F.try_parse_json(document), f"${steps}", "variant")
    held = F.schema_of_variant(value).rlike(_NAMED[kind])
    # minus zero and zero are one value
    found = F.try_variant_get(value, "$", _SPARK[kind])
    return F.when(held, found + F.lit(0.0) if kind == "number" else found)
