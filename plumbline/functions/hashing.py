"""Digests, as columns and on the driver."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a_64(data: bytes) -> int:
    value = 0xCBF29CE484222325
    for byte in data:
        value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return value


def domain_prefix(name: str) -> str:
    """Sixteen hexadecimal digits that stand for a domain."""
    return f"{fnv1a_64(name.encode()):016x}"


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def to_hex(data: bytes) -> str:
    """Two lower-case digits for each byte."""
    return data.hex()


def from_hex(text: str) -> bytes | None:
    """The bytes of pairs of hexadecimal digits; None for any other text."""
    return bytes.fromhex(text) if len(text) % 2 == 0 and all(c in "0123456789abcdefABCDEF" for c in text) else None


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def unhexed(text: Column) -> Column:
    return F.when(F.length(text) % 2 == 0, F.try_to_binary(text, F.lit("hex")))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def as_text(value: Column) -> tuple[Column, Column]:
    """A binary value for JSON: (text, encoding), as it is if it is UTF-8 and as base64 if not."""
    valid = F.is_valid_utf8(value.cast("string"))
    return F.when(valid, value.cast("string")).otherwise(F.base64(value)), F.when(value.isNotNull(), F.when(valid, F.lit("utf8")).otherwise(F.lit("base64")))
