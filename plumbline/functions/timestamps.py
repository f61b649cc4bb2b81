"""ISO-8601 instants in UTC, with millisecond precision."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import errors

_EPOCH = datetime(1970, 1, 1)
_SHAPE = re.compile(r"(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?Z?", re.ASCII)


def parse(text: str) -> int:
    """Milliseconds since 1970. Offsets are refused; a day up to 31 rolls over into the next month; digits past milliseconds are cut."""
    m = _SHAPE.fullmatch(text)
    if not m:
        raise errors.InvalidTimestamp(text)
    year, month, day, hour, minute, second = map(int, m.groups()[:6])
    if not (1 <= month <= 12 and 1 <= day <= 31 and hour < 24 and minute < 60 and second < 60):
        raise errors.InvalidTimestamp(text)
    at = datetime(year, month, 1, hour, minute, second) + timedelta(days=day - 1)
    return (at - _EPOCH) // timedelta(milliseconds=1) + int(((m[7] or "") + "000")[:3])


def from_millis(millis: int) -> datetime:
    return _EPOCH + timedelta(milliseconds=millis)


def render(millis: int) -> str:
    at = from_millis(millis)
    fraction = f".{millis % 1000:03d}" if millis % 1000 else ""
    return f"{at:%Y-%m-%dT%H:%M:%S}{fraction}Z"


def rendered(ts: Column) -> Column:
    """The same as a column; the fraction only if it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    millis = F.date_format(ts, "SSS")
    return F.concat(whole, F.when(millis != "000", F.concat(F.lit("."), millis)).otherwise(F.lit("")), F.lit("Z"))


def parsed(text: Column) -> Column:
    """A text column as TIMESTAMP_NTZ with the same rules; what does not parse is null."""
    shape = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?Z?$"
    part = [F.regexp_extract(text, shape, i) for i in range(1, 8)]
    year, month, day, hour, minute, second = (p.try_cast("int") for p in part[:6])
    millis = F.substring(F.concat(part[6], F.lit("000")), 1, 3).try_cast("int")
    ok = text.rlike(shape) & month.between(1, 12) & day.between(1, 31) & (hour < 24) & (minute < 60) & (second < 60)
    first = F.make_date(F.when(ok, year), F.when(ok, month), F.when(ok, F.lit(1)))
    at = F.date_add(first, F.when(ok, day) - 1).cast("timestamp_ntz")
    return at + F.make_dt_interval(F.lit(0), hour, minute, second + millis.cast("decimal(18,6)") / 1000)
