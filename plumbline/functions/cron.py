"""Five-field cron expressions over minutes in UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import errors

#: Least and greatest value of minute, hour, day of month, month and weekday (Sunday is 0 and 7).
BOUNDS = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]


def field_values(text: str, low: int, high: int) -> list[int]:
    """The values of one field: lists, ranges and steps."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if _ and (not step.isdigit() or int(step) == 0):
            raise errors.SyntaxFault(f"step {part!r}")
        first, dash, last = span.partition("-")
        if span == "*":
            a, b = low, high
        elif first.isdigit() and (not dash or last.isdigit()):
            a = int(first)
            b = int(last) if dash else (high if step else a)
        else:
            raise errors.SyntaxFault(f"field {part!r}")
        if not low <= a <= b <= high:
            raise errors.SyntaxFault(f"range {part!r}")
        out.update(range(a, b + 1, int(step or 1)))
    return sorted(out)


def parse(expression: str) -> list[list[int]]:
    fields = expression.split()
    if len(fields) != 5:
        raise errors.SyntaxFault("a cron expression has five fields")
    values = [field_values(f, *b) for f, b in zip(fields, BOUNDS, strict=True)]
    values[4] = sorted({v % 7 for v in values[4]})
    return values


def matches(expression: str, at: datetime) -> bool:
    minute, hour, day, month, weekday = parse(expression)
    days = at.day in day, at.isoweekday() % 7 in weekday
    either = "*" not in expression.split()[2:5:2]
    return at.minute in minute and at.hour in hour and at.month in month and (any(days) if either else all(days))


def matched(expression: str, ts: Column) -> Column:
    """Whether a timestamp's minute matches. Day and weekday are alternatives unless one of them is a plain star."""
    minute, hour, day, month, weekday = parse(expression)
    by_day, by_weekday = F.dayofmonth(ts).isin(day), (F.dayofweek(ts) - 1).isin(weekday)
    either = "*" not in expression.split()[2:5:2]
    return F.minute(ts).isin(minute) & F.hour(ts).isin(hour) & F.month(ts).isin(month) & ((by_day | by_weekday) if either else (by_day & by_weekday))
