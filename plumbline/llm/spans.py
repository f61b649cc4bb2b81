"""Spans of regular expressions as DataFrame columns, with positions in code points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind_order:int,end:int,kind:string>>"
#: Matches of a text that are placed together.
CHUNK = 128


@dataclass(frozen=True)
class Rule:
    """A kind of span: leftmost non-overlapping matches of ``pattern`` that pass ``check``, in texts that pass ``quick``.

    Patterns use possessive repeats where what follows can't match inside them, so that they take time in proportion
    to the text and no stack, however long a run is.
    """

    kind: str
    pattern: str
    check: Callable[[Column], Column]
    quick: Callable[[Column], Column]
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def chunks(rows: Column) -> Column:
    """An array in arrays of ``CHUNK`` members; an empty one is one empty chunk."""
    return once(rows, lambda r: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(r) - 1, F.lit(0)) / CHUNK).cast("int")), lambda k: F.slice(r, k * CHUNK + 1, F.lit(CHUNK))))


def pairs(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern, and what lies before each of them and behind the last."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def placed(matches: Column, kind: str, one: Callable[[Column, Column, Column], Column]) -> Column:
    """What ``one(start, end, match)`` gives of every match, an array of type ``kind`` with fields start and end.

    Matches have fields m and skip, the code points between the match before and this one, which are summed up to
    positions: first within chunks, then over chunks, so that an array is never copied once for every match of a long text.
    """
    nothing, parts = F.array().cast(kind), F.array().cast(f"array<{kind}>")

    def within(held: Column, p: Column) -> Column:
        start = held["at"] + p["skip"]
        end = start + F.length(p["m"])
        return F.struct(end.alias("at"), F.concat(held["spans"], one(start, end, p)).alias("spans"))

    def over(held: Column, c: Column) -> Column:
        moved = F.transform(c["spans"], lambda s: s.withField("start", s["start"] + held["at"]).withField("end", s["end"] + held["at"]))
        return F.struct((held["at"] + c["at"]).alias("at"), F.concat(held["parts"], F.array(moved).cast(f"array<{kind}>")).alias("parts"))

    own = F.transform(chunks(matches), lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), nothing.alias("spans")), within))
    return F.aggregate(own, F.struct(F.lit(0).alias("at"), parts.alias("parts")), over, lambda held: F.flatten(held["parts"]))


def find(text: Column, rule: Rule, order: int) -> Column:
    """The spans of one rule."""
    nothing = F.array().cast(SPAN)
    matches = F.zip_with(*pairs(text, rule.pattern), lambda m, b: F.struct(m.alias("m"), F.length(b).alias("skip")))
    # zip_with pads the shorter side; the text after the last match has no match
    matches = F.filter(matches, lambda p: p["m"].isNotNull())

    def one(start: Column, end: Column, p: Column) -> Column:
        span = F.struct(start.alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.when(rule.check(p["m"]), F.array(span).cast(SPAN)).otherwise(nothing)

    return F.when(rule.quick(text), placed(matches, SPAN, one)).otherwise(nothing)


def written(spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
