"""Tokens of the SQL subset."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from plumbline import errors

# The reserved words of the dialect.
KEYWORDS = frozenset(
    "select from where and or not in like is null left outer join on as order by asc desc limit offset count insert into values update set delete create table unique index view drop alter add column rename to primary key autoincrement default references true false current_timestamp".split()
)
MAX_STATEMENT = 64 * 1024
_PATTERN = re.compile(
    r"(?P<space>\s+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<real>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>\d+)|(?P<text>'(?:[^']|'')*')|(?P<op><=|>=|!=|<>|[=<>(),.*?;-])"
)


@dataclass(frozen=True)
class Token:
    kind: str  # word, key, int, real, text, op, end
    value: object
    at: int


def tokens(sql: str, limit: int = MAX_STATEMENT) -> list[Token]:
    if len(sql.encode()) > limit:
        raise errors.StatementTooLong(limit)
    out, at = [], 0
    while at < len(sql):
        m = _PATTERN.match(sql, at)
        if not m:
            raise errors.SyntaxFault(f"character {sql[at]!r} at {at}")
        kind, text = m.lastgroup, m[0]
        if kind == "word":
            low = text.lower()
            if low not in KEYWORDS and len(low) > 50:
                raise errors.InvalidIdentifier(text)
            out.append(Token("key" if low in KEYWORDS else "word", low, at))
        elif kind == "int":
            out.append(Token("int", int(text), at))
        elif kind == "real":
            if not math.isfinite(float(text)):
                raise errors.SyntaxFault(f"{text} is not finite")
            out.append(Token("real", float(text), at))
        elif kind == "text":
            out.append(Token("text", text[1:-1].replace("''", "'"), at))
        elif kind == "op":
            out.append(Token("op", "!=" if text == "<>" else text, at))
        at = m.end()
    return [*out, Token("end", None, len(sql))]
