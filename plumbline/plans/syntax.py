"""What the parser returns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object  # None, bool, int, float or str


@dataclass(frozen=True)
class Param:
    index: int


@dataclass(frozen=True)
class Name:
    table: str | None
    column: str

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class InList:
    operand: object
    items: tuple
    negated: bool


@dataclass(frozen=True)
class Like:
    operand: object
    pattern: str
    negated: bool


@dataclass(frozen=True)
class IsNull:
    operand: object
    negated: bool


@dataclass(frozen=True)
class Logic:
    op: str  # and, or, not
    parts: tuple


@dataclass(frozen=True)
class Source:
    table: str
    alias: str


@dataclass(frozen=True)
class Join:
    source: Source
    left: Name
    right: Name


@dataclass(frozen=True)
class Select:
    items: tuple | None  # (Name, output name); None for a star
    count: bool
    source: Source
    joins: tuple = ()
    where: object = None
    order: tuple = ()  # (Name, descending)
    limit: int | None = None
    offset: int = 0
    params: int = 0


@dataclass(frozen=True)
class Now:
    """CURRENT_TIMESTAMP as a default."""


@dataclass
class ColumnSpec:
    name: str
    type: str
    primary_key: bool = False
    autoincrement: bool = False
    not_null: bool = False
    unique: bool = False
    default: object = None  # Literal or Now
    references: str | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple | None
    rows: tuple
    params: int = 0


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple
    where: object
    params: int = 0


@dataclass(frozen=True)
class Delete:
    table: str
    where: object
    params: int = 0


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    unique: bool


@dataclass(frozen=True)
class CreateView:
    name: str
    text: str
    select: Select


@dataclass(frozen=True)
class Drop:
    kind: str
    name: str


@dataclass(frozen=True)
class Alter:
    table: str
    action: str  # add, drop, rename_column, rename
    column: str | None = None
    to: str | None = None
    spec: ColumnSpec | None = field(default=None)


#: Access that a statement needs; what is not listed needs the most.
ACCESS = {Select: "read", Insert: "write", Update: "write", Delete: "write"}
LEVELS = ["read", "write", "ddl"]


def access(statement: object) -> str:
    return ACCESS.get(type(statement), "ddl")


def permitted(granted: str, statement: object) -> bool:
    return granted in LEVELS and LEVELS.index(granted) >= LEVELS.index(access(statement))
