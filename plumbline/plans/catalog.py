"""Tables, indexes and views of one domain, kept as one JSON file that is replaced as a whole."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from plumbline import errors
from plumbline.plans import syntax as S


@dataclass
class Column:
    name: str
    type: str
    col_id: int
    nullable: bool = True
    default: object = None
    default_now: bool = False
    references: str | None = None
    since: int = 0  # the schema version that brought it

    @property
    def link(self) -> str | None:
        return {"KVREF": "kv", "JSONREF": "json"}.get(self.type)


@dataclass
class Table:
    name: str
    columns: list[Column]
    primary_key: str
    autoincrement: bool = False
    indexes: dict[str, tuple[str, bool]] = field(default_factory=dict)  # name -> (column, unique)
    table_id: int = 0
    next_col: int = 0
    next_key: int = 1
    schema_version: int = 0
    parts: list[int] = field(default_factory=list)  # folders that hold the rows
    next_part: int = 0
    path: str | None = None  # of a table whose files another system wrote

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise errors.UnknownColumn(name)

    def indexed(self, name: str) -> bool:
        return name == self.primary_key or any(c == name for c, _ in self.indexes.values())

    def unique_columns(self) -> list[str]:
        return sorted({c for c, unique in self.indexes.values() if unique})


@dataclass
class View:
    name: str
    text: str


@dataclass
class Limits:
    columns: int = 128
    indexes: int = 16
    tables: int = 256
    text: int = 64 * 1024
    row: int = 512 * 1024
    default_limit: int = 1_000
    max_limit: int = 10_000
    sort_rows: int = 100_000
    scan_rows: int = 100_000
    joins: int = 8
    unindexed_joins: bool = False
    view_depth: int = 3


class Catalog:
    """Names of one domain. Tables and views share one namespace; ids are never used again."""

    def __init__(self, limits: Limits | None = None):
        self.limits = limits or Limits()
        self.entries: dict[str, Table | View] = {}
        self.next_table = 1

    def table(self, name: str) -> Table:
        found = self.entries.get(name)
        if found is None:
            raise errors.UnknownTable(name)
        if isinstance(found, View):
            raise errors.ReadOnlyView(name)
        return found

    def free(self, name: str) -> None:
        if name in self.entries:
            raise errors.AlreadyExists(name)

    # definitions

    def _column(self, table: Table, spec: S.ColumnSpec) -> Column:
        default, now = None, isinstance(spec.default, S.Now)
        if now and spec.type != "TIMESTAMP":
            raise errors.InvalidDefault(spec.name)
        if isinstance(spec.default, S.Literal) and spec.default.value is not None:
            default = spec.default.value
            fits = {"INTEGER": (int,), "REAL": (int, float), "TEXT": (str,), "BOOLEAN": (bool,), "TIMESTAMP": (str, int)}.get(spec.type, ())
            if not isinstance(default, fits) or (isinstance(default, bool) and spec.type != "BOOLEAN"):
                raise errors.InvalidDefault(spec.name)
        if spec.references is not None:
            target = table if spec.references == table.name else self.table(spec.references)
            key = next((c.type for c in target.columns if c.name == target.primary_key), spec.type)
            if key != spec.type:
                raise errors.TypeMismatch(spec.name)
        column = Column(spec.name, spec.type, table.next_col, not (spec.not_null or spec.primary_key), default, now, spec.references, table.schema_version)
        table.next_col += 1
        return column

    def create_table(self, statement: S.CreateTable) -> Table:
        self.free(statement.table)
        if sum(isinstance(e, Table) for e in self.entries.values()) >= self.limits.tables:
            raise errors.LimitExceeded("tables")
        if len(statement.columns) > self.limits.columns:
            raise errors.LimitExceeded("columns")
        names = [c.name for c in statement.columns]
        if len(set(names)) < len(names):
            raise errors.DuplicateName(statement.table)
        keys = [c for c in statement.columns if c.primary_key]
        if len(keys) != 1 or keys[0].type not in ("INTEGER", "TEXT") or (keys[0].autoincrement and keys[0].type != "INTEGER"):
            raise errors.SyntaxFault("a table has one primary key of type INTEGER or TEXT")
        table = Table(statement.table, [], keys[0].name, keys[0].autoincrement, table_id=self.next_table)
        for spec in sorted(statement.columns, key=lambda s: s.references is not None):
            table.columns.append(self._column(table, spec))
        table.columns.sort(key=lambda c: names.index(c.name))
        for spec in statement.columns:
            if spec.unique and not spec.primary_key:
                table.indexes[f"{table.name}_{spec.name}_unique"] = (spec.name, True)
        self.next_table += 1
        self.entries[table.name] = table
        return table

    def add_column(self, table: Table, spec: S.ColumnSpec) -> None:
        if spec.primary_key or spec.autoincrement or spec.unique:
            raise errors.SyntaxFault("an added column has no key and is not unique")
        if spec.not_null and not (isinstance(spec.default, S.Literal) and spec.default.value is not None):
            raise errors.InvalidDefault(spec.name)
        if any(c.name == spec.name for c in table.columns):
            raise errors.DuplicateName(spec.name)
        if len(table.columns) >= self.limits.columns:
            raise errors.LimitExceeded("columns")
        table.schema_version += 1
        table.columns.append(self._column(table, spec))

    def drop_column(self, table: Table, name: str) -> None:
        column = table.column(name)
        if name == table.primary_key or table.indexed(name):
            raise errors.DependencyConflict(name)
        table.columns.remove(column)

    def rename_column(self, table: Table, old: str, new: str) -> None:
        column = table.column(old)
        if any(c.name == new for c in table.columns):
            raise errors.DuplicateName(new)
        column.name = new
        table.primary_key = new if table.primary_key == old else table.primary_key
        table.indexes = {k: (new if c == old else c, u) for k, (c, u) in table.indexes.items()}

    def rename_table(self, table: Table, new: str) -> None:
        self.free(new)
        del self.entries[table.name]
        for other in self.entries.values():
            for c in getattr(other, "columns", []):
                c.references = new if c.references == table.name else c.references
        for c in table.columns:
            c.references = new if c.references == table.name else c.references
        table.name = new
        self.entries[new] = table

    def create_index(self, statement: S.CreateIndex) -> None:
        table = self.table(statement.table)
        table.column(statement.column)
        if any(statement.name in t.indexes for t in self.entries.values() if isinstance(t, Table)):
            raise errors.AlreadyExists(statement.name)
        if len(table.indexes) >= self.limits.indexes:
            raise errors.LimitExceeded("indexes")
        table.indexes[statement.name] = (statement.column, statement.unique)

    def drop(self, statement: S.Drop) -> Table | None:
        if statement.kind == "index":
            for t in self.entries.values():
                if isinstance(t, Table) and statement.name in t.indexes:
                    del t.indexes[statement.name]
                    return None
            raise errors.UnknownIndex(statement.name)
        found = self.entries.get(statement.name)
        if not isinstance(found, View if statement.kind == "view" else Table):
            raise errors.UnknownTable(statement.name)
        if statement.kind == "table":
            users = sorted(t.name for t in self.entries.values() if isinstance(t, Table) and t is not found and any(c.references == found.name for c in t.columns))
            if users:
                raise errors.DependencyConflict(", ".join(users))
        del self.entries[statement.name]
        return found if isinstance(found, Table) else None

    # storage

    def dump(self) -> dict:
        return {"next_table": self.next_table, "entries": [asdict(e) | {"kind": type(e).__name__} for e in self.entries.values()]}

    def load(self, data: dict) -> None:
        self.next_table, self.entries = data["next_table"], {}
        for e in data["entries"]:
            if e.pop("kind") == "View":
                self.entries[e["name"]] = View(**e)
            else:
                e["columns"] = [Column(**c) for c in e["columns"]]
                e["indexes"] = {k: tuple(v) for k, v in e["indexes"].items()}
                self.entries[e["name"]] = Table(**e)

    def describe(self) -> list[dict]:
        """Catalog browse: tables with their columns and indexes, views with their text."""
        out = []
        for e in sorted(self.entries.values(), key=lambda e: e.name):
            if isinstance(e, View):
                out.append({"name": e.name, "kind": "view", "sql": e.text})
            else:
                out.append({"name": e.name, "kind": "table", "primary_key": e.primary_key, "columns": [{"name": c.name, "type": c.type, "nullable": c.nullable, "references": c.references} for c in e.columns], "indexes": [{"name": k, "column": c, "unique": u} for k, (c, u) in sorted(e.indexes.items())]})
        return out
