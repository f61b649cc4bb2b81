"""From a checked statement to a DataFrame.

Binding refuses what the dialect refuses (types, NULL comparisons, names, join rules, limits) before any
Column exists; what is left is a left-deep plan over scans, which Catalyst prunes, pushes down
and orders. Columns have internal names until the last projection, so joins may have equal output names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import errors
from plumbline.functions import timestamps
from plumbline.plans import syntax as S
from plumbline.plans.catalog import Catalog, Column, Table, View
from plumbline.plans.parser import parse

TEXTUAL = ("TEXT", "KVREF", "JSONREF")


@dataclass(frozen=True)
class Ref:
    """A column of a binding."""

    binding: int
    column: str
    type: str

    @property
    def internal(self) -> str:
        return f"__b{self.binding}_{self.column}"


@dataclass
class Flat:
    """A query over base tables only: views are inlined."""

    tables: list[Table] = field(default_factory=list)
    joins: list[tuple[Ref, Ref]] = field(default_factory=list)  # (column of an earlier table, column of the new one)
    wheres: list[tuple[object, dict[str, dict[str, Ref]]]] = field(default_factory=list)
    scopes: dict[str, dict[str, Ref]] = field(default_factory=dict)


@dataclass
class Planned:
    frame: DataFrame
    names: list[str]
    refs: list[Ref]
    flat: Flat
    ordered: bool
    rows: DataFrame | None = None  # those of a query with an order, before it


class Planner:
    def __init__(self, catalog: Catalog, scan: Callable[[Table], DataFrame]):
        self.catalog, self.scan = catalog, scan

    # names

    def _scope(self, flat: Flat, source: S.Source, depth: int, joined: bool) -> dict[str, Ref]:
        """Add a table or a view to ``flat``; what its alias stands for."""
        entry = self.catalog.entries.get(source.table)
        if entry is None:
            raise errors.UnknownTable(source.table)
        if isinstance(entry, Table):
            flat.tables.append(entry)
            k = len(flat.tables) - 1
            return {c.name: Ref(k, c.name, c.type) for c in entry.columns}
        if depth >= self.catalog.limits.view_depth:
            raise errors.LimitExceeded("view_depth")
        select = parse(entry.text)
        if joined and select.where is not None:
            raise errors.InvalidView(f"{entry.name} has a filter and can't be joined")
        return self._inline(flat, select, depth + 1)

    def _inline(self, flat: Flat, select: S.Select, depth: int) -> dict[str, Ref]:
        scopes = self._flatten(flat, select, depth)
        return {name: ref for name, ref in self._outputs(scopes, select)}

    def _flatten(self, flat: Flat, select: S.Select, depth: int, first: dict[str, Ref] | None = None) -> dict[str, dict[str, Ref]]:
        scopes = {select.source.alias: first if first is not None else self._scope(flat, select.source, depth, False)}
        for join in select.joins:
            if join.source.alias in scopes:
                raise errors.DuplicateAlias(join.source.alias)
            root = len(flat.tables)
            held = len(flat.joins)
            new = self._scope(flat, join.source, depth, True)
            inner = flat.joins[held:]
            del flat.joins[held:]
            both = scopes | {join.source.alias: new}
            sides = [self._resolve(both, n) for n in (join.left, join.right)]
            fresh = [s for s, n in zip(sides, (join.left, join.right), strict=True) if s.binding >= root]
            if len(fresh) != 1:
                raise errors.InvalidJoin("ON needs one column of the new table and one of an earlier table")
            if fresh[0].binding != root:
                raise errors.UnknownColumn(str(fresh[0].column))
            earlier = sides[0] if sides[1] is fresh[0] else sides[1]
            self._check_on(flat, earlier, fresh[0])
            flat.joins += [(earlier, fresh[0]), *inner]
            scopes = both
        if len(flat.joins) > self.catalog.limits.joins:
            raise errors.JoinDepthExceeded(len(flat.joins))
        if select.where is not None:
            flat.wheres.append((select.where, scopes))
        return scopes

    def _check_on(self, flat: Flat, earlier: Ref, new: Ref) -> None:
        same = earlier.type == new.type or (earlier.type in TEXTUAL and new.type in TEXTUAL)
        if not same and (earlier.type, new.type) != ("INTEGER", "REAL"):
            raise errors.TypeMismatch(f"{earlier.type} and {new.type}")
        if not flat.tables[new.binding].indexed(new.column) and not self.catalog.limits.unindexed_joins:
            raise errors.UnindexedJoin(f"{flat.tables[new.binding].name}.{new.column}")

    def _resolve(self, scopes: dict[str, dict[str, Ref]], name: S.Name) -> Ref:
        if name.table is not None:
            if name.table not in scopes:
                raise errors.UnknownTable(name.table)
            if name.column not in scopes[name.table]:
                raise errors.UnknownColumn(str(name))
            return scopes[name.table][name.column]
        found = [s[name.column] for s in scopes.values() if name.column in s]
        if len(found) > 1:
            raise errors.AmbiguousColumn(name.column)
        if not found:
            raise errors.UnknownColumn(name.column)
        return found[0]

    def _outputs(self, scopes: dict[str, dict[str, Ref]], select: S.Select) -> list[tuple[str, Ref]]:
        if select.items is None:
            return [(n, r) for s in scopes.values() for n, r in s.items()]
        return [(out, self._resolve(scopes, n)) for n, out in select.items]

    # predicates

    def _typed(self, scopes, x, params, hint: str | None):
        """(type, value or Ref) of an operand."""
        if isinstance(x, S.Name):
            ref = self._resolve(scopes, x)
            return ref.type, ref
        value = params[x.index] if isinstance(x, S.Param) else x.value
        if value is None:
            raise errors.NullComparison("compare with IS NULL")
        if hint is None:
            return {bool: "BOOLEAN", int: "INTEGER", float: "REAL", str: "TEXT"}[type(value)], value
        return coerce(value, hint, comparing=True)

    def compare(self, scopes, p: S.Compare, params, column: Callable[[Ref], SparkColumn], positive: bool) -> SparkColumn:
        names = [x for x in (p.left, p.right) if isinstance(x, S.Name)]
        hint = self._resolve(scopes, names[0]).type if names else None
        (lt, left), (rt, right) = (self._typed(scopes, x, params, hint) for x in (p.left, p.right))
        numeric = {lt, rt} <= {"INTEGER", "REAL"}
        if not (lt == rt or numeric or (lt in TEXTUAL and rt in TEXTUAL)):
            raise errors.TypeMismatch(f"{lt} and {rt}")
        a, b = (self._value(x, t, other, column) for x, t, other in ((left, lt, right), (right, rt, left)))
        out = {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[p.op]
        for x, t in ((left, lt), (right, rt)):
            if t == "REAL" and isinstance(x, Ref) and p.op not in ("=", "<", "<="):
                # not-a-number compares as unknown; a plain conjunct keeps its pushdown
                out = out & (~F.isnan(column(x)) if positive else F.when(F.isnan(column(x)), F.lit(None)).otherwise(True))
        return out

    @staticmethod
    def _value(x, kind: str, other, column) -> SparkColumn:
        if isinstance(x, Ref):
            return column(x)
        if kind == "TIMESTAMP":
            return F.lit(timestamps.from_millis(x)).cast("timestamp_ntz")
        return F.lit(x)

    def predicate(self, scopes, p, params, column: Callable[[Ref], SparkColumn], positive: bool = True) -> SparkColumn:
        if isinstance(p, S.Logic):
            if p.op == "not":
                return ~self.predicate(scopes, p.parts[0], params, column, False)
            parts = [self.predicate(scopes, x, params, column, positive) for x in p.parts]
            out = parts[0]
            for x in parts[1:]:
                out = (out & x) if p.op == "and" else (out | x)
            return out
        if isinstance(p, S.Compare):
            return self.compare(scopes, p, params, column, positive)
        if isinstance(p, S.IsNull):
            if not isinstance(p.operand, S.Name):
                raise errors.SyntaxFault("IS NULL needs a column")
            c = column(self._resolve(scopes, p.operand))
            return c.isNotNull() if p.negated else c.isNull()
        if not isinstance(p.operand, S.Name):
            raise errors.SyntaxFault("IN and LIKE need a column")
        ref = self._resolve(scopes, p.operand)
        if isinstance(p, S.Like):
            if ref.type not in TEXTUAL:
                raise errors.TypeMismatch(f"LIKE on {ref.type}")
            out = column(ref).like(p.pattern.replace("\\", "\\\\"))
        else:
            items = []
            for x in p.items:
                kind, value = self._typed(scopes, x, params, ref.type)
                items.append(self._value(value, kind, None, column))
            out = column(ref).isin(*items)
        return ~out if p.negated else out

    # plans

    def plan(self, select: S.Select, params: tuple = ()) -> Planned:
        """The rows of a query; ordered, and without its limit."""
        if select.params != len(params):
            raise errors.ParameterCount(f"{select.params} wanted, {len(params)} given")
        flat = Flat()
        scopes = self._flatten(flat, select, 0)
        column = lambda r: F.col(r.internal)
        # every filter and name is checked before the first scan
        if select.count and flat.joins:
            return Planned(self._count(flat, [self._conjunct(s, p, params) for w, s in flat.wheres for p in conjuncts(w)]), ["count"], [], flat, False)
        wheres = [self.predicate(s, w, params, column) for w, s in flat.wheres]
        outputs = [] if select.count else self._outputs(scopes, select)
        order = [] if select.count else [(self._resolve(scopes, n), down) for n, down in select.order]
        frame = self._bound(flat, 0)
        for k, (earlier, new) in enumerate(flat.joins, 1):
            frame = frame.join(self._bound(flat, k), self._on(earlier, new), "left")
        for w in wheres:
            frame = frame.where(w)
        if select.count:
            return Planned(frame.agg(F.count(F.lit(1)).alias("count")), ["count"], [], flat, False)
        unsorted = frame
        if order:
            keys = [column(r).desc_nulls_first() if down else column(r).asc_nulls_last() for r, down in order]
            # ties stay in the order of a scan, which is by primary key
            frame = frame.orderBy(*keys, column(Ref(0, flat.tables[0].primary_key, "")).asc_nulls_last())
        return Planned(frame.select(*[column(r).alias(f"__o{i}") for i, (_, r) in enumerate(outputs)]).toDF(*[n for n, _ in outputs]), [n for n, _ in outputs], [r for _, r in outputs], flat, bool(order), unsorted)

    @staticmethod
    def _on(earlier: Ref, new: Ref) -> SparkColumn:
        left = F.col(earlier.internal)
        return (left.cast("double") if (earlier.type, new.type) == ("INTEGER", "REAL") else left) == F.col(new.internal)

    def _conjunct(self, scopes, p, params) -> tuple[SparkColumn, set[Ref]]:
        """A filter, and the columns that it reads."""
        read: set[Ref] = set()
        return self.predicate(scopes, p, params, lambda r: read.add(r) or F.col(r.internal)), read

    def _count(self, flat: Flat, filters: list[tuple[SparkColumn, set[Ref]]]) -> DataFrame:
        """The number of joined rows, which are not made: rows that agree in all columns still to be read are one row
        with their number, in each table before its join and in what a join gives, so a common key costs no product."""
        at = [max((r.binding for r in read), default=0) for _, read in filters]  # a filter stands after the join of the last table it reads

        def read_after(k: int) -> set[Ref]:
            return {e for e, _ in flat.joins[k:]}.union(*(read for (_, read), j in zip(filters, at, strict=True) if j > k))

        def packed(frame: DataFrame, root: int, refs: set[Ref], number: SparkColumn, name: str) -> DataFrame:
            keys = [F.col(r.internal) for r in sorted(refs, key=lambda r: (r.binding, r.column))]
            if any(r.binding == root and r.column == flat.tables[root].primary_key for r in refs):
                return frame.select(*keys, number.alias(name))  # no two rows agree
            return frame.groupBy(*keys).agg(F.sum(number).alias(name))

        one = F.lit(1).cast("long")
        frame = self._bound(flat, 0)
        for k in range(len(flat.tables)):
            number = one
            if k:
                earlier, new = flat.joins[k - 1]
                refs = {new} | {r for r in read_after(k - 1) | read_after(k) if r.binding == k}
                frame = frame.join(packed(self._bound(flat, k), k, refs, one, "__m"), self._on(earlier, new), "left")
                number = F.col("__n") * F.coalesce(F.col("__m"), one)
            for (condition, _), j in zip(filters, at, strict=True):
                if j == k:
                    frame = frame.where(condition)
            if k < len(flat.joins):
                frame = packed(frame, 0, {r for r in read_after(k) if r.binding <= k}, number, "__n")
        return frame.agg(F.coalesce(F.sum(number), F.lit(0)).alias("count"))

    def _bound(self, flat: Flat, k: int) -> DataFrame:
        table = flat.tables[k]
        return self.scan(table).select(*[F.col(c.name).alias(f"__b{k}_{c.name}") for c in table.columns])

    def check_view(self, select: S.Select) -> None:
        if select.order or select.limit is not None or select.count or select.params:
            raise errors.InvalidView("a view has no ORDER BY, LIMIT, COUNT or parameter")
        flat = Flat()
        scopes = self._flatten(flat, select, 1)
        names = [n for n, _ in self._outputs(scopes, select)]
        if len(set(names)) < len(names):
            raise errors.InvalidView("output names repeat")
        for w, s in flat.wheres:
            self.predicate(s, w, (), lambda r: F.col(r.internal))

    def broken_views(self) -> list[str]:
        """Views that the catalog as it stands can't bind."""
        out = []
        for e in self.catalog.entries.values():
            if isinstance(e, View):
                try:
                    self.check_view(parse(e.text))
                except errors.EngineError:
                    out.append(e.name)
        return sorted(out)


def conjuncts(p) -> list:
    return [x for part in p.parts for x in conjuncts(part)] if isinstance(p, S.Logic) and p.op == "and" else [p]


def coerce(value, kind: str, comparing: bool = False):
    """(type, value) of a literal for a column: what the dialect's matrix allows and nothing else."""
    if isinstance(value, bool):
        if kind == "BOOLEAN":
            return kind, value
    elif isinstance(value, int):
        if kind in ("INTEGER", "TIMESTAMP"):
            return kind, value
        if kind == "REAL":
            return kind, float(value)
    elif isinstance(value, float):
        if kind == "REAL":
            return kind, value
        if kind == "INTEGER" and comparing:
            return "REAL", value
    elif isinstance(value, str):
        if kind in TEXTUAL:
            return kind, value
        if kind == "TIMESTAMP":
            return kind, timestamps.parse(value)
    raise errors.TypeMismatch(f"{value!r} for {kind}")


SPARK_TYPES = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampNTZType(), "KVREF": T.StringType(), "JSONREF": T.StringType()}


def declared(schema: T.StructType) -> list[Column]:
    """Columns of the dialect for a Parquet schema; types that the dialect lacks can't be declared."""
    out = []
    for i, f in enumerate(schema.fields):
        kind = {"int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}.get(f.dataType.simpleString())
        if kind is None:
            raise errors.TypeMismatch(f"{f.name} {f.dataType.simpleString()}")
        out.append(Column(f.name, kind, i, f.nullable))
    return out
