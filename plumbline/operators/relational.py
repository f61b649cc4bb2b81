"""The relational engine of one domain: queries, changes with their checks, and definitions.

A table's data lies in part folders listed in the catalog, with physical columns named by column id and the
schema version that wrote the row. An insertion writes one more part, another change rewrites the parts as one; then the catalog file
is replaced, so a reader sees all of a statement or nothing. There is one writer.
"""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import errors
from plumbline.functions import timestamps
from plumbline.operators import links
from plumbline.plans import syntax as S
from plumbline.plans.catalog import Catalog, Column, Limits, Table, View
from plumbline.plans.parser import parse
from plumbline.plans.planner import SPARK_TYPES, Planned, Planner, coerce, declared
from plumbline.sources.store import Store


MAX_INTEGER = (1 << 63) - 1


@dataclass
class SelectResult:
    columns: list[str]
    rows: list[tuple]
    limit_applied: bool
    expanded: list[dict] | None = None

    @property
    def row_count(self) -> int:
        return len(self.rows)


@dataclass
class ChangeResult:
    affected: int
    last_pk: object = None


class Relational:
    def __init__(self, spark: SparkSession, root: str | None = None, limits: Limits | None = None, kv=None, docs=None):
        """``kv`` and ``docs`` are the same-named domains of the other engines, None if they are gone."""
        self.spark, self.kv, self.docs = spark, kv, docs
        self.catalog = Catalog(limits)
        self.planner = Planner(self.catalog, self.scan)
        self.store = Store(spark, root) if root else None
        if self.store and self.store.exists(self.store.at("catalog.json")):
            self.catalog.load(json.loads(self.store.read(self.store.at("catalog.json"))))

    # scans

    def register(self, name: str, path: str, primary_key: str, indexes: tuple = (), references: dict | None = None) -> Table:
        """Declare Parquet files of another system as a read-only table."""
        self.catalog.free(name)
        columns = declared(self.spark.read.parquet(path).schema)
        for c in columns:
            c.references = (references or {}).get(c.name)
        table = Table(name, columns, primary_key, indexes={f"{name}_{c}": (c, False) for c in indexes}, path=path)
        self.catalog.entries[name] = table
        return table

    def _folder(self, table: Table, part: int) -> str:
        return self.store.at("data", table.table_id, f"p{part}")

    def _physical(self, table: Table) -> T.StructType:
        return T.StructType([T.StructField("__schema", T.IntegerType()), *(T.StructField(f"c{c.col_id}", SPARK_TYPES[c.type]) for c in table.columns)])

    def scan(self, table: Table, masked: bool = True, parts: list[int] | None = None, number: bool = False) -> DataFrame:
        """All rows under declared names. A column that is younger than a row reads as its literal default; link cells of a domain that is gone read as null."""
        if table.path:
            frame = self.spark.read.parquet(table.path)
        elif not table.parts:
            frame = self._named(self.spark.createDataFrame([], self._physical(table)), table)
        else:
            held = self.spark.read.schema(self._physical(table)).parquet(*[self._folder(table, p) for p in (table.parts if parts is None else parts)])
            part = [F.regexp_extract(F.col("_metadata.file_path"), "/p([0-9]+)/[^/]*$", 1).cast("int").alias("__part")] if number else []
            frame = self._named(held, table, part)
        return links.mask(frame, table, self.kv is None, self.docs is None) if masked else frame

    @staticmethod
    def _named(frame: DataFrame, table: Table, more: list | None = None) -> DataFrame:
        out = list(more or [])
        for c in table.columns:
            value = F.col(f"c{c.col_id}")
            if c.since and c.default is not None:
                _, default = coerce(c.default, c.type)
                value = F.when(F.col("__schema") < c.since, Planner._value(default, c.type, None, None)).otherwise(value)
            out.append(value.cast(SPARK_TYPES[c.type]).alias(c.name))
        return frame.select(*out)

    # queries

    def dataframe(self, sql: str, params: tuple = ()) -> DataFrame:
        """The rows of a query as a DataFrame, with the limit it states and no other."""
        statement = self._parsed(sql, S.Select)
        planned = self.planner.plan(statement, params)
        frame = planned.frame
        if not statement.count and statement.limit is not None:
            frame = (frame.offset(statement.offset) if statement.offset else frame).limit(statement.limit)
        return frame

    @staticmethod
    def _parsed(sql: str, kind: type):
        statement = parse(sql)
        if not isinstance(statement, kind):
            raise errors.SyntaxFault(f"not a {kind.__name__}")
        return statement

    def execute(self, sql: str, params: tuple = (), expand: str | list[str] | None = None, granted: str = "ddl"):
        """Run one statement, with the default and the greatest limit, the sort cap and the scan budget of joins."""
        statement = parse(sql)
        if not S.permitted(granted, statement):
            raise errors.Forbidden(S.access(statement))
        if isinstance(statement, S.Select):
            return self._select(statement, params, expand)
        if expand:
            raise errors.InvalidExpand("only a query has results to expand")
        if self.store is None:
            raise errors.ReadOnlyView("this catalog is read-only")
        if isinstance(statement, (S.Insert, S.Update, S.Delete)):
            if statement.params != len(params):
                raise errors.ParameterCount(f"{statement.params} wanted, {len(params)} given")
            return {S.Insert: self.insert, S.Update: self.update, S.Delete: self.delete}[type(statement)](statement, params)
        self._define(statement)
        return ChangeResult(0)

    def _select(self, statement: S.Select, params: tuple, expand) -> SelectResult:
        planned = self.planner.plan(statement, params)
        limits = self.catalog.limits
        self._budget(planned)
        if statement.count:
            return SelectResult(["count"], [tuple(planned.frame.head())], False)
        # a count of the rows before they are sorted, which stops early
        if planned.ordered and (n := planned.rows.limit(limits.sort_rows + 1).count()) > limits.sort_rows:
            raise errors.SortBufferExceeded(n, limits.sort_rows)
        wanted = limits.default_limit if statement.limit is None else statement.limit
        take = min(wanted, limits.max_limit)
        capped = statement.limit is not None and wanted > limits.max_limit
        frame = planned.frame.offset(statement.offset) if statement.offset else planned.frame
        targets = links.targets(planned, expand, len(planned.flat.joins), limits.joins) if expand else []
        frame = frame.limit(take + 1)
        frame = links.expand(frame, planned, targets, self, bounded=True) if targets else frame
        rows = [tuple(r) for r in frame.collect()]
        more = len(rows) > take
        width = len(planned.names)
        rows = rows[:take]
        expanded = [dict(zip([planned.names[t] for t in targets], map(_loaded, r[width:]), strict=True)) for r in rows] if targets else None
        return SelectResult(planned.names, [r[:width] for r in rows], capped or more, expanded)

    def _budget(self, planned: Planned) -> None:
        """Joins on columns without an index may read so many rows altogether."""
        limits, spent = self.catalog.limits, 0
        for _, new in planned.flat.joins:
            table = planned.flat.tables[new.binding]
            if not table.indexed(new.column):
                spent += self.scan(table).limit(limits.scan_rows + 1).count()
                if spent > limits.scan_rows:
                    raise errors.ScanBudgetExceeded(limits.scan_rows)

    def browse(self, table: str, filters: dict[str, str] | None = None, limit: int | None = None, offset: int = 0) -> SelectResult:
        """Rows of a table by equalities, whose texts are read as the columns' types."""
        entry = self.catalog.table(table)
        filters = {k.lower(): v for k, v in (filters or {}).items()}
        wheres = [S.Compare("=", S.Name(None, k), S.Literal(from_text(v, entry.column(k).type))) for k, v in sorted(filters.items())]
        where = reduce(lambda a, b: S.Logic("and", (a, b)), wheres) if wheres else None
        return self._select(S.Select(None, False, S.Source(table, table), (), where, (), limit, offset), (), None)

    # changes

    def _commit(self, table: Table, frame: DataFrame, append: bool = False, instead: list[int] | None = None) -> None:
        part = table.next_part
        physical = frame.select(F.lit(table.schema_version).alias("__schema"), *[F.col(c.name).cast(SPARK_TYPES[c.type]).alias(f"c{c.col_id}") for c in table.columns])
        physical.write.mode("overwrite").parquet(self._folder(table, part))
        kept = table.parts if append else [p for p in table.parts if instead is not None and p not in instead]
        table.parts, table.next_part = [*kept, part], part + 1
        self._save()

    def vacuum(self, name: str, merge: bool = True) -> int:
        """Merge a table's parts into one and delete the folders that no longer hold rows; how many those were."""
        table = self._writable(name)
        if merge and len(table.parts) > 1:
            self._commit(table, self.scan(table, masked=False))
        gone = [p for p in range(table.next_part) if p not in table.parts and self.store.exists(self._folder(table, p))]
        for p in gone:
            self.store.delete(self._folder(table, p))
        return len(gone)

    def _save(self) -> None:
        self.store.write(self.store.at("catalog.json"), json.dumps(self.catalog.dump()))

    def _writable(self, name: str) -> Table:
        table = self.catalog.table(name)
        if table.path:
            raise errors.ReadOnlyView(name)
        return table

    def _cell(self, column: Column, value) -> object:
        if value is None:
            if not column.nullable:
                raise errors.NotNullViolation(column.name)
            return None
        _, found = coerce(value, column.type)
        if isinstance(found, str) and len(found.encode()) > self.catalog.limits.text:
            raise errors.TextTooLong(column.name)
        return timestamps.from_millis(found) if column.type == "TIMESTAMP" else found

    def _rows(self, table: Table, rows: list[list]) -> DataFrame:
        return self.spark.createDataFrame([tuple(r) for r in rows], T.StructType([T.StructField(c.name, SPARK_TYPES[c.type]) for c in table.columns]))

    def insert(self, statement: S.Insert, params: tuple = ()) -> ChangeResult:
        table = copy.deepcopy(self._writable(statement.table))
        names = list(statement.columns or [c.name for c in table.columns])
        if len(set(names)) < len(names):
            raise errors.DuplicateName(statement.table)
        for n in names:
            table.column(n)
        now = int(datetime.now(timezone.utc).timestamp() * 1000)
        rows = []
        for values in statement.rows:
            if len(values) != len(names):
                raise errors.ArityMismatch(len(values))
            given = {n: (params[v.index] if isinstance(v, S.Param) else v.value) for n, v in zip(names, values, strict=True)}
            row = []
            for c in table.columns:
                if c.name == table.primary_key and table.autoincrement:
                    key = given.get(c.name)
                    if key is None and table.next_key > MAX_INTEGER:
                        raise errors.SequenceExhausted(table.name)
                    key = table.next_key if key is None else key
                    row.append(self._cell(c, key))
                    table.next_key = max(table.next_key, key + 1)
                else:
                    row.append(self._cell(c, given[c.name] if c.name in given else now if c.default_now else c.default))
            if sum(_width(v) for v in row) > self.catalog.limits.row:
                raise errors.RowTooLarge(table.name)
            rows.append(row)
        new, old = self._rows(table, rows), self.scan(table, masked=False)
        self._check_keys(table, old, new)
        self._check_links(table, new, [c.name for c in table.columns])
        self.catalog.entries[table.name] = table
        self._commit(table, new, append=True)
        key = [c.name for c in table.columns].index(table.primary_key)
        return ChangeResult(len(rows), rows[0][key] if len(rows) == 1 else None)

    def append(self, name: str, rows: DataFrame) -> ChangeResult:
        """Insert a DataFrame's rows, by name, with the checks of an insertion: columns it lacks take their defaults, all checks run on executors."""
        table = copy.deepcopy(self._writable(name))
        now, limits = int(datetime.now(timezone.utc).timestamp() * 1000), self.catalog.limits
        for c in rows.columns:
            table.column(c)
        cells = []
        for c in table.columns:
            kind = SPARK_TYPES[c.type]
            given = F.col(c.name) if c.name in rows.columns else F.lit(self._cell(c, now if c.default_now else c.default))
            cells.append(given.cast(kind).alias(c.name))
        new, old = rows.select(*cells), self.scan(table, masked=False)
        texts = [c.name for c in table.columns if isinstance(SPARK_TYPES[c.type], T.StringType)]
        width = sum((F.coalesce(F.octet_length(c.name), F.lit(0)) if c.name in texts else F.lit(8) for c in table.columns), F.lit(0))
        needed = [c.name for c in table.columns if not c.nullable]
        checks = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(needed)] + [F.max(F.octet_length(c)).alias(f"t{i}") for i, c in enumerate(texts)]
        seen = new.agg(F.count(F.lit(1)).alias("rows"), F.max(width).alias("width"), F.max(table.primary_key).alias("key"), *checks).head()
        for i, c in enumerate(needed):
            if seen[f"n{i}"]:
                raise errors.NotNullViolation(c)
        for i, c in enumerate(texts):
            if (seen[f"t{i}"] or 0) > limits.text:
                raise errors.TextTooLong(c)
        if (seen["width"] or 0) > limits.row:
            raise errors.RowTooLarge(name)
        self._check_keys(table, old, new)
        self._check_links(table, new, [c.name for c in table.columns])
        if table.autoincrement and seen["key"] is not None:
            table.next_key = max(table.next_key, seen["key"] + 1)
        self.catalog.entries[table.name] = table
        self._commit(table, new, append=True)
        return ChangeResult(seen["rows"])

    def _check_keys(self, table: Table, old: DataFrame, new: DataFrame) -> None:
        if duplicate_keys(old, new, table.primary_key).head(1):
            raise errors.DuplicateKey(table.name)
        for column in table.unique_columns():
            if duplicate_keys(old, new, column).head(1):
                raise errors.UniqueViolation(column)

    def _check_links(self, table: Table, rows: DataFrame, changed: list[str]) -> None:
        for c in table.columns:
            if c.name not in changed:
                continue
            if c.references:
                target = self.catalog.table(c.references)
                if missing_references(rows, c.name, self.scan(target), target.primary_key).head(1):
                    raise errors.ReferenceViolation(c.name)
            if c.link:
                domain = self.kv if c.link == "kv" else self.docs
                live = domain.keys() if domain is not None else self.spark.createDataFrame([], "key string")
                if missing_references(rows, c.name, live, "key").head(1):
                    raise errors.LinkViolation(c.name)

    def _matching(self, table: Table, where, params):
        scope = {table.name: {c.name: _ref(c) for c in table.columns}}
        return F.lit(True) if where is None else self.planner.predicate(scope, where, params, lambda r: F.col(r.column), False)

    def update(self, statement: S.Update, params: tuple = ()) -> ChangeResult:
        table = self._writable(statement.table)
        sets = {}
        for name, value in statement.sets:
            column = table.column(name)
            if name == table.primary_key:
                raise errors.ImmutableKey(name)
            if name in sets:
                raise errors.DuplicateName(name)
            sets[name] = self._cell(column, params[value.index] if isinstance(value, S.Param) else value.value)
        values = {k: F.lit(v).cast(SPARK_TYPES[table.column(k).type]) for k, v in sets.items()}
        hit = self._matching(table, statement.where, params)
        touched, affected = self._touched(table, hit)
        if affected:
            after = updated(self.scan(table, masked=False), hit, values)
            for column in table.unique_columns():
                if column in sets and after.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").head(1):
                    raise errors.UniqueViolation(column)
            self._check_links(table, after.where("__hit"), list(sets))
            self._commit(table, updated(self.scan(table, masked=False, parts=touched), hit, values).drop("__hit"), instead=touched)
        return ChangeResult(affected)

    def _touched(self, table: Table, hit) -> tuple[list[int], int]:
        """The parts that hold rows to change, which alone are written anew, and how many rows those are."""
        if not table.parts:
            return [], 0
        rows = self.scan(table, masked=False, number=True).where(hit)
        found = {int(r["__part"]): r["count"] for r in rows.groupBy("__part").count().collect()}  # one row for each part
        return sorted(found), sum(found.values())

    def delete(self, statement: S.Delete, params: tuple = ()) -> ChangeResult:
        table = self._writable(statement.table)
        hit = self._matching(table, statement.where, params)
        touched, affected = self._touched(table, hit)
        if affected:
            self._commit(table, remaining(self.scan(table, masked=False, parts=touched), hit), instead=touched)
        return ChangeResult(affected)

    # rows by key

    def insert_row(self, table: str, body: dict) -> ChangeResult:
        body = _lowered(body)
        return self.insert(S.Insert(table, tuple(body), (tuple(S.Literal(v) for v in body.values()),)))

    def update_row(self, table: str, key, body: dict) -> ChangeResult:
        body, entry = _lowered(body), self._writable(table)
        if body.get(entry.primary_key, key) != key:
            raise errors.ImmutableKey(entry.primary_key)
        sets = tuple((k, S.Literal(v)) for k, v in body.items() if k != entry.primary_key)
        return self.update(S.Update(table, sets, S.Compare("=", S.Name(None, entry.primary_key), S.Literal(key))))

    def delete_row(self, table: str, key) -> ChangeResult:
        entry = self._writable(table)
        return self.delete(S.Delete(table, S.Compare("=", S.Name(None, entry.primary_key), S.Literal(key))))

    def null_out(self, kinds: tuple[str, ...] = ("kv", "json")) -> int:
        """Set link cells whose domain is gone to null for good; how many cells that were."""
        cells = 0
        for table in [t for t in self.catalog.entries.values() if isinstance(t, Table) and not t.path]:
            gone = [c for c in table.columns if c.link in kinds and (self.kv if c.link == "kv" else self.docs) is None]
            if gone:
                rows = self.scan(table, masked=False)
                held = rows.agg(*[F.count(c.name).alias(c.name) for c in gone]).head()
                if sum(held):
                    cells += sum(held)
                    self._commit(table, rows.withColumns({c.name: F.lit(None).cast("string") for c in gone}))
        return cells

    # definitions

    def _define(self, statement) -> None:
        before = copy.deepcopy(self.catalog.entries)
        try:
            dropped = self._apply(statement)
            if broken := self.planner.broken_views():
                raise errors.DependencyConflict(", ".join(broken))
        except errors.EngineError:
            self.catalog.entries.clear()
            self.catalog.entries.update(before)
            raise
        self._save()
        if dropped is not None and dropped.parts:
            self.store.delete(self.store.at("data", dropped.table_id))

    def _apply(self, statement) -> Table | None:
        catalog = self.catalog
        if isinstance(statement, S.CreateTable):
            catalog.create_table(statement)
        elif isinstance(statement, S.CreateIndex):
            catalog.create_index(statement)
            if statement.unique:
                rows = self.scan(catalog.table(statement.table), masked=False)
                if rows.where(F.col(statement.column).isNotNull()).groupBy(statement.column).count().where("count > 1").head(1):
                    raise errors.UniqueViolation(statement.column)
        elif isinstance(statement, S.CreateView):
            catalog.free(statement.name)
            self.planner.check_view(statement.select)
            catalog.entries[statement.name] = View(statement.name, statement.text)
        elif isinstance(statement, S.Drop):
            return catalog.drop(statement)
        elif isinstance(statement, S.Alter):
            table = self._writable(statement.table)
            if statement.action == "add":
                catalog.add_column(table, statement.spec)
            elif statement.action == "drop":
                catalog.drop_column(table, statement.column)
            elif statement.action == "rename_column":
                catalog.rename_column(table, statement.column, statement.to)
            else:
                catalog.rename_table(table, statement.to)
        return None


def _ref(c: Column):
    from plumbline.plans.planner import Ref

    return Ref(0, c.name, c.type)


def _width(value) -> int:
    """Bytes of a cell: of a text its UTF-8, of a truth one, of other values eight."""
    return 0 if value is None else len(value.encode()) if isinstance(value, str) else 1 if isinstance(value, bool) else 8


def _loaded(text: str | None):
    return None if text is None else json.loads(text)


def _lowered(body: dict) -> dict:
    out = {k.lower(): v for k, v in body.items()}
    if len(out) < len(body):
        raise errors.DuplicateName("body")
    return out


def from_text(text: str, kind: str):
    """A query parameter's text as a value of a column's type; a timestamp is milliseconds or ISO-8601."""
    try:
        if kind == "INTEGER":
            return int(text)
        if kind == "REAL":
            return float(text)
        if kind == "BOOLEAN":
            return {"true": True, "false": False}[text.lower()]
        if kind == "TIMESTAMP":
            return int(text) if text.lstrip("-").isdigit() else timestamps.parse(text)
    except (ValueError, KeyError) as e:
        raise errors.TypeMismatch(f"{text!r} for {kind}") from e
    return text


def duplicate_keys(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Values that ``new`` repeats or shares with ``old``; null is no value."""
    values = new.where(F.col(column).isNotNull()).select(column)
    return values.groupBy(column).count().where("count > 1").select(column).unionByName(values.join(old.select(column), column, "left_semi"))


def missing_references(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows with a value that is no key of ``target``; null refers to nothing."""
    return rows.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")


def updated(rows: DataFrame, hit, sets: dict) -> DataFrame:
    """All rows with values set where ``hit`` is true, and __hit."""
    rows = rows.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    return rows.withColumns({k: F.when(F.col("__hit"), v).otherwise(F.col(k)) for k, v in sets.items()})


def remaining(rows: DataFrame, hit) -> DataFrame:
    """Rows for which ``hit`` is false or unknown."""
    return rows.where(~F.coalesce(hit, F.lit(False)))
