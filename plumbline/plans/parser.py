"""Recursive descent over one statement."""

from __future__ import annotations

from plumbline import errors
from plumbline.plans import syntax as S
from plumbline.plans.lexer import tokens

# Names of the types.
TYPES = {
    "integer": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "real": "REAL", "float": "REAL", "double": "REAL", "text": "TEXT", "varchar": "TEXT", "char": "TEXT", "boolean": "BOOLEAN", "bool": "BOOLEAN", "timestamp": "TIMESTAMP", "datetime": "TIMESTAMP", "kvref": "KVREF", "jsonref": "JSONREF",
}
COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")
MAX_DEPTH = 100


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.at, self.params, self.depth = sql, tokens(sql), 0, 0, 0

    @property
    def now(self):
        return self.tokens[self.at]

    def fail(self, wanted: str):
        raise errors.SyntaxFault(f"expected {wanted} at {self.now.at}")

    def take(self, kind: str, value: object = None):
        if self.now.kind != kind or (value is not None and self.now.value != value):
            self.fail(str(value or kind))
        self.at += 1
        return self.tokens[self.at - 1].value

    def maybe(self, kind: str, value: object) -> bool:
        found = self.now.kind == kind and self.now.value == value
        self.at += found
        return found

    def keys(self, *words: str) -> None:
        for w in words:
            self.take("key", w)

    def name(self) -> str:
        return self.take("word")

    def listed(self, one) -> tuple:
        out = [one()]
        while self.maybe("op", ","):
            out.append(one())
        return tuple(out)

    def statement(self):
        word = self.now.value if self.now.kind == "key" else None
        method = {"select": self.select, "insert": self.insert, "update": self.update, "delete": self.delete, "create": self.create, "drop": self.drop, "alter": self.alter}.get(word)
        if method is None:
            self.fail("a statement")
        out = method()
        self.maybe("op", ";")
        self.take("end")
        return out

    # queries

    def source(self) -> S.Source:
        table = self.name()
        if self.maybe("key", "as") or self.now.kind == "word":
            return S.Source(table, self.name())
        return S.Source(table, table)

    def column(self) -> S.Name:
        first = self.name()
        return S.Name(first, self.name()) if self.maybe("op", ".") else S.Name(None, first)

    def item(self) -> tuple[S.Name, str]:
        column = self.column()
        named = self.maybe("key", "as") or self.now.kind == "word"
        return column, self.name() if named else column.column

    def join(self) -> S.Join:
        self.keys("left")
        self.maybe("key", "outer")
        self.keys("join")
        source = self.source()
        self.keys("on")
        left = self.column()
        self.take("op", "=")
        return S.Join(source, left, self.column())

    def sort(self) -> tuple[S.Name, bool]:
        column = self.column()
        down = self.maybe("key", "desc")
        if not down:
            self.maybe("key", "asc")
        return column, down

    def natural(self) -> int:
        return self.take("int")

    def select(self) -> S.Select:
        self.keys("select")
        items, count = None, False
        if self.maybe("key", "count"):
            for op in ("(", "*", ")"):
                self.take("op", op)
            count = True
        elif not self.maybe("op", "*"):
            items = self.listed(self.item)
        self.keys("from")
        source, joins, where, order, limit, offset = self.source(), [], None, (), None, 0
        while self.now.kind == "key" and self.now.value == "left":
            joins.append(self.join())
        if self.maybe("key", "where"):
            where = self.predicate()
        if self.maybe("key", "order"):
            self.keys("by")
            order = self.listed(self.sort)
        if self.maybe("key", "limit"):
            limit = self.natural()
            if self.maybe("key", "offset"):
                offset = self.natural()
        return S.Select(items, count, source, tuple(joins), where, order, limit, offset, self.params)

    # predicates

    def predicate(self):
        return self._chain("or", lambda: self._chain("and", self.negation))

    def _chain(self, word: str, one):
        parts = [one()]
        while self.maybe("key", word):
            parts.append(one())
        return parts[0] if len(parts) == 1 else S.Logic(word, tuple(parts))

    def negation(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise errors.SyntaxFault("nested too deeply")
        try:
            if self.maybe("key", "not"):
                return S.Logic("not", (self.negation(),))
            if self.maybe("op", "("):
                inner = self.predicate()
                self.take("op", ")")
                return inner
            return self.test()
        finally:
            self.depth -= 1

    def literal(self) -> S.Literal:
        t = self.now
        if t.kind == "op" and t.value == "-":
            self.at += 1
            if self.now.kind not in ("int", "real"):
                self.fail("a number")
            value = -self.take(self.now.kind)
        elif t.kind in ("int", "real", "text"):
            value = self.take(t.kind)
        elif t.kind == "key" and t.value in ("true", "false", "null"):
            self.at += 1
            value = {"true": True, "false": False, "null": None}[t.value]
        else:
            self.fail("a literal")
        if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 63:
            raise errors.SyntaxFault("integer out of range")
        return S.Literal(value)

    def operand(self):
        if self.now.kind == "word":
            return self.column()
        return self.value()

    def value(self):
        if self.maybe("op", "?"):
            self.params += 1
            return S.Param(self.params - 1)
        return self.literal()

    def test(self):
        left = self.operand()
        if self.now.kind == "op" and self.now.value in COMPARISONS:
            op = self.take("op")
            return S.Compare(op, left, self.operand())
        if self.maybe("key", "is"):
            negated = self.maybe("key", "not")
            self.keys("null")
            return S.IsNull(left, negated)
        negated = self.maybe("key", "not")
        if self.maybe("key", "in"):
            self.take("op", "(")
            items = self.listed(self.literal)
            self.take("op", ")")
            return S.InList(left, items, negated)
        if self.maybe("key", "like"):
            return S.Like(left, self.take("text"), negated)
        self.fail("a comparison")

    # changes

    def insert(self) -> S.Insert:
        self.keys("insert", "into")
        table, columns = self.name(), None
        if self.maybe("op", "("):
            columns = self.listed(self.name)
            self.take("op", ")")
        self.keys("values")

        def row() -> tuple:
            self.take("op", "(")
            out = self.listed(self.value)
            self.take("op", ")")
            return out

        rows = self.listed(row)
        return S.Insert(table, columns, rows, self.params)

    def update(self) -> S.Update:
        self.keys("update")
        table = self.name()
        self.keys("set")

        def one() -> tuple:
            column = self.name()
            self.take("op", "=")
            return column, self.value()

        sets = self.listed(one)
        where = self.predicate() if self.maybe("key", "where") else None
        return S.Update(table, sets, where, self.params)

    def delete(self) -> S.Delete:
        self.keys("delete", "from")
        table = self.name()
        where = self.predicate() if self.maybe("key", "where") else None
        return S.Delete(table, where, self.params)

    # definitions

    def spec(self) -> S.ColumnSpec:
        name, kind = self.name(), self.take("word")
        if kind not in TYPES:
            self.fail("a type")
        if kind in ("varchar", "char") and self.maybe("op", "("):
            self.natural()
            self.take("op", ")")
        out = S.ColumnSpec(name, TYPES[kind])
        while self.now.kind == "key":
            if self.maybe("key", "primary"):
                self.keys("key")
                out.primary_key = True
                out.autoincrement = self.maybe("key", "autoincrement")
            elif self.maybe("key", "not"):
                self.keys("null")
                out.not_null = True
            elif self.maybe("key", "unique"):
                out.unique = True
            elif self.maybe("key", "default"):
                out.default = S.Now() if self.maybe("key", "current_timestamp") else self.literal()
            elif self.maybe("key", "references"):
                out.references = self.name()
            else:
                break
        return out

    def create(self):
        self.keys("create")
        if self.maybe("key", "table"):
            table = self.name()
            self.take("op", "(")
            columns = self.listed(self.spec)
            self.take("op", ")")
            return S.CreateTable(table, columns)
        if self.maybe("key", "view"):
            name = self.name()
            self.keys("as")
            start = self.now.at
            select = self.select()
            return S.CreateView(name, self.sql[start:].rstrip().removesuffix(";").rstrip(), select)
        unique = self.maybe("key", "unique")
        self.keys("index")
        name = self.name()
        self.keys("on")
        table = self.name()
        self.take("op", "(")
        column = self.name()
        self.take("op", ")")
        return S.CreateIndex(name, table, column, unique)

    def drop(self) -> S.Drop:
        self.keys("drop")
        for kind in ("table", "index", "view"):
            if self.maybe("key", kind):
                return S.Drop(kind, self.name())
        self.fail("table, index or view")

    def alter(self) -> S.Alter:
        self.keys("alter", "table")
        table = self.name()
        if self.maybe("key", "add"):
            self.maybe("key", "column")
            spec = self.spec()
            return S.Alter(table, "add", spec.name, spec=spec)
        if self.maybe("key", "drop"):
            self.maybe("key", "column")
            return S.Alter(table, "drop", self.name())
        self.keys("rename")
        if self.maybe("key", "to"):
            return S.Alter(table, "rename", to=self.name())
        self.maybe("key", "column")
        column = self.name()
        self.keys("to")
        return S.Alter(table, "rename_column", column, self.name())


def parse(sql: str):
    return Parser(sql).statement()
