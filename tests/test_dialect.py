"""Grammar and binding, without data."""

import pytest

from plumbline import errors
from plumbline.plans import syntax as S
from plumbline.plans.parser import parse
from plumbline.plans.planner import coerce


@pytest.mark.parametrize(
    "sql",
    ["SELECT", "SELECT * FROM t WHERE", "SELECT a + b FROM t", "SELECT *, a FROM t", "SELECT a FROM t GROUP BY a", "SELECT a FROM t JOIN u ON a = b", "SELECT a FROM t LIMIT -1", "SELECT a FROM t OFFSET 1", 'SELECT "a" FROM t', "SELECT a FROM t; SELECT b FROM t", "SELECT a FROM t WHERE a IN (?)", "SELECT a FROM t WHERE a LIKE b", "SELECT a FROM t WHERE a = 1e999", "SELECT a FROM t WHERE a = 9223372036854775808", "TRUNCATE t"],
)
def test_what_the_grammar_refuses(sql):
    with pytest.raises(errors.SyntaxFault):
        parse(sql)


def test_precedence_and_literals():
    p = parse("select A from T where not a = 1 or b = -2 and c = 'it''s'").where
    assert p.op == "or" and p.parts[0].op == "not" and p.parts[1].op == "and"
    assert p.parts[1].parts[0].right == S.Literal(-2) and p.parts[1].parts[1].right == S.Literal("it's")


def test_limits_of_statements():
    with pytest.raises(errors.StatementTooLong):
        parse("SELECT a FROM t WHERE a = '" + "x" * 70_000 + "'")
    with pytest.raises(errors.SyntaxFault):
        parse("SELECT a FROM t WHERE " + "(" * 120 + "a = 1" + ")" * 120)
    with pytest.raises(errors.InvalidIdentifier):
        parse("SELECT " + "a" * 51 + " FROM t")


def test_access_levels():
    assert [S.access(parse(q)) for q in ("SELECT a FROM t", "DELETE FROM t", "DROP TABLE t")] == ["read", "write", "ddl"]
    assert S.permitted("write", parse("SELECT a FROM t")) and not S.permitted("read", parse("DELETE FROM t")) and not S.permitted("", parse("SELECT a FROM t"))


@pytest.mark.parametrize("value, kind, want", [(1, "REAL", ("REAL", 1.0)), (5, "TIMESTAMP", ("TIMESTAMP", 5)), ("1970-01-01T00:00:01Z", "TIMESTAMP", ("TIMESTAMP", 1000)), (True, "BOOLEAN", ("BOOLEAN", True)), ("k", "KVREF", ("KVREF", "k"))])
def test_coercions(value, kind, want):
    assert coerce(value, kind) == want


@pytest.mark.parametrize("value, kind", [(2.5, "INTEGER"), ("1", "INTEGER"), (True, "INTEGER"), (1, "BOOLEAN"), (1, "TEXT"), ("x", "TIMESTAMP"), ("2020-01-01T00:00:00+02:00", "TIMESTAMP")])
def test_refused_coercions(value, kind):
    with pytest.raises(errors.EngineError):
        coerce(value, kind)
