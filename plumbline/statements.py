"""Queries that run statements, writes and definitions on domains of their own, and return what these hold afterwards.

Every query makes its domains in a new folder in the shared one, so runs do not meet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import errors
from plumbline.catalogue import ORACLE, QUERIES, _query, _raw, database
from plumbline.functions import hashing
from plumbline.operators.documents import Documents
from plumbline.operators.kv import Domains, KeyValues
from plumbline.operators.relational import Relational
from plumbline.plans.catalog import Limits
from plumbline.sources import archive, logs, ndjson, shared
from plumbline.streaming import watch

__all__ = ["ORACLE", "QUERIES"]


def _place(spark: SparkSession) -> str:
    return f"{shared.folder(spark)}/plumbline-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _engine(spark: SparkSession, *statements: str, **more) -> Relational:
    db = Relational(spark, _place(spark), **more)
    for s in statements:
        db.execute(s)
    return db


def _values(rows: list[tuple], names: str) -> str:
    def text(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


CUSTOMER = "CREATE TABLE customer (c_custkey INTEGER PRIMARY KEY, c_name TEXT NOT NULL, c_nationkey INTEGER, c_acctbal REAL, c_mktsegment TEXT)"
NATION = "CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT NOT NULL, n_regionkey INTEGER DEFAULT 3)"
REGION = "CREATE TABLE region (r_regionkey INTEGER PRIMARY KEY, r_name TEXT)"


def _customers(spark, sf_dir) -> Relational:
    db = _engine(spark, CUSTOMER)
    db.append("customer", _raw(spark, sf_dir, "customer"))
    return db


def _nations(spark, sf_dir, *statements: str, **more) -> Relational:
    db = _engine(spark, NATION, *statements, **more)
    db.append("nation", _raw(spark, sf_dir, "nation"))
    return db


# insertion, change, deletion


@_query("insert_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT * FROM (VALUES (100, 'ATLANTIS', 0), (101, 'LEMURIA', NULL), (102, 'MU', 4)) t(a, b, c)")
def _(spark, sf_dir):
    db = _nations(spark, sf_dir)
    db.execute("INSERT INTO nation VALUES (100, 'ATLANTIS', 0), (101, 'LEMURIA', NULL)")
    db.execute("INSERT INTO nation (n_name, n_regionkey, n_nationkey) VALUES (?, ?, 102)", ("MU", 4))
    return db.dataframe("SELECT * FROM nation")


@_query("insert_defaults", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT * FROM (VALUES (100, 'ATLANTIS', 3), (101, 'LEMURIA', 3)) t(a, b, c)")
def _(spark, sf_dir):
    db = _nations(spark, sf_dir)
    db.execute("INSERT INTO nation (n_nationkey, n_name) VALUES (100, 'ATLANTIS'), (101, 'LEMURIA')")
    return db.dataframe("SELECT * FROM nation")


@_query("insert_current_time", "SELECT r_regionkey AS id, r_name AS name FROM region")
def _(spark, sf_dir):
    db = _engine(spark, "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, made TIMESTAMP DEFAULT CURRENT_TIMESTAMP, note TEXT)")
    db.append("t", _raw(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    return db.dataframe("SELECT id, name FROM t WHERE made >= '2020-01-01T00:00:00Z' AND note IS NULL")


@_query("autoincrement", _values([(1, "a"), (2, "b"), (100, "c"), (102, "e")], "id, v"))
def _(spark, sf_dir):
    db = _engine(spark, "CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, v TEXT)")
    for text in ("INSERT INTO t (v) VALUES ('a'), ('b')", "INSERT INTO t (id, v) VALUES (100, 'c')", "INSERT INTO t (v) VALUES ('d')", "DELETE FROM t WHERE id = 101", "INSERT INTO t (v) VALUES ('e')"):
        db.execute(text)
    return db.dataframe("SELECT * FROM t")


@_query("update_rows", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'CLOSED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(spark, sf_dir):
    db = _customers(spark, sf_dir)
    db.execute("UPDATE customer SET c_acctbal = 0, c_mktsegment = ? WHERE c_mktsegment = 'BUILDING'", ("CLOSED",))
    return db.dataframe("SELECT * FROM customer")


@_query("update_one_part", "SELECT c_custkey, CASE WHEN c_custkey = 7 THEN NULL ELSE c_nationkey END AS c_nationkey, c_custkey < 1000 AS old_part FROM customer UNION ALL SELECT -1, 5, false")
def _(spark, sf_dir):
    db = _engine(spark, CUSTOMER)
    rows = _raw(spark, sf_dir, "customer")
    db.append("customer", rows.where("c_custkey < 1000"))
    db.append("customer", rows.where("c_custkey >= 1000"))
    db.execute("INSERT INTO customer VALUES (-1, 'x', 5, 1.5, 'none')")
    db.execute("UPDATE customer SET c_nationkey = NULL WHERE c_custkey = 7")
    table = db.catalog.table("customer")
    # the second part and the third stay as they were; the first was written anew as the fourth
    return db.scan(table, number=True).select("c_custkey", "c_nationkey", (F.col("__part") == 3).alias("old_part"))


@_query("delete_rows", "SELECT doc_id, quality, toxic FROM labels WHERE (quality = 0) IS NOT TRUE UNION ALL SELECT -1, NULL, NULL")
def _(spark, sf_dir):
    db = _engine(spark, "CREATE TABLE labels (doc_id INTEGER PRIMARY KEY, quality INTEGER, toxic INTEGER)")
    db.append("labels", _raw(spark, sf_dir, "labels"))
    db.execute("INSERT INTO labels (doc_id) VALUES (-1)")
    db.execute("DELETE FROM labels WHERE quality = 0")
    return db.dataframe("SELECT * FROM labels")


@_query("change_results", "SELECT 'insert' AS statement, 1 AS affected, 900 AS last_pk UNION ALL SELECT 'insert two', 2, NULL UNION ALL SELECT 'update', count(*), NULL FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'update none', 0, NULL UNION ALL SELECT 'update by key', 1, NULL UNION ALL SELECT 'delete', 2, NULL UNION ALL SELECT 'delete all', count(*) + 1, NULL FROM nation")
def _(spark, sf_dir):
    db = _nations(spark, sf_dir)
    run = {
        "insert": "INSERT INTO nation VALUES (900, 'a', 9)",
        "insert two": "INSERT INTO nation VALUES (901, 'b', 9), (902, 'c', 9)",
        "update": "UPDATE nation SET n_name = 'x' WHERE n_regionkey = 1",
        "update none": "UPDATE nation SET n_name = 'x' WHERE n_nationkey = -5",
        "update by key": "UPDATE nation SET n_name = 'y' WHERE n_nationkey = 900",
        "delete": "DELETE FROM nation WHERE n_nationkey > 900",
        "delete all": "DELETE FROM nation",
    }
    rows = [(k, r.affected, r.last_pk) for k, r in ((k, db.execute(s)) for k, s in run.items())]
    return spark.createDataFrame(rows, "statement string, affected long, last_pk long")


@_query("rows_by_key", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'renamed' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 77, 'new'")
def _(spark, sf_dir):
    db = _engine(spark, REGION)
    db.append("region", _raw(spark, sf_dir, "region"))
    db.insert_row("region", {"R_REGIONKEY": 77, "r_name": "new"})
    db.update_row("region", 1, {"r_name": "renamed", "r_regionkey": 1})
    db.delete_row("region", 2)
    return db.dataframe("SELECT * FROM region")


def _refused(name: str, cases: list[tuple[str, str]], run: Callable[[SparkSession, str], Callable[[str], object]]) -> None:
    """Register a query of statements and what they are refused for; its SQL is the list itself."""

    @_query(name, _values(cases, "statement, refusal"))
    def _(spark, sf_dir):
        execute, out = run(spark, sf_dir), []
        for text, _ in cases:
            try:
                execute(text)
                out.append((text, "none"))
            except errors.EngineError as e:
                out.append((text, type(e).__name__))
        return spark.createDataFrame(out, "statement string, refusal string")


def _checked(spark, sf_dir):
    kv = KeyValues(spark, _place(spark))
    kv.batch([("here", "put", b"1", 0), ("empty", "null", None, 0)])
    db = _nations(spark, sf_dir, "CREATE TABLE t (id INTEGER PRIMARY KEY, code TEXT UNIQUE, n INTEGER NOT NULL, home INTEGER REFERENCES nation, link KVREF)", kv=kv, limits=Limits(text=100, row=150))
    db.execute("INSERT INTO t VALUES (1, 'a', 1, 3, 'here'), (2, NULL, 1, NULL, NULL)")
    return db.execute


_refused(
    "refused_changes",
    [
        ("INSERT INTO t VALUES (1, 'b', 1, NULL, NULL)", "DuplicateKey"),
        ("INSERT INTO t VALUES (3, 'b', 1, NULL, NULL), (3, 'c', 1, NULL, NULL)", "DuplicateKey"),
        ("INSERT INTO t VALUES (3, 'a', 1, NULL, NULL)", "UniqueViolation"),
        ("INSERT INTO t VALUES (3, NULL, 1, NULL, NULL)", "none"),
        ("UPDATE t SET code = 'a'", "UniqueViolation"),
        ("INSERT INTO t (id) VALUES (4)", "NotNullViolation"),
        ("UPDATE t SET n = NULL", "NotNullViolation"),
        (f"INSERT INTO t VALUES (4, '{'x' * 101}', 1, NULL, NULL)", "TextTooLong"),
        (f"INSERT INTO t VALUES (4, '{'x' * 90}', 1, NULL, '{'y' * 90}')", "RowTooLarge"),
        ("INSERT INTO t VALUES (4, 'd', 1, 999, NULL)", "ReferenceViolation"),
        ("UPDATE t SET home = 999 WHERE id = 1", "ReferenceViolation"),
        ("INSERT INTO t VALUES (4, 'd', 1, NULL, 'gone')", "LinkViolation"),
        ("INSERT INTO t VALUES (5, 'e', 1, NULL, 'empty')", "none"),
        ("UPDATE t SET id = 9", "ImmutableKey"),
        ("INSERT INTO t (id, n) VALUES (6)", "ArityMismatch"),
        ("INSERT INTO t (id, id) VALUES (6, 7)", "DuplicateName"),
        ("INSERT INTO t (id, n) VALUES (6, 2.5)", "TypeMismatch"),
        ("INSERT INTO t (id, nothing) VALUES (6, 1)", "UnknownColumn"),
        ("DELETE FROM nothing", "UnknownTable"),
    ],
    _checked,
)


def _asked(spark, sf_dir):
    db = database(spark, sf_dir, "nation", "customer", "region", "part")
    db.catalog.limits = Limits(sort_rows=20, joins=2)
    return db.execute


_refused(
    "refused_queries",
    [
        ("SELECT n_name FROM nation WHERE n_regionkey = NULL", "NullComparison"),
        ("SELECT n_name FROM nation WHERE n_regionkey IN (1, NULL)", "NullComparison"),
        ("SELECT n_name FROM nation WHERE n_name = 1", "TypeMismatch"),
        ("SELECT n_name FROM nation WHERE n_regionkey LIKE 'a'", "TypeMismatch"),
        ("SELECT n_name FROM nation WHERE n_regionkey = ?", "ParameterCount"),
        ("SELECT n_name FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey", "AmbiguousColumn"),
        ("SELECT a.n_name FROM nation a LEFT JOIN nation a ON a.n_regionkey = a.n_nationkey", "DuplicateAlias"),
        ("SELECT x.n_name FROM nation a", "UnknownTable"),
        ("SELECT nothing FROM nation", "UnknownColumn"),
        ("SELECT p.p_partkey FROM part p LEFT JOIN nation n ON p.p_size = n.n_name", "TypeMismatch"),
        ("SELECT n.n_name FROM nation n LEFT JOIN part p ON n.n_nationkey = p.p_size", "UnindexedJoin"),
        ("SELECT n_name FROM nation ORDER BY n_name", "SortBufferExceeded"),
        ("SELECT n_name FROM nation LIMIT -1", "SyntaxFault"),
        ("SELECT n_name FROM nation; SELECT n_name FROM nation", "SyntaxFault"),
        ("SELECT n_name FROM nothing", "UnknownTable"),
        ("SELECT a.n_name FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey LEFT JOIN nation c ON b.n_regionkey = c.n_nationkey LEFT JOIN region r ON c.n_regionkey = r.r_regionkey", "JoinDepthExceeded"),
    ],
    _asked,
)


def _defined(spark, sf_dir):
    db = _nations(spark, sf_dir, REGION, "CREATE TABLE child (id INTEGER PRIMARY KEY, nation INTEGER REFERENCES nation, v TEXT)", "CREATE INDEX by_v ON child (v)", "CREATE VIEW v1 AS SELECT n_nationkey AS id, n_name AS name FROM nation", "CREATE VIEW v2 AS SELECT id FROM v1", "CREATE VIEW v3 AS SELECT id FROM v2")
    return db.execute


_refused(
    "refused_definitions",
    [
        ("CREATE TABLE nation (id INTEGER PRIMARY KEY)", "AlreadyExists"),
        ("CREATE TABLE x (id INTEGER)", "SyntaxFault"),
        ("CREATE TABLE x (id REAL PRIMARY KEY)", "SyntaxFault"),
        ("CREATE TABLE x (id INTEGER PRIMARY KEY, a TEXT, a TEXT)", "DuplicateName"),
        ("CREATE TABLE x (id INTEGER PRIMARY KEY, a INTEGER DEFAULT 'b')", "InvalidDefault"),
        ("CREATE TABLE x (id INTEGER PRIMARY KEY, a TEXT DEFAULT CURRENT_TIMESTAMP)", "InvalidDefault"),
        ("CREATE TABLE x (id INTEGER PRIMARY KEY, a TEXT REFERENCES nation)", "TypeMismatch"),
        ("CREATE TABLE x (id INTEGER PRIMARY KEY, a INTEGER REFERENCES nothing)", "UnknownTable"),
        ("ALTER TABLE nation ADD COLUMN n_name TEXT", "DuplicateName"),
        ("ALTER TABLE nation ADD COLUMN z TEXT NOT NULL", "InvalidDefault"),
        ("ALTER TABLE nation DROP COLUMN n_nationkey", "DependencyConflict"),
        ("ALTER TABLE nation DROP COLUMN n_name", "DependencyConflict"),
        ("ALTER TABLE nation RENAME COLUMN n_name TO label", "DependencyConflict"),
        ("ALTER TABLE nation RENAME TO land", "DependencyConflict"),
        ("CREATE INDEX by_v ON child (v)", "AlreadyExists"),
        ("CREATE UNIQUE INDEX one ON nation (n_regionkey)", "UniqueViolation"),
        ("DROP INDEX nothing", "UnknownIndex"),
        ("DROP TABLE nation", "DependencyConflict"),
        ("DROP VIEW v1", "DependencyConflict"),
        ("INSERT INTO v1 VALUES (1, 'a')", "ReadOnlyView"),
        ("CREATE VIEW v4 AS SELECT id FROM v3", "LimitExceeded"),
        ("CREATE VIEW w AS SELECT n_name FROM nation ORDER BY n_name", "InvalidView"),
        ("CREATE VIEW w AS SELECT n_name FROM nation LIMIT 3", "InvalidView"),
        ("CREATE VIEW w AS SELECT COUNT(*) FROM nation", "InvalidView"),
        ("CREATE VIEW w AS SELECT n_name FROM nation WHERE n_nationkey = ?", "InvalidView"),
        ("CREATE VIEW w AS SELECT n_name, n_name FROM nation", "InvalidView"),
        ("CREATE VIEW w AS SELECT nothing FROM nation", "UnknownColumn"),
    ],
    _defined,
)


@_query("access_levels", _values([("read", "select", True), ("read", "insert", False), ("read", "create", False), ("write", "select", True), ("write", "insert", True), ("write", "create", False), ("ddl", "select", True), ("ddl", "insert", True), ("ddl", "create", True)], "granted, statement, allowed"))
def _(spark, sf_dir):
    out = []
    for granted in ("read", "write", "ddl"):
        db = _engine(spark, REGION)
        for kind, text in (("select", "SELECT COUNT(*) FROM region"), ("insert", "INSERT INTO region VALUES (1, 'a')"), ("create", "CREATE TABLE x (id INTEGER PRIMARY KEY)")):
            try:
                db.execute(text, granted=granted)
                out.append((granted, kind, True))
            except errors.Forbidden:
                out.append((granted, kind, False))
    return spark.createDataFrame(out, "granted string, statement string, allowed boolean")


# definitions


@_query("add_column", "SELECT n_nationkey, n_name, 'none' AS motto, NULL::BIGINT AS area FROM nation UNION ALL SELECT 100, 'ATLANTIS', 'sea', NULL UNION ALL SELECT 101, 'MU', 'none', 7")
def _(spark, sf_dir):
    db = _nations(spark, sf_dir)
    for text in ("ALTER TABLE nation ADD COLUMN motto TEXT NOT NULL DEFAULT 'none'", "ALTER TABLE nation ADD COLUMN area INTEGER", "INSERT INTO nation (n_nationkey, n_name, motto) VALUES (100, 'ATLANTIS', 'sea')", "INSERT INTO nation (n_nationkey, n_name, area) VALUES (101, 'MU', 7)"):
        db.execute(text)
    return db.dataframe("SELECT n_nationkey, n_name, motto, area FROM nation")


@_query("drop_column", "SELECT n_nationkey, n_name, NULL::VARCHAR AS n_regionkey FROM nation")
def _(spark, sf_dir):
    db = _nations(spark, sf_dir)
    db.execute("ALTER TABLE nation DROP COLUMN n_regionkey")
    db.execute("ALTER TABLE nation ADD COLUMN n_regionkey TEXT")  # a new column, in which old cells do not show
    return db.dataframe("SELECT * FROM nation")


@_query("rename_column_and_table", "SELECT n_nationkey AS id, n_name AS label, n_regionkey FROM nation WHERE n_nationkey > 3")
def _(spark, sf_dir):
    db = _nations(spark, sf_dir)
    for text in ("ALTER TABLE nation RENAME COLUMN n_nationkey TO id", "ALTER TABLE nation RENAME COLUMN n_name TO label", "ALTER TABLE nation RENAME TO land"):
        db.execute(text)
    return db.dataframe("SELECT id, label, n_regionkey FROM land WHERE id > 3")


@_query("catalog_after_definitions", _values([("child", "table", "id", 2, 1, None), ("land", "table", "n_nationkey", 3, 1, None), ("named", "view", None, 0, 0, "SELECT n_name AS name FROM  land")], "name, kind, primary_key, n_columns, n_indexes, text"))
def _(spark, sf_dir):
    db = _nations(spark, sf_dir, "CREATE TABLE child (id INTEGER PRIMARY KEY, nation INTEGER REFERENCES nation)")
    for text in ("CREATE UNIQUE INDEX by_name ON nation (n_name)", "CREATE INDEX by_region ON nation (n_regionkey)", "DROP INDEX by_region", "CREATE INDEX by_nation ON child (nation)", "ALTER TABLE nation RENAME TO land", "CREATE VIEW named AS SELECT n_name AS name FROM  land;", "CREATE VIEW other AS SELECT name FROM named", "DROP VIEW other", "CREATE TABLE gone (id INTEGER PRIMARY KEY)", "DROP TABLE gone"):
        db.execute(text)
    again = Relational(spark, db.store.root)  # read from the catalog file
    rows = [(r["name"], r["kind"], r.get("primary_key"), len(r.get("columns", [])), len(r.get("indexes", [])), r.get("sql")) for r in again.catalog.describe()]
    return spark.createDataFrame(rows, "name string, kind string, primary_key string, n_columns int, n_indexes int, text string")


@_query("vacuumed", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def _(spark, sf_dir):
    db = _engine(spark, CUSTOMER)
    rows = _raw(spark, sf_dir, "customer")
    for k in (0, 2):
        db.append("customer", rows.where(f"c_custkey % 4 = {k}"))
    assert db.vacuum("customer") == 2
    return db.dataframe("SELECT * FROM customer")


@_query("domains_listed", _values([("kv", "a", "active"), ("relational", "b", "deleting"), ("relational", "c", "active"), ("relational purged", "c", "active")], "engine, name, state"))
def _(spark, sf_dir):
    kv, rel = Domains(spark, _place(spark)), Domains(spark, _place(spark), Relational)
    kv.create("a")
    rel.create("b").execute(REGION)
    rel.create("c")
    rel.delete("b")
    rows = [("kv", *x) for x in kv.listed()] + [("relational", *x) for x in rel.listed()]
    rel.purge()
    rows += [("relational purged", *x) for x in Domains(spark, rel.root, Relational).listed()]
    return spark.createDataFrame(rows, "engine string, name string, state string")


# scans and limits


@_query("pk_prefix", "SELECT n_name, n_nationkey FROM nation WHERE starts_with(n_name, 'NATION_1')")
def _(spark, sf_dir):
    db = Relational(spark)
    db.register("nation", f"{sf_dir}/nation.parquet", "n_name")
    return db.dataframe("SELECT n_name, n_nationkey FROM nation WHERE n_name LIKE 'NATION_1%'")


@_query("row_browse", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 7")
def _(spark, sf_dir):
    found = database(spark, sf_dir, "customer").browse("customer", {"C_NATIONKEY": "7", "c_mktsegment": "MACHINERY"}, limit=10_000)
    return spark.createDataFrame(found.rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@_query("typed_texts", _values([("INTEGER", "7", "7"), ("REAL", "2.5", "2.5"), ("BOOLEAN", "TRUE", "True"), ("TIMESTAMP", "1500", "1500"), ("TIMESTAMP", "1970-01-01T00:00:02Z", "2000"), ("TEXT", "7", "7"), ("INTEGER", "x", "TypeMismatch"), ("BOOLEAN", "maybe", "TypeMismatch")], "type, text, value"))
def _(spark, sf_dir):
    from plumbline.operators.relational import from_text

    out = []
    for kind, text in (("INTEGER", "7"), ("REAL", "2.5"), ("BOOLEAN", "TRUE"), ("TIMESTAMP", "1500"), ("TIMESTAMP", "1970-01-01T00:00:02Z"), ("TEXT", "7"), ("INTEGER", "x"), ("BOOLEAN", "maybe")):
        try:
            out.append((kind, text, str(from_text(text, kind))))
        except errors.TypeMismatch as e:
            out.append((kind, text, type(e).__name__))
    return spark.createDataFrame(out, "type string, text string, value string")


@_query("limits_applied", "SELECT 'none' AS asked, least(10, n) AS n_rows, n > 10 AS applied FROM (SELECT count(*) AS n FROM nation) UNION ALL SELECT 'small', 3, true UNION ALL SELECT 'beyond the table', (SELECT count(*) FROM nation WHERE n_regionkey = 1), false UNION ALL SELECT 'beyond the greatest', (SELECT count(*) FROM nation WHERE n_regionkey = 1), true UNION ALL SELECT 'last page', 2, false UNION ALL SELECT 'zero', 0, true")
def _(spark, sf_dir):
    db = database(spark, sf_dir, "nation")
    db.catalog.limits = Limits(default_limit=10, max_limit=20)
    asked = {"none": "SELECT * FROM nation", "small": "SELECT * FROM nation LIMIT 3", "beyond the table": "SELECT * FROM nation WHERE n_regionkey = 1 LIMIT 19", "beyond the greatest": "SELECT * FROM nation WHERE n_regionkey = 1 LIMIT 21", "last page": "SELECT * FROM nation ORDER BY n_nationkey LIMIT 3 OFFSET 23", "zero": "SELECT * FROM nation LIMIT 0"}
    rows = [(k, r.row_count, r.limit_applied) for k, r in ((k, db.execute(s)) for k, s in asked.items())]
    return spark.createDataFrame(rows, "asked string, n_rows long, applied boolean")


@_query("early_stop", "SELECT 40 AS n, 40 AS in_table, true AS applied")
def _(spark, sf_dir):
    db = database(spark, sf_dir, "orders")
    found = db.execute("SELECT o_orderkey FROM orders LIMIT 40")
    rows = spark.createDataFrame(found.rows, "o_orderkey long").distinct()
    real = rows.join(_raw(spark, sf_dir, "orders"), "o_orderkey", "left_semi").agg(F.count(F.lit(1)).cast("int").alias("in_table"))
    return real.select(F.lit(found.row_count).alias("n"), "in_table", F.lit(found.limit_applied).alias("applied"))


@_query("join_unindexed", "SELECT n.n_nationkey, p.p_partkey FROM nation n LEFT JOIN part p ON n.n_nationkey = p.p_size")
def _(spark, sf_dir):
    db = database(spark, sf_dir, "nation", "part")
    db.catalog.limits = Limits(unindexed_joins=True)
    return db.dataframe("SELECT n.n_nationkey, p.p_partkey FROM nation n LEFT JOIN part p ON n.n_nationkey = p.p_size")


@_query("join_masked", "SELECT d.doc_id, CAST(NULL AS BIGINT) AS other FROM documents d")
def _(spark, sf_dir):
    db = database(spark, sf_dir, "documents", "nation")
    db.catalog.table("documents").column("lang").type = "KVREF"
    db.catalog.table("nation").indexes["by_name"] = ("n_name", False)
    db.catalog.table("nation").column("n_name").type = "KVREF"
    return db.dataframe("SELECT d.doc_id, n.n_nationkey AS other FROM documents d LEFT JOIN nation n ON d.lang = n.n_name")


# links between the engines


def _linked(spark, sf_dir):
    kv, docs = KeyValues(spark, _place(spark)), Documents(spark, _place(spark))
    kv.batch([("text", "put", "é".encode(), 0), ("bytes", "put", b"\xff\xfe\xfd", 0), ("null", "null", None, 0), ("gone", "put", b"x", 0)])
    docs.create({"a": [1, 2]}, "d1")
    db = _nations(spark, sf_dir, "CREATE TABLE t (id INTEGER PRIMARY KEY, k KVREF, d JSONREF, home INTEGER REFERENCES nation)", kv=kv, docs=docs)
    db.execute("INSERT INTO t VALUES (1, 'text', 'd1', 3), (2, 'bytes', NULL, NULL), (3, 'null', NULL, NULL), (4, 'gone', 'd1', 4), (5, NULL, NULL, NULL)")
    kv.delete("gone")
    docs.delete("d1")
    docs.create({"a": "new"}, "d1")
    return db


def _expanded(spark, rows) -> DataFrame:
    import json

    out = [(i, *(None if e[c] is None else json.dumps(e[c], sort_keys=True, ensure_ascii=False) for c in ("k", "d", "home"))) for i, e in rows]
    return spark.createDataFrame(out, "id long, k string, d string, home string")


_HOME = """(SELECT '{"n_name": "' || n_name || '", "n_nationkey": ' || n_nationkey || ', "n_regionkey": ' || n_regionkey || '}' FROM nation WHERE n_nationkey = %d)"""


@_query(
    "expand_links",
    f"""SELECT 1 AS id, '{{"encoding": "utf8", "exists": true, "value": "é"}}' AS k, '{{"document": {{"a": "new"}}, "exists": true}}' AS d, {_HOME % 3} AS home
UNION ALL SELECT 2, '{{"encoding": "base64", "exists": true, "value": "//79"}}', NULL, NULL
UNION ALL SELECT 3, '{{"encoding": null, "exists": true, "value": null}}', NULL, NULL
UNION ALL SELECT 4, '{{"exists": false}}', '{{"document": {{"a": "new"}}, "exists": true}}', {_HOME % 4}
UNION ALL SELECT 5, NULL, NULL, NULL""",
)
def _(spark, sf_dir):
    found = _linked(spark, sf_dir).execute("SELECT id, k, d, home FROM t ORDER BY id", expand="*")
    return _expanded(spark, [(r[0], e) for r, e in zip(found.rows, found.expanded, strict=True)])


_refused("refused_expansions", [("id", "InvalidExpand"), ("nothing", "InvalidExpand"), ("k", "none")], lambda spark, sf_dir: (lambda db: lambda name: db.execute("SELECT id, k FROM t", expand=name))(_linked(spark, sf_dir)))


@_query("null_out", _values([(1, None, "d1", 3), (2, None, None, None), (3, None, None, None), (4, None, "d1", 4), (5, None, None, None)], "id, k, d, home"))
def _(spark, sf_dir):
    db = _linked(spark, sf_dir)
    db.kv = None
    assert db.null_out() == 4
    db.kv = KeyValues(spark, _place(spark))  # the cells are null for good
    return db.dataframe("SELECT * FROM t")


# key-value domains


def _states(spark, sf_dir):
    """Every nation's name under its key; some deleted, made null or expired, by later batches."""
    kv = KeyValues(spark, _place(spark))
    rows = [(r[0], r[1]) for r in _raw(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]
    kv.batch([(f"n{k}", "put", v.encode(), 0) for k, v in rows])
    kv.delete("n3")
    kv.set_null("n4")
    kv.put("n5", b"again", ttl=1000)
    kv.put("n6", b"brief", ttl=0)
    return kv


_STATES = "SELECT 'n' || n_nationkey AS key, CASE n_nationkey WHEN 4 THEN 'null' ELSE 'present' END AS status, CASE n_nationkey WHEN 4 THEN NULL WHEN 5 THEN 'again' ELSE n_name END AS value FROM nation WHERE n_nationkey NOT IN (3, 6)"


@_query("kv_states", _STATES)
def _(spark, sf_dir):
    return _states(spark, sf_dir).live().select("key", "status", F.col("value").cast("string").alias("value"))


@_query("kv_gets", _values([("n3", "absent", None), ("n4", "null", None), ("n5", "present", "again"), ("n6", "absent", None), ("other", "absent", None)], "key, status, value"))
def _(spark, sf_dir):
    kv = _states(spark, sf_dir)
    found = [(k, kv.get(k)) for k in ("n3", "n4", "n5", "n6", "other")]
    return spark.createDataFrame([(k, v.status, v.value and v.value.decode()) for k, v in found], "key string, status string, value string")


@_query("kv_batches", "SELECT count(*) AS versions, 5 AS instants FROM (SELECT n_nationkey FROM nation UNION ALL SELECT * FROM range(4))")
def _(spark, sf_dir):
    return _states(spark, sf_dir).log().agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("ts").cast("int").alias("instants"))


@_query("kv_compacted", "SELECT 'n' || n_nationkey AS key, CASE WHEN n_nationkey = 3 THEN 'del' WHEN n_nationkey = 4 THEN 'null' ELSE 'put' END AS op FROM nation WHERE n_nationkey <> 6")
def _(spark, sf_dir):
    kv = _states(spark, sf_dir)
    kv.compact()  # without an open snapshot the newest versions stay, deletions too, unless expired
    return KeyValues(spark, kv.path).log().select("key", "op")


@_query("kv_compacted_below_snapshot", "SELECT 'n' || n_nationkey AS key, CASE n_nationkey WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 2 ELSE 1 END AS versions FROM nation")
def _(spark, sf_dir):
    kv = KeyValues(spark, _place(spark))
    rows = [r[0] for r in _raw(spark, sf_dir, "nation").select("n_nationkey").collect()]
    for text in (b"older", b"old"):
        kv.batch([(f"n{k}", "put", text, 0) for k in rows])
    kv.snapshot()
    kv.batch([("n3", "del", None, 0), ("n4", "null", None, 0), ("n5", "put", b"new", 0), ("n6", "put", b"brief", 1)])
    kv.compact()
    return kv.log().groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("versions"))


@_query("kv_snapshot_table", "SELECT 'n' || n_nationkey AS key, CASE n_nationkey WHEN 5 THEN 'again' ELSE n_name END AS value FROM nation WHERE n_nationkey NOT IN (3, 4, 6)")
def _(spark, sf_dir):
    kv = _states(spark, sf_dir)
    table = kv.snapshot_table(_place(spark))
    kv.put("later", b"not in it")
    return table.select("key", F.col("value").cast("string").alias("value"))


# JSON domains


def _documents(spark, sf_dir) -> Documents:
    docs = Documents(spark, _place(spark))
    rows = _raw(spark, sf_dir, "events")
    # an odd event replaces the document of the even one before it
    key = F.concat(F.lit("e"), F.lpad((F.col("event_id") - F.col("event_id") % 2).cast("string"), 12, "0"))
    docs.load(rows.select(F.col("event_id").alias("line"), key.alias("key"), F.col("props").alias("content")))
    return docs


_DOCS = "(SELECT 'e' || lpad(CAST(event_id - event_id % 2 AS VARCHAR), 12, '0') AS key, count(*) AS version, CAST(json_extract(arg_max(props, event_id), '$.k') AS BIGINT) AS k FROM events GROUP BY 1)"


@_query("json_bulk_load", f"SELECT key, version, k FROM {_DOCS}")
def _(spark, sf_dir):
    return _documents(spark, sf_dir).live().select("key", "version", F.get_json_object("content", "$.k").cast("long").alias("k"))


@_query("json_list_keys", f"SELECT key, (SELECT count(*) FROM {_DOCS}) AS total, 0 AS documents FROM {_DOCS} ORDER BY key LIMIT 40 OFFSET 10")
def _(spark, sf_dir):
    page = _documents(spark, sf_dir).list(40, 10, keys_only=True)
    return spark.createDataFrame([(k, page.total, len(page.documents)) for k in page.keys], "key string, total long, documents int")


@_query("json_list", f"SELECT key, version, k FROM {_DOCS} ORDER BY key LIMIT 50")
def _(spark, sf_dir):
    page = _documents(spark, sf_dir).list()
    return spark.createDataFrame([(d.key, d.version, d.content["k"]) for d in page.documents], "key string, version long, k long")


@_query("json_count", f"SELECT count(*) AS n FROM {_DOCS}")
def _(spark, sf_dir):
    return spark.createDataFrame([(_documents(spark, sf_dir).count(),)], "n long")


@_query("json_writes", _values([("created", 1, '{"a": 1}', True), ("replaced", 2, "[1]", True), ("stale", 2, "[1]", True), ("deleted", None, None, False), ("created anew", 1, '"x"', False)], "step, version, content, same_generation"))
def _(spark, sf_dir):
    docs, out = Documents(spark, _place(spark)), []
    one = docs.create({"a": 1}, "k")

    def note(step: str) -> None:
        import json

        now = docs.get("k")
        out.append((step, now and now.version, now and json.dumps(now.content), bool(now) and now.generation == one.generation))

    note("created")
    docs.upsert("k", [1], expected=one.etag)
    note("replaced")
    try:
        docs.upsert("k", "lost", expected=one.etag)
    except errors.VersionConflict:
        note("stale")
    docs.delete("k")
    note("deleted")
    docs.upsert("k", "x")
    note("created anew")
    return spark.createDataFrame(out, "step string, version long, content string, same_generation boolean")


@_query("json_reindex", f"SELECT 'before' AS step, 0 AS found, NULL AS status, NULL AS documents UNION ALL SELECT 'after', (SELECT count(*) FROM {_DOCS} WHERE k >= 50), 'completed', (SELECT count(*) FROM {_DOCS})")
def _(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    docs.create_index("k", "number")
    before = docs.search({"k": {"$gte": 50}}).total
    task = docs.reindex("k")
    held = docs.tasks[task["task"]]
    return spark.createDataFrame([("before", before, None, None), ("after", docs.search({"k": {"$gte": 50}}).total, held["status"], held["documents"])], "step string, found long, status string, documents long")


# archives, logs, files


@_query("archive_round_trip", f"{_STATES} UNION ALL SELECT key, 'document', CAST(k AS VARCHAR) FROM {_DOCS}")
def _(spark, sf_dir):
    kvs, docs = Domains(spark, _place(spark)), Domains(spark, _place(spark), Documents)
    path = _place(spark)
    archive.export(spark, path, {"shop": _states(spark, sf_dir)}, {"shop": _documents(spark, sf_dir)})
    archive.restore(spark, path, kvs, docs, only="shop", rename="copy")
    values = kvs.get("copy").live().select("key", "status", F.col("value").cast("string").alias("value"))
    return values.unionByName(docs.get("copy").live().select("key", F.lit("document").alias("status"), F.get_json_object("content", "$.k").alias("value")))


@_query("archive_lines", f"SELECT 'manifest' AS t, 1 AS n UNION ALL SELECT 'kv-domain', 1 UNION ALL SELECT 'json-domain', 1 UNION ALL SELECT 'json-index', 1 UNION ALL SELECT 'kv', count(*) FROM ({_STATES}) UNION ALL SELECT 'doc', count(*) FROM {_DOCS}")
def _(spark, sf_dir):
    docs, path = _documents(spark, sf_dir), _place(spark)
    docs.create_index("k", "number")
    archive.export(spark, path, {"shop": _states(spark, sf_dir)}, {"shop": docs})
    return archive.read(spark, path).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


@_query("ndjson_files", f"SELECT key, version, k FROM {_DOCS}")
def _(spark, sf_dir):
    path = _place(spark)
    ndjson.write(_documents(spark, sf_dir).live(), path)
    good, _ = ndjson.parsed(ndjson.numbered(spark, path))
    docs = Documents(spark, _place(spark))
    docs.load(good)
    versions = spark.read.text(path).select(F.get_json_object("value", "$._key").alias("key"), F.get_json_object("value", "$._version").cast("long").alias("version"))
    return docs.live().select("key", F.get_json_object("content", "$.k").cast("long").alias("k")).join(versions, "key")


@_query("log_tail", "SELECT n_name AS line, false AS truncated FROM nation WHERE contains(n_name, '1') ORDER BY n_nationkey DESC LIMIT 8")
def _(spark, sf_dir):
    path = _place(spark)
    _raw(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    found = logs.tail(spark, path, 8, "1")
    return spark.createDataFrame([(x, found.truncated) for x in found.lines], "line string, truncated boolean")


@_query("log_files", "SELECT 1 AS nth, sum(length(n_name) + 1) AS bytes FROM nation")
def _(spark, sf_dir):
    path = _place(spark)
    _raw(spark, sf_dir, "nation").select("n_name").coalesce(1).write.text(path)
    return logs.files(spark, path).select(F.lit(1).alias("nth"), "bytes")


# functions


@_query("digests", "SELECT doc_id, sha256(text) AS sha256, lower(hex(encode(text))) AS hex, base64(encode(text)) AS base64, text AS back FROM documents")
def _(spark, sf_dir):
    text = F.col("text").cast("binary")
    rows = _raw(spark, sf_dir, "documents").select("doc_id", hashing.sha256(F.col("text")).alias("sha256"), hashing.hexed(text).alias("hex"), F.regexp_replace(F.base64(text), "[\r\n]", "").alias("base64"))
    return rows.withColumn("back", hashing.unhexed(F.col("hex")).cast("string"))


@_query("domain_prefixes", _values([("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")], "name, prefix"))
def _(spark, sf_dir):
    return spark.createDataFrame([(n, hashing.domain_prefix(n)) for n in ("", "a", "foobar")], "name string, prefix string")


@_query("generated_keys", "SELECT count(*) AS keys, count(*) AS well_formed FROM events")
def _(spark, sf_dir):
    lines = _raw(spark, sf_dir, "events").select(F.col("event_id").alias("line"), F.col("props").alias("text"))
    good, _ = ndjson.parsed(lines)
    return good.agg(F.count_distinct("key").alias("keys"), F.count_if(F.col("key").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("well_formed"))


# streams and schedules


@_query("change_stream", "SELECT 'n' || n_nationkey AS key, 'set' AS event FROM nation WHERE starts_with(CAST(n_nationkey AS VARCHAR), '1') UNION ALL SELECT 'n1', 'delete' UNION ALL SELECT 'n10', 'set'")
def _(spark, sf_dir):
    kv = KeyValues(spark, _place(spark))
    kv.batch([(f"n{r[0]}", "put", b"", 0) for r in _raw(spark, sf_dir, "nation").select("n_nationkey").collect()])
    kv.delete("n1")
    kv.set_null("n10")
    kv.delete("n2")
    out = _place(spark)
    query = watch.watch(spark, kv.folder, "n1", lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), _place(spark), once=True)
    query.awaitTermination()
    return spark.read.parquet(out).select("key", "event")


@_query("ticker", "SELECT event_type AS domain, date_trunc('second', ts) + to_seconds(i + 1) AS until, CAST(count(*) FILTER (event_id % 10 > 1) AS BIGINT) AS reads, CAST(count(*) FILTER (event_id % 10 = 0) AS BIGINT) AS writes FROM events, range(60) r(i) GROUP BY 1, 2")
def _(spark, sf_dir):
    from plumbline.catalogue import _operations

    return watch.ticker(_operations(spark, sf_dir)).select("domain", "until", "reads", "writes")


@_query("token_bucket", _values([(0, 1, True), (0, 2, True), (0, 1, False), (333, 1, False), (334, 1, True), (5000, 3, True), (5000, 1, False)], "millis, n, admitted"))
def _(spark, sf_dir):
    at = [0]
    bucket = watch.TokenBucket(3, lambda: at[0])
    out = []
    for millis, n in ((0, 1), (0, 2), (0, 1), (333, 1), (334, 1), (5000, 3), (5000, 1)):
        at[0] = millis
        out.append((millis, n, bucket.admit(n)))
    return spark.createDataFrame(out, "millis int, n int, admitted boolean")


@_query("backup_schedule", "SELECT 'nightly' AS schedule, TIMESTAMP '2024-03-01 02:30:00' + to_days(CAST(i AS INTEGER)) AS started, i < 3 AS removed FROM range(5) r(i)")
def _(spark, sf_dir):
    done, gone = [], []
    host = archive.Scheduler({"nightly": "30 2 * * *"}, lambda name, at: done.append((name, at)), lambda name, at: gone.append((name, at)), keep=2)
    at = datetime(2024, 3, 1)
    for minute in range(5 * 24 * 60):
        host.tick(at + timedelta(minutes=minute, seconds=20))
        host.tick(at + timedelta(minutes=minute, seconds=50))  # the same minute starts nothing again
    return spark.createDataFrame([(n, t, (n, t) in gone) for n, t in done], "schedule string, started timestamp_ntz, removed boolean")

