"""The relational engine on small tables."""

import pytest

from plumbline import errors
from plumbline.operators.documents import Documents
from plumbline.operators.kv import KeyValues
from plumbline.operators.relational import Relational
from plumbline.plans.catalog import Limits


@pytest.fixture
def db(spark, tmp_path):
    return Relational(spark, str(tmp_path / "rel"))


def run(db, *statements):
    for s in statements:
        out = db.execute(s)
    return out


def rows(db, sql, params=()):
    return db.execute(sql, params).rows


@pytest.fixture
def t(db):
    run(db, "CREATE TABLE t (id INTEGER PRIMARY KEY, grp INTEGER, note TEXT, r REAL)", "CREATE INDEX t_grp ON t (grp)", "INSERT INTO t (id, grp, note, r) VALUES (1, 1, 'alpha', 1.5), (2, 1, 'beta', 2), (3, NULL, 'ga\\mma', NULL)")
    return db


def test_filters_and_unknown(t):
    ids = lambda w, *p: [r[0] for r in rows(t, f"SELECT id FROM t WHERE {w} ORDER BY id", p)]
    assert ids("NOT (grp = 1) OR note = 'ga\\mma'") == [3]
    assert ids("grp IN (1, 2)") == [1, 2] and ids("grp NOT IN (2)") == [1, 2] and ids("grp IS NULL") == [3]
    assert ids("note LIKE 'al%'") == [1] and ids("note LIKE 'ga\\m%'") == [3] and ids("note NOT LIKE '%e_a'") == [1, 3]
    assert ids("r > 1") == [1, 2] and ids("grp < 1.5") == [1, 2] and ids("? < id", 2) == [3] and ids("1 < 2 AND id >= 2") == [2, 3]
    for bad in ("grp = NULL", "grp = 'x'", "note LIKE 'a' AND missing = 1", "grp IN (1, NULL)", "grp LIKE 'a'", "r = TRUE"):
        with pytest.raises(errors.EngineError):
            ids(bad)
    with pytest.raises(errors.ParameterCount):
        ids("id = ?")


def test_order_and_limits(spark, t):
    assert [r[0] for r in rows(t, "SELECT id FROM t ORDER BY grp")] == [1, 2, 3]
    assert [r[0] for r in rows(t, "SELECT id FROM t ORDER BY grp DESC")] == [3, 1, 2]
    assert [r[0] for r in rows(t, "SELECT note FROM t ORDER BY grp ASC, r DESC")] == ["beta", "alpha", "ga\\mma"]
    t.catalog.limits.default_limit, t.catalog.limits.max_limit = 2, 2
    got = t.execute("SELECT id FROM t ORDER BY id")
    assert [r[0] for r in got.rows] == [1, 2] and got.limit_applied
    got = t.execute("SELECT id FROM t ORDER BY id LIMIT 2 OFFSET 1")
    assert [r[0] for r in got.rows] == [2, 3] and not got.limit_applied
    t.catalog.limits.sort_rows = 2
    with pytest.raises(errors.SortBufferExceeded):
        t.execute("SELECT id FROM t ORDER BY id")
    assert rows(t, "SELECT COUNT(*) FROM t WHERE grp = 1 ORDER BY id LIMIT 0") == [(2,)]


def test_joins(db):
    run(db, "CREATE TABLE b (id INTEGER PRIMARY KEY, note TEXT)", "CREATE TABLE a (id INTEGER PRIMARY KEY, b_id INTEGER, w REAL)", "INSERT INTO b VALUES (1, 'x'), (2, 'y')", "INSERT INTO a (id, b_id) VALUES (10, 1), (11, 2), (12, NULL), (13, 99)")
    assert rows(db, "SELECT a.id, b.note FROM a LEFT JOIN b ON a.b_id = b.id ORDER BY a.id") == [(10, "x"), (11, "y"), (12, None), (13, None)]
    assert rows(db, "SELECT a.id FROM a LEFT JOIN b ON b.id = a.b_id WHERE b.id IS NOT NULL AND note = 'x'") == [(10,)]
    assert db.execute("SELECT * FROM a LEFT JOIN b ON a.b_id = b.id").columns == ["id", "b_id", "w", "id", "note"]
    assert rows(db, "SELECT COUNT(*) FROM a LEFT JOIN b ON a.b_id = b.id") == [(4,)]
    for bad, kind in [
        ("SELECT id FROM a LEFT JOIN b ON a.b_id = b.id", errors.AmbiguousColumn),
        ("SELECT a.id FROM a LEFT JOIN a ON a.id = a.b_id", errors.DuplicateAlias),
        ("SELECT a.id FROM a LEFT JOIN b ON a.b_id = a.id", errors.InvalidJoin),
        ("SELECT a.id FROM a LEFT JOIN b ON a.w = b.id", errors.TypeMismatch),
        ("SELECT b.id FROM b LEFT JOIN a ON b.id = a.b_id", errors.UnindexedJoin),
        ("SELECT zz.id FROM a", errors.UnknownTable),
    ]:
        with pytest.raises(kind):
            db.execute(bad)
    db.catalog.limits.unindexed_joins = True
    assert len(rows(db, "SELECT b.id, a.id FROM b LEFT JOIN a ON b.id = a.b_id")) == 2
    db.catalog.limits.scan_rows = 3
    with pytest.raises(errors.ScanBudgetExceeded):
        db.execute("SELECT b.id, a.id FROM b LEFT JOIN a ON b.id = a.b_id")
    db.catalog.limits.joins = 0
    with pytest.raises(errors.JoinDepthExceeded):
        db.execute("SELECT a.id FROM a LEFT JOIN b ON a.b_id = b.id")


def test_counts_of_joins_make_no_product(spark, tmp_path):
    spark.range(300_000).selectExpr("id", "cast(if(id % 3 = 0, null, id % 2) as int) AS size").write.parquet(str(tmp_path / "p"))
    spark.range(300_000).selectExpr("id", "cast(if(id % 4 = 0, -0.0, 7) as double) AS amount").write.parquet(str(tmp_path / "l"))
    db = Relational(spark)
    for name, index in (("p", ()), ("l", ("amount",))):
        db.register(name, str(tmp_path / name), "id", index)
    frame = db.dataframe("SELECT COUNT(*) FROM p LEFT JOIN l ON p.size = l.amount")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join LeftOuter") :].count("Aggregate") == 2
    # 100 000 even sizes meet 75 000 amounts each; the others meet none and stay
    assert frame.columns == ["count"] and [tuple(r) for r in frame.collect()] == [(100_000 * 75_000 + 200_000,)]


def test_counts_of_joins_are_those_of_rows(db):
    run(
        db, "CREATE TABLE a (id INTEGER PRIMARY KEY, x INTEGER, y TEXT)", "CREATE TABLE b (id INTEGER PRIMARY KEY, x REAL, z INTEGER)", "CREATE TABLE c (id INTEGER PRIMARY KEY, y TEXT, z INTEGER)",
        "CREATE INDEX b_x ON b (x)", "CREATE INDEX c_y ON c (y)", "CREATE INDEX c_z ON c (z)", "CREATE VIEW some AS SELECT a.id AS id, a.y AS y, b.z AS z FROM a LEFT JOIN b ON a.x = b.x WHERE b.z < 9 AND a.id > 1", "CREATE VIEW pairs AS SELECT b.x AS x, c.y AS y FROM b LEFT JOIN c ON b.z = c.z",
        "INSERT INTO a VALUES (1, 1, 'u'), (2, 1, 'u'), (3, 1, 'v'), (4, 2, NULL), (5, NULL, 'u'), (6, NULL, NULL), (7, 8, 'w')",
        "INSERT INTO b VALUES (1, 1.0, 5), (2, 1.0, 5), (3, 1.0, NULL), (4, 2.0, 6), (5, NULL, 5), (6, 2.5, 6)", "INSERT INTO c VALUES (1, 'u', 5), (2, 'u', 5), (3, 'u', 6), (4, NULL, 5), (5, 'v', NULL)",
    )
    ab, abc = "a LEFT JOIN b ON a.x = b.x", "a LEFT JOIN b ON a.x = b.x LEFT JOIN c ON b.z = c.z"
    for tail, wanted in [
        (ab, 13), (f"{ab} WHERE b.z IS NULL", 6), (f"{ab} WHERE NOT (b.z = 5)", 1), (f"{ab} WHERE a.y = 'u' AND 1 < 2", 7), (f"{ab} WHERE a.x = b.z OR b.id IS NULL OR a.id = 2", 6), (f"{ab} WHERE a.id > 99", 0), (f"{ab} WHERE 2 < 1", 0),
        (abc, 25), (f"{abc} WHERE c.id > 1 AND b.x < 2", 12), (f"{abc} WHERE a.y = c.y", 8), (f"{abc} WHERE c.y IS NULL AND NOT (a.y = 'v')", 8),
        ("a LEFT JOIN b ON a.x = b.x LEFT JOIN c ON a.y = c.y", 27), ("a LEFT JOIN c ON a.y = c.y LEFT JOIN c d ON c.z = d.z WHERE d.id != 2", 15), ("a LEFT JOIN pairs p ON a.x = p.x", 25), ("some a LEFT JOIN c ON a.y = c.y WHERE c.z = 5", 4),
    ]:
        n = rows(db, f"SELECT COUNT(*) FROM {tail}")
        assert n == [(len(rows(db, f"SELECT a.id FROM {tail}")),)], tail
        assert n == [(wanted,)], tail


def test_views(t):
    run(t, "CREATE VIEW v AS SELECT id, grp AS g FROM t WHERE id > 1;", "CREATE VIEW v2 AS SELECT id FROM v", "CREATE VIEW v3 AS SELECT id FROM v2", "CREATE VIEW names AS SELECT id AS pk, note AS name FROM t", "CREATE VIEW everything AS SELECT * FROM t")
    assert t.catalog.entries["v"].text == "SELECT id, grp AS g FROM t WHERE id > 1"
    assert rows(t, "SELECT id FROM v WHERE id < 3") == [(2,)] and sorted(rows(t, "SELECT id FROM v3")) == [(2,), (3,)]
    assert rows(t, "SELECT x.id, n.name FROM t x LEFT JOIN names n ON x.grp = n.pk ORDER BY x.id") == [(1, "alpha"), (2, "alpha"), (3, None)]
    for bad in ("CREATE VIEW v4 AS SELECT id FROM v3", "CREATE VIEW w AS SELECT id FROM t ORDER BY id", "CREATE VIEW w AS SELECT COUNT(*) FROM t", "CREATE VIEW w AS SELECT id FROM t WHERE id = ?", "CREATE VIEW w AS SELECT id, grp AS id FROM t", "INSERT INTO v VALUES (1)", "ALTER TABLE t DROP COLUMN note", "DROP TABLE t", "SELECT t.id FROM t LEFT JOIN v ON t.grp = v.id"):
        with pytest.raises(errors.EngineError):
            t.execute(bad)
    t.execute("ALTER TABLE t ADD COLUMN extra TEXT DEFAULT 'd'")
    assert t.execute("SELECT * FROM everything").columns[-1] == "extra"


def test_keys_defaults_and_sequences(db):
    run(db, "CREATE TABLE s (id INTEGER PRIMARY KEY AUTOINCREMENT, v INTEGER DEFAULT 7, at TIMESTAMP DEFAULT CURRENT_TIMESTAMP, u TEXT UNIQUE)")
    assert [db.execute("INSERT INTO s (u) VALUES ('a')").last_pk, db.execute("INSERT INTO s (u) VALUES ('b')").last_pk] == [1, 2]
    assert db.execute("INSERT INTO s (id, u) VALUES (100, NULL)").last_pk == 100
    assert db.execute("INSERT INTO s (u) VALUES (NULL)").last_pk == 101
    db.execute("DELETE FROM s WHERE id = 101")
    assert db.execute("INSERT INTO s (v) VALUES (1)").last_pk == 102
    assert db.execute("INSERT INTO s (v) VALUES (1), (2)").last_pk is None
    assert rows(db, "SELECT v FROM s WHERE id = 1") == [(7,)] and rows(db, "SELECT COUNT(*) FROM s WHERE at IS NULL") == [(0,)]
    for bad, kind in [("INSERT INTO s (id) VALUES (1)", errors.DuplicateKey), ("INSERT INTO s (id) VALUES (500), (500)", errors.DuplicateKey), ("INSERT INTO s (u) VALUES ('a')", errors.UniqueViolation), ("INSERT INTO s (v) VALUES (2.5)", errors.TypeMismatch), ("INSERT INTO s (v) VALUES (1, 2)", errors.ArityMismatch), ("UPDATE s SET id = 3", errors.ImmutableKey), ("UPDATE s SET u = 'q'", errors.UniqueViolation), ("INSERT INTO s (at) VALUES ('2020-01-01T00:00:00+02:00')", errors.InvalidTimestamp)]:
        with pytest.raises(kind):
            db.execute(bad)
    assert rows(db, "SELECT COUNT(*) FROM s") == [(6,)]


def test_changes_leave_unknown_rows(t):
    assert t.execute("DELETE FROM t WHERE grp = 5").affected == 0
    assert t.execute("UPDATE t SET r = 3, note = ? WHERE grp = 1", ("n",)).affected == 2
    assert rows(t, "SELECT id, note, r FROM t ORDER BY id") == [(1, "n", 3.0), (2, "n", 3.0), (3, "ga\\mma", None)]
    assert t.execute("DELETE FROM t WHERE NOT grp = 5").affected == 2 and rows(t, "SELECT id FROM t") == [(3,)]
    assert t.insert_row("t", {"ID": 9, "Note": "z"}).last_pk == 9
    with pytest.raises(errors.ImmutableKey):
        t.update_row("t", 9, {"id": 8})
    assert t.update_row("t", 9, {"note": "y"}).affected == 1 and t.delete_row("t", 9).affected == 1


def test_evolution_on_read(spark, t, tmp_path):
    run(t, "ALTER TABLE t ADD COLUMN c TEXT NOT NULL DEFAULT 'old'", "ALTER TABLE t ADD COLUMN d INTEGER DEFAULT 5")
    t.execute("INSERT INTO t (id, d) VALUES (4, NULL)")
    assert rows(t, "SELECT id, c, d FROM t ORDER BY id") == [(1, "old", 5), (2, "old", 5), (3, "old", 5), (4, "old", None)]
    run(t, "ALTER TABLE t RENAME COLUMN note TO text_", "ALTER TABLE t DROP COLUMN r", "ALTER TABLE t RENAME TO u")
    again = Relational(spark, str(tmp_path / "rel"))
    assert rows(again, "SELECT text_ FROM u WHERE id = 1") == [("alpha",)]
    run(again, "ALTER TABLE u ADD COLUMN r REAL")
    assert rows(again, "SELECT r FROM u WHERE id = 1") == [(None,)]
    for bad in ("ALTER TABLE u ADD COLUMN x INTEGER NOT NULL", "ALTER TABLE u ADD COLUMN x INTEGER UNIQUE", "ALTER TABLE u DROP COLUMN id", "ALTER TABLE u DROP COLUMN grp", "CREATE TABLE u (id INTEGER PRIMARY KEY)", "CREATE TABLE z (a INTEGER)", "CREATE TABLE z (id INTEGER PRIMARY KEY, d INTEGER DEFAULT 'x')"):
        with pytest.raises(errors.EngineError):
            again.execute(bad)


def test_insertions_append_and_vacuum_merges(t):
    table = t.catalog.table("t")
    t.execute("INSERT INTO t (id) VALUES (7)")
    assert table is not t.catalog.table("t") and t.catalog.table("t").parts == [0, 1]
    t.execute("DELETE FROM t WHERE id = 7")
    t.execute("INSERT INTO t (id) VALUES (8)")
    assert t.catalog.table("t").parts == [0, 2, 3] and t.vacuum("t") == 4  # the part without a hit stays
    assert sorted(r[0] for r in rows(t, "SELECT id FROM t")) == [1, 2, 3, 8] and t.catalog.table("t").parts == [4]


def test_unique_index_needs_unique_rows(t):
    with pytest.raises(errors.UniqueViolation):
        t.execute("CREATE UNIQUE INDEX one ON t (grp)")
    run(t, "CREATE UNIQUE INDEX one ON t (note)", "DROP INDEX one")
    with pytest.raises(errors.UnknownIndex):
        t.execute("DROP INDEX one")


def test_links_and_expansion(spark, tmp_path):
    kv, docs = KeyValues(spark, str(tmp_path / "kv")), Documents(spark, str(tmp_path / "docs"))
    kv.put("k1", b"hello")
    kv.put("k2", b"\xff\xfe\xfd")
    kv.set_null("k3")
    docs.create({"a": 1}, "d1")
    db = Relational(spark, str(tmp_path / "rel"), kv=kv, docs=docs)
    run(db, "CREATE TABLE c (id INTEGER PRIMARY KEY, at TIMESTAMP)", "INSERT INTO c VALUES (1, 1500)", "CREATE TABLE o (id INTEGER PRIMARY KEY, c_id INTEGER REFERENCES c, k KVREF, d JSONREF)", "INSERT INTO o VALUES (1, 1, 'k1', 'd1'), (2, NULL, 'k2', NULL), (3, NULL, 'k3', NULL)")
    for bad, kind in [("INSERT INTO o VALUES (4, 9, NULL, NULL)", errors.ReferenceViolation), ("INSERT INTO o VALUES (4, 1, 'none', NULL), (5, 1, 'k1', NULL)", errors.LinkViolation), ("INSERT INTO o VALUES (4, 1, NULL, 'zz')", errors.LinkViolation)]:
        with pytest.raises(kind):
            db.execute(bad)
    got = db.execute("SELECT id, c_id, k, d FROM o ORDER BY id", expand="*").expanded
    assert got[0] == {"c_id": {"id": 1, "at": "1970-01-01T00:00:01.500Z"}, "k": {"exists": True, "value": "hello", "encoding": "utf8"}, "d": {"exists": True, "document": {"a": 1}}}
    assert got[1]["k"] == {"exists": True, "value": "//79", "encoding": "base64"} and got[1]["c_id"] is None and got[1]["d"] is None
    assert got[2]["k"] == {"exists": True, "value": None, "encoding": None}
    kv.delete("k1")
    run(db, "DELETE FROM c WHERE id = 1")
    got = db.execute("SELECT id, c_id, k FROM o WHERE id = 1", expand=["k", "c_id"]).expanded
    assert got == [{"k": {"exists": False}, "c_id": None}]
    with pytest.raises(errors.InvalidExpand):
        db.execute("SELECT id FROM o", expand=["id"])
    gone = Relational(spark, str(tmp_path / "rel"), kv=None, docs=docs)
    assert rows(gone, "SELECT id FROM o WHERE k IS NOT NULL") == []
    assert gone.execute("SELECT k FROM o WHERE id = 1", expand="*").expanded == [{"k": None}]
    assert gone.null_out(("kv",)) == 3 and db.catalog is not gone.catalog


def test_browse(t):
    assert t.browse("t", {"GRP": "1"}, limit=1, offset=1).row_count == 1
    assert [e["name"] for e in t.catalog.describe()] == ["t"]
    with pytest.raises(errors.TypeMismatch):
        t.browse("t", {"grp": "x"})
    with pytest.raises(errors.Forbidden):
        t.execute("DELETE FROM t", granted="read")


def test_limits(spark, tmp_path):
    db = Relational(spark, str(tmp_path / "r"), Limits(columns=2, indexes=1, text=10))
    with pytest.raises(errors.LimitExceeded):
        db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT, c TEXT)")
    run(db, "CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT)", "CREATE INDEX i ON t (b)")
    with pytest.raises(errors.LimitExceeded):
        db.execute("CREATE INDEX j ON t (b)")
    with pytest.raises(errors.TextTooLong):
        db.execute("INSERT INTO t VALUES (1, 'aaaaaaaaaaaaaaa')")
