"""Queries over the engine's own operators, with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import cron, jsonpath, timestamps
from plumbline.operators import documents, links, metrics, relational, versions
from plumbline.plans.catalog import Limits
from plumbline.sources import archive, logs, ndjson
from plumbline.streaming import watch

FLAGSHIP = "top_orders"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Keys, indexed columns and references of the tables. lineitem and conversations have no key of one column; their first column stands in and is never probed for uniqueness.
KEYS = {
    "region": ("r_regionkey", (), {}), "nation": ("n_nationkey", ("n_regionkey",), {"n_regionkey": "region"}), "customer": ("c_custkey", ("c_mktsegment", "c_nationkey"), {"c_nationkey": "nation"}), "supplier": ("s_suppkey", ("s_nationkey",), {"s_nationkey": "nation"}), "part": ("p_partkey", ("p_brand",), {}), "orders": ("o_orderkey", ("o_custkey", "o_totalprice", "o_orderpriority"), {"o_custkey": "customer"}), "lineitem": ("l_orderkey", ("l_orderkey", "l_partkey", "l_quantity"), {}), "events": ("event_id", ("user_id",), {}), "documents": ("doc_id", ("lang",), {}), "labels": ("doc_id", (), {}), "pages": ("page_id", (), {}), "benchmark": ("item_id", (), {}), "conversations": ("conv_id", ("conv_id",), {}),
}


def database(spark: SparkSession, sf_dir: str, *tables: str, views: dict[str, str] | None = None) -> relational.Relational:
    from plumbline.plans.catalog import View

    db = relational.Relational(spark, limits=Limits())
    for name in tables:
        key, indexes, references = KEYS[name]
        db.register(name, f"{sf_dir}/{name}.parquet", key, indexes, references)
    for name, text in (views or {}).items():
        db.catalog.free(name)
        from plumbline.plans.parser import parse

        db.planner.check_view(parse(text))
        db.catalog.entries[name] = View(name, text)
    return db


def _sql(name: str, tables: str, sql: str, oracle: str | None = None, params: tuple = (), views: dict[str, str] | None = None, names: list[str] | None = None) -> None:
    """Register a query of the dialect. Without an oracle of its own, its text is standard SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = database(spark, sf_dir, *tables.split(), views=views).dataframe(sql, params)
        return out.toDF(*names) if names else out

    QUERIES[name] = run
    ORACLE[name] = oracle or sql


def _query(name: str, oracle: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


# scans, projection, filters

_sql(FLAGSHIP, "orders customer", "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' AND o.o_totalprice > 400000 ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 50")
_sql("scan_project_alias", "nation", "SELECT n_name AS name, n_nationkey AS id, n_regionkey FROM nation")
_sql("scan_all", "region", "SELECT * FROM region")
_sql("pk_point", "orders", "SELECT * FROM orders WHERE o_orderkey = 42")
_sql("pk_range", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 14900")
_sql("pk_two_sided", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
_sql("literal_left_range", "customer", "SELECT c_custkey, c_name FROM customer WHERE 100 > c_custkey")
_sql("index_point", "customer", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
_sql("index_range", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000")
_sql("like_prefix", "orders", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1-%'")
_sql("like_wild", "part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%_e_ %'")
_sql("not_like", "part", "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%A%' AND p_name NOT LIKE 'a_%'")
_sql("in_list", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
_sql("not_in_list", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (1, 2, 3) AND o_orderstatus NOT IN ('O')")
_sql("bool_logic", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_returnflag = 'A' OR l_quantity < 20.0) AND (l_linestatus = 'O' OR NOT l_discount > 0.05)")
_sql("col_vs_col", "orders customer", "SELECT o.o_orderkey, c.c_acctbal FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice < c.c_acctbal")
_sql("int_real_widening", "part", "SELECT p_partkey, p_size FROM part WHERE p_size > 12.5 AND p_retailprice >= 950")
_sql("iso_ts_literal", "orders", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1998-01-01T00:00:00Z'", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")
_sql("ts_day_rolls_over", "orders", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-02-31 00:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-03 00:00:00'")
_sql("params_bound", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'", (300000, "O"))
_sql("constant_compare", "region", "SELECT r_name FROM region WHERE 1 < 2.5 AND 'a' != 'b'")

# joins

_sql("left_join_pk", "orders customer", "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
_sql("left_join_unmatched", "documents labels", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
_sql("left_join_fanout", "customer orders", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
_sql("left_join_chain", "orders customer nation region", "SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
_sql("self_join", "nation", "SELECT a.n_name AS name, b.n_name AS other FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey")
_sql("inner_emulation", "documents labels", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NOT NULL", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
_sql("anti_emulation", "documents labels", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
_sql("join_where_split", "orders customer", "SELECT o.o_orderkey, c.c_custkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000 AND c.c_acctbal < 0 AND NOT c.c_mktsegment = 'BUILDING'")
_sql("join_null_logic", "documents labels", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.quality = 1) OR d.lang = 'de'")
_sql("join_int_real", "part lineitem", "SELECT COUNT(*) FROM part p LEFT JOIN lineitem l ON p.p_size = l.l_quantity", "SELECT count(*) AS count FROM part p LEFT JOIN lineitem l ON CAST(p.p_size AS DOUBLE) = l.l_quantity")
_sql("join_star_dup_names", "nation", "SELECT * FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey", "SELECT a.n_nationkey AS a1, a.n_name AS a2, a.n_regionkey AS a3, b.n_nationkey AS b1, b.n_name AS b2, b.n_regionkey AS b3 FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey", names=["a1", "a2", "a3", "b1", "b2", "b3"])

# counts, order, limits

_sql("count_star", "lineitem", "SELECT COUNT(*) FROM lineitem", "SELECT count(*) AS count FROM lineitem")
_sql("count_where", "orders", "SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 0", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
_sql("count_join", "customer orders", "SELECT COUNT(*) FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT count(*) AS count FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
_sql("count_join_residual", "documents labels", "SELECT COUNT(*) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL", "SELECT count(*) AS count FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
_sql("order_nulls_asc", "documents labels", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality, d.doc_id LIMIT 450", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS LAST, d.doc_id LIMIT 450")
_sql("order_nulls_desc", "documents labels", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC, d.doc_id LIMIT 50", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS FIRST, d.doc_id LIMIT 50")
_sql("order_multi", "customer", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_nationkey, c_mktsegment DESC, c_custkey LIMIT 100")
_sql("limit_offset", "orders", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35")
_sql("topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")

# views

_VIEWS = {"rich": "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer WHERE c_acctbal > 5000", "placed": "SELECT o.o_orderkey AS id, n.n_name AS nation, o.o_totalprice AS price FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey", "names": "SELECT c_custkey AS pk, c_name AS name FROM customer", "rich_few": "SELECT id, name FROM rich WHERE nation < 5"}
_sql("view_simple", "customer", "SELECT id, name FROM rich WHERE id < 500", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 5000 AND c_custkey < 500", views={"rich": _VIEWS["rich"]})
_sql("view_join_from", "orders customer nation", "SELECT p.id, p.price FROM placed p WHERE p.nation = 'NATION_3' AND p.price > 100000", "SELECT o.o_orderkey AS id, o.o_totalprice AS price FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name = 'NATION_3' AND o.o_totalprice > 100000", views={"placed": _VIEWS["placed"]})
_sql("view_in_join", "orders customer", "SELECT o.o_orderkey, v.name FROM orders o LEFT JOIN names v ON o.o_custkey = v.pk WHERE o.o_orderkey < 1000", "SELECT o.o_orderkey, c.c_name AS name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey < 1000", views={"names": _VIEWS["names"]})
_sql("view_over_view", "customer", "SELECT * FROM rich_few WHERE id > 10", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 5 AND c_custkey > 10", views={k: _VIEWS[k] for k in ("rich", "rich_few")})


@_query("catalog_browse", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', 'table', '{k}', {len(i)})" for n, (k, i, _) in KEYS.items()) + ") t(name, kind, primary_key, n_indexes) JOIN (SELECT table_name AS name, count(*) AS n_columns FROM information_schema.columns GROUP BY 1) c USING (name)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = database(spark, sf_dir, *KEYS).catalog.describe()
    return spark.createDataFrame([(r["name"], r["kind"], r["primary_key"], len(r["columns"]), len(r["indexes"])) for r in rows], "name string, kind string, primary_key string, n_columns long, n_indexes int")


# changes, as what a table holds afterwards


def _raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query("ref_check_violations", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf_dir):
    return relational.missing_references(_raw(spark, sf_dir, "documents"), "doc_id", _raw(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@_query("pk_dup_check", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def _(spark, sf_dir):
    rows = _raw(spark, sf_dir, "lineitem")
    return relational.duplicate_keys(rows.limit(0), rows, "l_orderkey")


@_query("unique_check", "SELECT c_name FROM customer WHERE c_custkey < 10 UNION ALL SELECT c_name FROM customer GROUP BY c_name HAVING count(*) > 1")
def _(spark, sf_dir):
    rows = _raw(spark, sf_dir, "customer")
    return relational.duplicate_keys(rows.where("c_custkey < 10"), rows, "c_name")


# links


@_query("expand_reference", "SELECT o.o_orderkey, c.c_custkey AS ref_key, c.c_name AS ref_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def _(spark, sf_dir):
    db = database(spark, sf_dir, "orders", "customer", "nation", "region")
    planned = db.planner.plan(_parsed("SELECT o_orderkey, o_custkey FROM orders"))
    out = links.expand(planned.frame, planned, links.targets(planned, "*", 0, 8), db).toDF("o_orderkey", "o_custkey", "object")
    return out.select("o_orderkey", F.get_json_object("object", "$.c_custkey").cast("long").alias("ref_key"), F.get_json_object("object", "$.c_name").alias("ref_name"))


def _parsed(sql: str):
    from plumbline.plans.parser import parse

    return parse(sql)


@_query("expand_kv", "SELECT c_custkey, u.user_id IS NOT NULL AS found, u.etype AS value FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS etype FROM events GROUP BY user_id) u ON c_custkey = u.user_id")
def _(spark, sf_dir):
    log = _event_log(spark, sf_dir).withColumn("op", F.lit(versions.PUT))
    found = links.kv_lookup(versions.live(log, now=0))
    rows = _raw(spark, sf_dir, "customer").select("c_custkey").join(found, F.col("c_custkey").cast("string") == F.col("__key"), "left")
    return rows.select("c_custkey", F.coalesce(F.get_json_object("__object", "$.exists").cast("boolean"), F.lit(False)).alias("found"), F.get_json_object("__object", "$.value").alias("value"))


@_query("expand_json", "SELECT c_custkey, CAST(json_extract(e.props, '$.k') AS BIGINT) AS k FROM customer LEFT JOIN events e ON c_custkey = e.event_id")
def _(spark, sf_dir):
    found = links.doc_lookup(_event_docs(spark, sf_dir))
    rows = _raw(spark, sf_dir, "customer").select("c_custkey").join(found, F.lpad(F.col("c_custkey").cast("string"), 12, "0") == F.col("__key"), "left")
    return rows.select("c_custkey", F.get_json_object("__object", "$.document.k").cast("long").alias("k"))


@_query("link_mask", "SELECT doc_id, CAST(NULL AS VARCHAR) AS lang FROM documents")
def _(spark, sf_dir):
    db = database(spark, sf_dir, "documents")
    db.catalog.table("documents").column("lang").type = "KVREF"
    return db.dataframe("SELECT doc_id, lang FROM documents WHERE lang IS NULL")


# versions: events as a log of user_id, an error as a deletion and a signup as a null


def _event_log(spark, sf_dir):
    op = F.when(F.col("event_type") == "error", versions.DELETE).when(F.col("event_type") == "signup", versions.NULL).otherwise(versions.PUT)
    expire = F.when(F.col("event_id") % 5 == 0, F.col("event_id")).otherwise(0).cast("long")
    return _raw(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").cast("binary").alias("value"), F.col("event_id").alias("ts"), op.alias("op"), expire.alias("expire_at"))


_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events{}) WHERE rn = 1"
_SHOWN = "SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'signup' THEN 'null' ELSE 'present' END AS status, CASE WHEN event_type <> 'signup' THEN event_type END AS value, event_id AS ts FROM ({}) WHERE event_type <> 'error'{}"


def _shown(live: DataFrame) -> DataFrame:
    return live.select("key", "status", F.col("value").cast("string").alias("value"), "ts")


@_query("kv_latest", _SHOWN.format(_LAST.format(""), ""))
def _(spark, sf_dir):
    return _shown(versions.live(_event_log(spark, sf_dir), now=-1))


@_query("kv_snapshot", _SHOWN.format(_LAST.format(" WHERE event_id <= 5000"), ""))
def _(spark, sf_dir):
    return _shown(versions.live(_event_log(spark, sf_dir), snapshot=5000, now=-1))


@_query("kv_ttl_live", _SHOWN.format(_LAST.format(""), " AND (event_id % 5 <> 0 OR event_id = 0 OR event_id > 7000)"))
def _(spark, sf_dir):
    return _shown(versions.live(_event_log(spark, sf_dir), now=7000))


@_query("kv_tombstone", f"SELECT CAST(user_id AS VARCHAR) AS key FROM ({_LAST.format('')}) WHERE event_type = 'error'")
def _(spark, sf_dir):
    return versions.latest(_event_log(spark, sf_dir)).where(F.col("op") == versions.DELETE).select("key")


@_query("kv_prefix_scan", _SHOWN.format(_LAST.format(""), " AND starts_with(CAST(user_id AS VARCHAR), '1')"))
def _(spark, sf_dir):
    return _shown(versions.live(_event_log(spark, sf_dir).where(F.col("key").startswith("1")), now=-1))


@_query("kv_merge", "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY user_id")
def _(spark, sf_dir):
    log = _event_log(spark, sf_dir)
    return versions.merge(log, log.where("ts > 100")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "compact_versions",
    """
WITH v AS (SELECT user_id, event_id, event_type, event_id % 5 = 0 AND event_id > 0 AND event_id <= 4000 AS expired FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM v WHERE event_id <= 5000)
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS ts FROM v WHERE event_id > 5000
UNION ALL
SELECT CAST(user_id AS VARCHAR), event_id FROM k WHERE n = 1 AND NOT CASE WHEN event_type = 'error' THEN event_id < 5000 ELSE expired END""",
)
def _(spark, sf_dir):
    return versions.compact(_event_log(spark, sf_dir), 5000, 4000).select("key", "ts")


@_query("compact_without_readers", f"SELECT CAST(user_id AS VARCHAR) AS key, event_id AS ts FROM ({_LAST.format('')}) WHERE event_type = 'error' OR NOT (event_id % 5 = 0 AND event_id > 0 AND event_id <= 4000)")
def _(spark, sf_dir):
    return versions.compact(_event_log(spark, sf_dir), None, 4000).select("key", "ts")


# documents: the properties of events


def _event_docs(spark, sf_dir):
    return _raw(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("key"), F.col("props").alias("content"), F.lit(1).cast("long").alias("version"))


_INDEXES = {"k": "number"}
_K = "CAST(json_extract(props, '$.k') AS DOUBLE)"
_KEY = "lpad(CAST(event_id AS VARCHAR), 12, '0')"


@_query("json_path", f"SELECT {_KEY} AS key, {_K} AS k FROM events")
def _(spark, sf_dir):
    return _event_docs(spark, sf_dir).select("key", jsonpath.typed(F.col("content"), "k", "number").alias("k"))


def _search(name: str, filters: dict, where: str) -> None:
    @_query(name, f"SELECT {_KEY} AS key FROM events WHERE {where}")
    def _(spark, sf_dir):
        return _event_docs(spark, sf_dir).where(documents.condition(_INDEXES, filters)).select("key")


_search("json_eq", {"k": 69}, f"{_K} = 69")
_search("json_range", {"k": {"$gte": 90}}, f"{_K} >= 90")
_search("json_less", {"k": {"$lt": 3.5}}, f"{_K} < 3.5")


@_query("json_and", f"SELECT event_id FROM events WHERE event_type = 'click' AND {_K} > 50")
def _(spark, sf_dir):
    rows = _raw(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.struct(F.get_json_object("props", "$.k").cast("long").alias("k")).alias("props"))).alias("content"))
    return rows.where(documents.condition({"type": "string", "props.k": "number"}, {"type": "click", "props.k": {"$gt": 50}})).select("event_id")


@_query("json_page", f"SELECT {_KEY} AS key, (SELECT count(*) FROM events WHERE {_K} >= 50) AS total FROM events WHERE {_K} >= 50 ORDER BY event_id LIMIT 30 OFFSET 20")
def _(spark, sf_dir):
    found, total, _ = documents.page(_event_docs(spark, sf_dir).where(documents.condition(_INDEXES, {"k": {"$gte": 50}})), 30, 20)
    return found.select("key", F.lit(total).cast("long").alias("total"))


@_query("json_total", f"SELECT count(*) AS total FROM events WHERE {_K} >= 50")
def _(spark, sf_dir):
    return _event_docs(spark, sf_dir).where(documents.condition(_INDEXES, {"k": {"$gte": 50}})).agg(F.count(F.lit(1)).alias("total"))


@_query("json_type_guard", f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_K} END AS as_number, CASE WHEN event_id % 2 = 1 THEN CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) END AS as_string FROM events")
def _(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    rows = _raw(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a":{"b":'), k, F.lit("}}"))).otherwise(F.concat(F.lit('{"a":{"b":"'), k, F.lit('"}}'))).alias("content"))
    return rows.select("event_id", jsonpath.typed(F.col("content"), "a.b", "number").alias("as_number"), jsonpath.typed(F.col("content"), "a.b", "string").alias("as_string"))


@_query("ndjson_export_lines", None)
def _(spark, sf_dir):
    return ndjson.lines_of(_event_docs(spark, sf_dir)).select("value")


@_query("ndjson_round_trip", f"SELECT {_KEY} AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf_dir):
    lines = ndjson.lines_of(_event_docs(spark, sf_dir)).select(F.xxhash64("key").alias("line"), F.col("value").alias("text"))
    good, _bad = ndjson.parsed(lines)
    return good.select("key", F.get_json_object("content", "$.k").cast("long").alias("k"))


# metrics: events as operations, of which the type is the domain


def _operations(spark, sf_dir):
    kind = F.when(F.col("event_id") % 10 == 0, "write").when(F.col("event_id") % 10 == 1, "rejected").otherwise("read")
    return _raw(spark, sf_dir, "events").select(F.col("event_type").alias("domain"), "ts", kind.alias("kind"), (F.col("value") * 1000).cast("long").alias("micros"), (F.col("event_id") % 3 > 0).alias("hit"))


_OPS = "SELECT event_type AS domain, ts, event_id % 10 AS m, CAST(trunc(value * 1000) AS BIGINT) AS us, event_id % 3 > 0 AS hit FROM events"
_BOUNDS = ["us < 10", "us >= 10 AND us < 100", "us >= 100 AND us < 1000", "us >= 1000 AND us < 10000", "us >= 10000 AND us < 100000", "us >= 100000 AND us < 1000000", "us >= 1000000"]
_COUNTED = "CAST(count(*) FILTER (m > 1) AS BIGINT) AS reads, CAST(count(*) FILTER (m = 0) AS BIGINT) AS writes, CAST(count(*) FILTER (m > 1 AND hit) AS BIGINT) AS hits, CAST(count(*) FILTER (m > 1 AND NOT hit) AS BIGINT) AS misses, CAST(count(*) FILTER (m = 1) AS BIGINT) AS rejections"
_HIST = ", ".join(f"CAST(count(*) FILTER (m > 1 AND {b}) AS BIGINT) AS h{i}" for i, b in enumerate(_BOUNDS))
_SECONDS = f"SELECT domain, date_trunc('second', ts) AS second, {_COUNTED}, {_HIST} FROM ({_OPS}) GROUP BY 1, 2"
_ALL = ["reads", "writes", "hits", "misses", "rejections", *(f"h{i}" for i in range(7))]


@_query("metrics_bucket_1s", _SECONDS)
def _(spark, sf_dir):
    return metrics.per_second(_operations(spark, sf_dir))


@_query("metrics_rollup_60s", "SELECT domain, second, " + ", ".join(f"CAST(sum({c}) OVER w AS BIGINT) AS {c}" for c in _ALL) + f" FROM ({_SECONDS}) WINDOW w AS (PARTITION BY domain ORDER BY second RANGE BETWEEN INTERVAL 59 SECONDS PRECEDING AND CURRENT ROW)")
def _(spark, sf_dir):
    return metrics.rolling(metrics.per_second(_operations(spark, sf_dir)))


@_query("metrics_hist", f"SELECT domain, {_HIST} FROM ({_OPS}) GROUP BY domain")
def _(spark, sf_dir):
    return metrics.per_second(_operations(spark, sf_dir)).groupBy("domain").agg(*[F.sum(f"h{i}").cast("long").alias(f"h{i}") for i in range(7)])


def _percentile(p: int) -> str:
    rank = f"((h0 + h1 + h2 + h3 + h4 + h5 + h6) * {p} + 99) // 100"
    cases = " ".join(f"WHEN {' + '.join(f'h{j}' for j in range(i + 1))} >= {rank} THEN {m}" for i, m in enumerate([5, 50, 500, 5000, 50000, 500000, 2000000]))
    return f"CAST(CASE WHEN h0 + h1 + h2 + h3 + h4 + h5 + h6 = 0 THEN 0 {cases} END AS BIGINT) AS p{p}"


@_query("metrics_p50_p99", f"SELECT domain, {_percentile(50)}, {_percentile(99)} FROM (SELECT domain, {_HIST} FROM ({_OPS}) GROUP BY domain)")
def _(spark, sf_dir):
    return metrics.summary(metrics.per_second(_operations(spark, sf_dir))).select("domain", "p50", "p99")


@_query("metrics_hit_rate", f"SELECT domain, CASE WHEN hits + misses = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / (hits + misses) END AS hit_rate FROM (SELECT domain, {_COUNTED} FROM ({_OPS}) GROUP BY domain)")
def _(spark, sf_dir):
    return metrics.summary(metrics.per_second(_operations(spark, sf_dir))).select("domain", "hit_rate")


@_query("metrics_heartbeat", f"SELECT count(*) AS operations, {_COUNTED}, CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS uptime FROM ({_OPS})")
def _(spark, sf_dir):
    return metrics.heartbeat(_operations(spark, sf_dir))


# streams, schedules, logs


@_query("watch_prefix", "SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS event, event_id AS ts FROM events WHERE starts_with(CAST(user_id AS VARCHAR), '2')")
def _(spark, sf_dir):
    return watch.events(_event_log(spark, sf_dir), "2")


@_query("retention_remove", "SELECT event_type AS schedule, event_id AS started FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events WHERE event_id % 2 = 0 AND event_id % 7 <> 0) WHERE n > 5")
def _(spark, sf_dir):
    rows = _raw(spark, sf_dir, "events").select(F.col("event_type").alias("schedule"), F.col("event_id").alias("started"), (F.col("event_id") % 2 == 0).alias("complete"), (F.col("event_id") % 7 == 0).alias("uploaded"))
    return archive.retained(rows, 5).select("schedule", "started")


@_query("cron_match", "SELECT event_id FROM events WHERE date_part('minute', ts) % 15 = 0 AND date_part('hour', ts) BETWEEN 9 AND 17 AND date_part('dow', ts) BETWEEN 1 AND 5")
def _(spark, sf_dir):
    return _raw(spark, sf_dir, "events").where(cron.matched("*/15 9-17 * * 1-5", F.col("ts"))).select("event_id")


@_query("log_tail_filter", "SELECT * FROM (SELECT doc_id AS line, text FROM documents WHERE contains(text, 'the') ORDER BY doc_id DESC LIMIT 100) ORDER BY line")
def _(spark, sf_dir):
    return logs.last(_raw(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), "text"), 100, "the")


@_query("iso_format", "SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S') || CASE WHEN CAST(date_part('millisecond', ts) AS BIGINT) % 1000 <> 0 THEN '.' || lpad(CAST(CAST(date_part('millisecond', ts) AS BIGINT) % 1000 AS VARCHAR), 3, '0') ELSE '' END || 'Z' AS at FROM events")
def _(spark, sf_dir):
    return _raw(spark, sf_dir, "events").select("event_id", timestamps.rendered(F.col("ts")).alias("at"))


@_query("iso_parse", "SELECT o_orderkey, o_orderdate AS at FROM orders")
def _(spark, sf_dir):
    return _raw(spark, sf_dir, "orders").select("o_orderkey", timestamps.parsed(timestamps.rendered(F.col("o_orderdate"))).alias("at"))
