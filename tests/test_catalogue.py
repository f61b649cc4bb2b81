"""Every query with SQL of its own gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline import catalogue, statements

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (str, int, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(statements.QUERIES))
def test_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in got.collect()), key=str)
    if name not in catalogue.ORACLE:
        assert rows
        return
    found = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)


def test_contract(spark):
    assert entry.entry(spark).columns == ["o_orderkey", "c_name", "o_totalprice"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    db = catalogue.database(spark, SF, "orders")
    plan = db.dataframe("SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'")._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan ==") :]
    assert "GreaterThan(o_totalprice,400000.0)" in scan and "EqualTo(o" in scan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in scan
