"""The driver's contract, and each query against DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# answers that hold for tables of one size only
SIZED = {"agg18_bounded_count"}


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("key", sorted(ORACLES.keys() - SIZED))
def test_against_duckdb(key, spark, duck, sf_dir):
    df = QUERIES[key](spark, sf_dir)
    r = duck.execute(ORACLES[key])
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(plain(row[n]) for n in order) for row in df.collect())
    want = sorted(tuple(plain(row[names.index(n)]) for n in order) for row in r.fetchall())
    assert got == want


def test_run_summary_of_large_ids(spark, duck, tmp_path):
    """Ids from 1,000,000 outweigh days in the SQL's key; null ids and states count for nothing, repeated runs as often as they come."""
    orders = "(7, 1, 'F', DATE '1995-01-02'), (3000006, 1, 'O', DATE '1995-01-01'), (8, 2, 'P', DATE '1995-01-01'), (9, 2, NULL, DATE '1995-01-03'), (NULL, 2, 'F', DATE '1995-01-04'), (10, 2, 'F', NULL), (11, NULL, 'F', DATE '1995-01-01')"
    duck = duck.cursor()
    duck.execute("CREATE SCHEMA odd")
    duck.execute("USE odd")
    duck.execute(f"CREATE TABLE orders AS SELECT o_orderkey::BIGINT o_orderkey, o_custkey::BIGINT o_custkey, o_orderstatus, 1.0::DOUBLE o_totalprice, o_orderdate::TIMESTAMP o_orderdate, '1-URGENT' o_orderpriority FROM (VALUES {orders}) t(o_orderkey, o_custkey, o_orderstatus, o_orderdate)")
    duck.execute("CREATE TABLE customer AS SELECT c_custkey::BIGINT c_custkey, '' c_name, 0 c_nationkey, 0.0::DOUBLE c_acctbal, c_mktsegment FROM (VALUES (1, 'a'), (2, 'a'), (2, 'a'), (2, 'b'), (3, NULL), (NULL, 'a')) t(c_custkey, c_mktsegment)")
    for t in ("orders", "customer"):
        duck.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = QUERIES["agg22_run_summary"](spark, str(tmp_path)).select("run_id", "kind", "tasks", "latest").collect()
    want = duck.execute(ORACLES["agg22_run_summary"].replace("FROM conversations", "FROM main.conversations").replace("FROM events", "FROM main.events").replace("FROM lineitem", "FROM main.lineitem")).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert (1, "a", 2, "O") in want and (2, "a", 6, "P") in want
