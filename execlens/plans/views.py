"""The record tables' analogues among the driver's tables: executions, events, attempts, items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c: str) -> Column:
    """Days since 1970, as a whole number."""
    return F.date_diff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("execution_id"), F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("state"), day("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("revision"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("sequence"), F.col("user_id").alias("execution_id"), "event_type", F.col("value").cast("decimal(18,2)").alias("value"), F.col("props").alias("payload"), "ts")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("execution_id"), F.col("l_linenumber").cast("long").alias("attempt"), F.col("l_linestatus").alias("state"), F.col("l_returnflag").alias("reason"), F.col("l_quantity").cast("long").alias("amount"), day("l_shipdate").alias("shipped"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("worker"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("run_id"), F.col("role").alias("item_key"), F.col("turn").alias("revision"), F.col("text").alias("value"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").cast("decimal(18,2)").alias("allowance"), F.col("c_nationkey").alias("owner"))


#: The same views for the oracle.
SQL = """WITH executions AS (SELECT o_orderkey AS execution_id, o_custkey AS run_id, o_orderstatus AS state, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS created_at, o_orderpriority AS revision, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders),
ev AS (SELECT event_id AS sequence, user_id AS execution_id, event_type, CAST(value AS DECIMAL(18,2)) AS value, props AS payload, ts FROM events),
attempts AS (SELECT l_orderkey AS execution_id, CAST(l_linenumber AS BIGINT) AS attempt, l_linestatus AS state, l_returnflag AS reason, CAST(l_quantity AS BIGINT) AS amount, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS shipped, l_partkey AS part, l_suppkey AS worker FROM lineitem),
items AS (SELECT conv_id AS run_id, role AS item_key, turn AS revision, text AS value FROM conversations),
runs AS (SELECT c_custkey AS run_id, c_mktsegment AS kind, CAST(c_acctbal AS DECIMAL(18,2)) AS allowance, c_nationkey AS owner FROM customer)
"""
