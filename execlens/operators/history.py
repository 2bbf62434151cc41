"""Window computations over ordered logs: deltas, islands, retention, running budgets, SCD-2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def deltas(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Adds previous, delta and regressed (the value fell)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    p = F.lag(value).over(w)
    return df.withColumn("previous", p).withColumn("delta", F.col(value) - F.col("previous")).withColumn("regressed", F.coalesce(F.col(value) < F.col("previous"), F.lit(False)))


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """Adds island and run: how many rows in a row the condition has held, 0 where it doesn't."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_on", F.coalesce(condition, F.lit(False)))
    d = d.withColumn("island", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum(F.when(F.col("_on"), 1).otherwise(0)).over(Window.partitionBy(*keys, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("run", F.when(F.col("_on"), n).otherwise(0)).drop("_on")


def episodes(df: DataFrame, keys: Sequence[str], order: str, condition: Column, least: int) -> DataFrame:
    """(keys, started_at, ended_at, windows) of islands of at least so many rows in a row; ended_at is the row that ends it, null while open."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_next", F.lead(order).over(w))
    d = run_lengths(d, keys, [order], condition).where("run > 0")
    return d.groupBy(*keys, "island").agg(F.min(order).alias("started_at"), F.max_by("_next", order).alias("ended_at"), F.max("run").alias("windows")).where(F.col("windows") >= least).drop("island")


def round_robin(df: DataFrame, position: str, cursor: Column) -> DataFrame:
    """Rows in the order of a scan that starts after the cursor and wraps."""
    return df.orderBy((F.col(position) <= cursor).asc(), F.col(position).asc())


def byte_page(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, limit: int) -> DataFrame:
    """Rows while the running sum of sizes stays within the limit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_bytes", F.sum(size).over(w)).where(F.col("running_bytes") <= limit)


def changed_versions(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """SCD-2: a version wherever the value differs from the one before, with valid_to = the next version's order (null: current)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    d = df.withColumn("_new", first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).where("_new").drop("_new")
    return d.withColumn("valid_to", F.lead(order[0]).over(w))


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Union, newest per key; a change wins a tie."""
    u = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in target.columns if c not in keys]
    best = u.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(order, "_new")).alias("_best"))
    return best.select(*keys, "_best.*").select(*target.columns)


def intervals(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Each transition's validity, up to the next one of its key."""
    return df.withColumn("valid_to", F.lead(at).over(Window.partitionBy(*keys).orderBy(at)))


def monotone_clock(df: DataFrame, order: str, at: str, keys: Sequence[str] = ()) -> DataFrame:
    """Logical time: the greatest time so far, per key."""
    return df.withColumn("logical_at", F.max(at).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
