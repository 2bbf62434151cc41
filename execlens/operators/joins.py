"""Joins: semi, anti, as-of, latest, head-of-line, cursor and consistency joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def absent(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of left without a match."""
    return left.join(right.select(*on), list(on), "left_anti")


def present(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on), list(on), "left_semi")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest by the order columns, which decide ties.

    An aggregate with partial maxima rather than a window: a hot key costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in [*order, *rest]]), F.struct(*[F.col(c) for c in order])).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def as_of(history: DataFrame, keys: Sequence[str], revision: str, at: Column) -> DataFrame:
    """State at a revision: of each key the last version not after `at`."""
    return latest(history.where(F.col(revision) <= at), keys, [revision])


def as_of_each(versions: DataFrame, points: DataFrame, keys: Sequence[str], revision: str, point: str) -> DataFrame:
    """For every point of a key the last version not after it, as a running last value over the union: one shuffle, no theta join.

    Points without an earlier version keep a null version.
    """
    v = versions.select(*keys, F.col(revision).alias("_at"), F.lit(0).alias("_kind"), F.col(revision).alias("_rev"))
    p = points.select(*keys, F.col(point).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(versions.schema[revision].dataType).alias("_rev"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return v.unionByName(p).withColumn("_rev", F.last("_rev", ignorenulls=True).over(w)).where("_kind = 1").select(*keys, F.col("_at").alias(point), F.col("_rev").alias(revision))


def head_of_line(queue: DataFrame, key: str, sequence: str, open_rows: Column) -> DataFrame:
    """Of each key the oldest open row: no older one is undelivered."""
    o = queue.where(open_rows)
    return o.join(o.groupBy(key).agg(F.min(sequence).alias(sequence)), [key, sequence], "left_semi")


def since_cursor(watches: DataFrame, log: DataFrame, key: str, cursor: str, sequence: str) -> DataFrame:
    """Log rows after each watch's cursor: an equi join on the key with the rest as its condition."""
    return watches.join(log, key).where(F.col(sequence) > F.col(cursor))


def inconsistent(a: DataFrame, b: DataFrame, key: str, value_a: Column, value_b: Column) -> DataFrame:
    """Keys that both sides have with different contents (nulls are a content)."""
    return a.join(b, key).where(~value_a.eqNullSafe(value_b)).select(key)


def listed(df: DataFrame, ids: str, member: str) -> DataFrame:
    """One row per member of a serialised id list, for equi joins instead of a search in each list."""
    return df.withColumn(member, F.explode(F.from_json(ids, "array<long>")))


def merge_evidence(a: DataFrame, b: DataFrame, keys: Sequence[str], sequence: str, evidence: str) -> DataFrame:
    """Per key the evidence of the highest sequence of two reports."""
    u = a.select(*keys, sequence, evidence).unionByName(b.select(*keys, sequence, evidence))
    return u.groupBy(*keys).agg(F.max_by(evidence, F.struct(sequence, evidence)).alias(evidence))
