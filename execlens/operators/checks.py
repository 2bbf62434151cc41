"""Integrity scans: declared row invariants, keys and references, transitions, revisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The execution states' legal transitions (fixed values).
TRANSITIONS = {
    "queued": ("leased", "cancelled", "dead", "recovery_required"),
    "leased": ("running", "queued", "cancelled", "dead", "recovery_required"),
    "running": ("queued", "succeeded", "failed", "timed_out", "cancelled", "dead", "recovery_required"),
    "recovery_required": ("queued", "cancelled"),
}
TERMINAL = ("succeeded", "failed", "timed_out", "cancelled", "dead")


def violations(df: DataFrame, invariants: Mapping[str, Column]) -> DataFrame:
    """(rule, n) for each invariant that some rows break; a null outcome breaks none, as in SQL checks.  One pass over the rows."""
    counts = df.agg(*[F.count_if(~c).alias(name) for name, c in invariants.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in invariants])).alias("x")).select("x.*").where("n > 0")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parents: DataFrame, parent: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(parents.select(F.col(parent).alias(column)), column, "left_anti")


def illegal_transitions(events: DataFrame, from_state: str = "from_state", to_state: str = "to_state") -> DataFrame:
    """(from_state, to_state, n) of observed edges that aren't legal.  Edges are counted before the comparison, so the join has a row per edge."""
    pairs = [F.struct(F.lit(a).alias("f"), F.lit(b).alias("t")) for a, bs in TRANSITIONS.items() for b in bs]
    legal = events.sparkSession.range(1).select(F.explode(F.array(*pairs)).alias("x")).select(F.col("x.f").alias(from_state), F.col("x.t").alias(to_state))
    seen = events.where(F.col(from_state).isNotNull()).groupBy(from_state, to_state).agg(F.count("*").alias("n"))
    return seen.join(legal, [from_state, to_state], "left_anti")


def revision_gaps(df: DataFrame, key: str, revision: str) -> DataFrame:
    """Rows whose revision isn't one above the last of their key."""
    w = Window.partitionBy(key).orderBy(revision)
    return df.withColumn("previous", F.lag(revision).over(w)).where(F.col("previous").isNotNull() & (F.col(revision) != F.col("previous") + 1))


def schema_difference(actual: StructType, declared: StructType) -> list[str]:
    """What differs between a table and its declaration: missing, undeclared and retyped columns."""
    a, d = {f.name: f.dataType for f in actual}, {f.name: f.dataType for f in declared}
    return sorted([f"missing {n}" for n in d.keys() - a.keys()] + [f"undeclared {n}" for n in a.keys() - d.keys()] + [f"{n}: {a[n].simpleString()} instead of {d[n].simpleString()}" for n in a.keys() & d.keys() if a[n] != d[n]])
