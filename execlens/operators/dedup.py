"""Set operations and deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_anywhere(*queues: DataFrame) -> DataFrame:
    """(pending): whether any queue has a row."""
    out = queues[0].select(F.lit(1).alias("x")).limit(1)
    for q in queues[1:]:
        out = out.unionAll(q.select(F.lit(1).alias("x")).limit(1))
    return out.agg((F.count("*") > 0).alias("pending"))


def declaration_changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, removed or changed."""
    a, b = old.select(key, F.col(content).alias("_a"), F.lit(1).alias("_in_a")), new.select(key, F.col(content).alias("_b"), F.lit(1).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose key the target lacks, the first by order of each key."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in keys]), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    return first.join(target.select(*keys), list(keys), "left_anti")


def conflicting(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys submitted with more than one content."""
    return rows.groupBy(key).agg(F.count_distinct(payload).alias("contents")).where("contents > 1")


def distinct_blockers(rows: DataFrame) -> DataFrame:
    """Distinct rows by their canonical JSON, in its order."""
    return rows.withColumn("blocker", F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]))).select("blocker").distinct().orderBy("blocker")
