"""Reusable predicates and scalar expressions as Columns.  `now` is always a parameter."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Name = str | Column


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def claimable(state: Name, due_at: Name, revision: Name, now: Column, revisions: Sequence[str], queued: str = "queued") -> Column:
    """Queued, due at `now`, and of a registry revision that the worker knows."""
    return (col(state) == queued) & (col(due_at) <= now) & col(revision).isin(list(revisions))


def in_states(state: Name, states: Sequence[str]) -> Column:
    return col(state).isin(list(states))


def optional_equal(df: DataFrame, column: str, value: Any | None) -> DataFrame:
    """Filter on column = value only where a value is asked for."""
    return df if value is None else df.where(F.col(column) == F.lit(value))


def after_key(columns: Sequence[str], values: Sequence[Column]) -> Column:
    """Row-value comparison (columns) > (values); each value has its column's type."""
    return F.struct(*[F.col(c) for c in columns]) > F.struct(*[v.alias(c) for c, v in zip(columns, values)])


def bounded(column: str, limit: int) -> list[Column]:
    """The column where its bytes fit, and a flag where they don't."""
    size = F.octet_length(column)
    return [F.when(size <= limit, F.col(column)).alias(column), F.coalesce(size > limit, F.lit(False)).alias(f"{column}_oversized")]


def json_path(column: Name, path: str, limit: int) -> Column:
    """A JSON path of texts that are short enough and valid; null otherwise."""
    c = col(column)
    return F.when((F.length(c) <= limit) & F.try_parse_json(c).isNotNull(), F.get_json_object(c, path))


def delivery_label(delivered: Column, last_error: Column) -> Column:
    return F.when(delivered, "delivered").when(last_error.isNotNull(), "failed").otherwise("pending")


def safe_label(label: Name, limit: int = 64) -> Column:
    """Labels that are long, null or hold odd characters become `other`."""
    c = col(label)
    return F.when((F.length(c) <= limit) & c.rlike("^[A-Za-z0-9_.:-]*$"), c).otherwise("other")


def freshness(captured_at: Name, now: Column, within: float) -> Column:
    """observed if captured in the last `within` seconds, else unknown (also for clocks that ran ahead)."""
    age = now - col(captured_at)
    return F.when((age >= 0) & (age <= F.lit(within)), "observed").otherwise("unknown")


def backoff(attempt: Name, initial: float, multiplier: float, maximum: float) -> Column:
    """min(maximum, initial * multiplier ^ (attempt - 1)); an overflow is the maximum."""
    if initial == 0 or multiplier == 1:
        return F.lit(float(min(initial, maximum)))
    return F.least(F.lit(float(maximum)), F.lit(float(initial)) * F.pow(F.lit(float(multiplier)), col(attempt) - 1))


def both_greatest(a: Column, b: Column) -> Column:
    """Greatest of two, null if either is (Spark's greatest skips nulls)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def canonical_json(column: Name) -> Column:
    """JSON text with sorted keys and no blanks; null for invalid texts and repeated keys.  Floats keep Spark's notation."""
    return F.to_json(F.try_parse_json(col(column)))


def content_digest(column: Name, prefix: str = "") -> Column:
    return F.sha2(F.concat(F.lit(prefix), col(column)), 256)


def effective_time(wall: Column, elapsed: Column, domain: Column, wall0: Column, elapsed0: Column, domain0: Column) -> Column:
    """The checkpoint's wall time carried on by elapsed time; null if the clock domain changed or elapsed ran back."""
    return F.when((domain == domain0) & (elapsed >= elapsed0), F.greatest(wall, wall0 + (elapsed - elapsed0)))


def effective_deadline(constraints: Column) -> Column:
    """Least of deadline - reserve over an array of (deadline_at, reserve)."""
    return F.array_min(F.transform(constraints, lambda c: c["deadline_at"] - c["reserve"]))


def nearest_rank(values: Column, percent: int) -> Column:
    """Nearest-rank percentile of a grouped column."""
    s = F.sort_array(F.collect_list(values))
    return F.element_at(s, F.greatest(F.ceil(F.lit(percent) * F.size(s) / 100), F.lit(1)).cast("int"))


def finite(x: Name) -> Column:
    c = col(x)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def retry_state(attempt: Column, maximum: Column, again: str = "queued", dead: str = "dead") -> Column:
    return F.when(attempt >= maximum, dead).otherwise(again)
