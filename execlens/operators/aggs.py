"""Aggregates: zero-filled state counts, queue status, budget rollups, digests and labelled blockers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state_counts(df: DataFrame, state: str, states: Sequence[str]) -> DataFrame:
    """(state, n) for every declared state, zero where no row has it; other states are left out."""
    declared = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in states])).alias("state"))
    got = df.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("n"))
    return declared.join(got, "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def count_where(**conditions: Column) -> list[Column]:
    """One count column per named condition, for a single wide aggregate."""
    return [F.count_if(c).alias(name) for name, c in conditions.items()]


def queue_status(df: DataFrame, state: str, created_at: str, pending: str, delivering: str, dead: str) -> DataFrame:
    s = F.col(state)
    return df.agg(*count_where(pending=s == pending, delivering=s == delivering, dead=s == dead), F.min(F.when(s == pending, F.col(created_at))).alias("oldest_pending"))


def merged_metrics(df: DataFrame, keys: Sequence[str], count: str, first_at: str, last_at: str) -> DataFrame:
    """Mergeable metric: sum of counts, least first and greatest last time."""
    return df.groupBy(*keys).agg(F.sum(count).alias("count"), F.min(first_at).alias("first_at"), F.max(last_at).alias("last_at"))


#: Reservations that a scope may hold (fixed value).
MAX_RESERVATIONS = 10_000


def budget_rollup(reservations: DataFrame, budgets: DataFrame, scope: Sequence[str], spent_before: DataFrame | None = None) -> DataFrame:
    """Per scope of budgets: spent, reserved, unknown, pending, entries, invalid, available.

    reservations are (scope, state, amount, actual); spent_before (scope, spent) holds imported and
    archived spending.  Reserved and unknown rows are pending and hold their amount.  Any unknown
    one makes available null: unknown isn't zero; otherwise it is never below 0.  A row of another
    state, a negative amount, a settled row without an actual amount or a pending one with it is
    invalid, and then no figure of its scope holds: all are null.
    """
    state, amount, actual = F.col("state"), F.col("amount"), F.col("actual")
    settled, held = F.coalesce(state == "settled", F.lit(False)), F.coalesce(state.isin("reserved", "unknown"), F.lit(False))
    valid = F.coalesce(amount >= 0, F.lit(False)) & (settled & F.coalesce(actual >= 0, F.lit(False)) | held & actual.isNull())
    r = reservations.groupBy(*scope).agg(
        F.sum(F.when(settled, actual)).alias("spent"), F.sum(F.when(held, amount)).alias("reserved"),
        *count_where(unknown=state == "unknown", pending=held, entries=F.lit(True), invalid=~valid),
    )
    out = budgets.join(r, list(scope), "left")
    if spent_before is not None:
        out = out.join(spent_before.groupBy(*scope).agg(F.sum("spent").alias("_before")), list(scope), "left").withColumn("spent", F.coalesce("spent", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_before")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("spent", "reserved", "unknown", "pending", "entries", "invalid")})
    ok = F.col("invalid") == 0
    left = F.col("allowance") - F.col("spent") - F.col("reserved")
    out = out.withColumn("available", F.when(ok & (F.col("unknown") == 0), F.greatest(left, F.lit(0).cast(dict(out.dtypes)["allowance"]))))
    return out.withColumns({c: F.when(ok, F.col(c)) for c in ("spent", "reserved")})


def budget_label(expired: Column, amount: Column, limit: int = MAX_RESERVATIONS) -> Column:
    """What a scope of budget_rollup says to a request; the first that holds: unknown where a row is invalid, expired, unknown, pending, capacity_exhausted, exhausted, available."""
    return (
        F.when(F.col("invalid") > 0, "unknown").when(expired, "expired").when(F.col("unknown") > 0, "unknown").when(F.col("pending") > 0, "pending")
        .when(F.col("entries") >= limit, "capacity_exhausted").when(F.col("spent") + amount > F.col("allowance"), "exhausted").otherwise("available")
    )


def logical_digest(df: DataFrame) -> DataFrame:
    """(digest, rows): order-insensitive digest over all rows.

    The SHA-256 of each row is cut into eight 32-bit numbers, which are summed each by itself; the
    digest is the SHA-256 of the eight sums and the number of rows.  Sums need no rows gathered.
    """
    d = df.select(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256).alias("d"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).alias(f"p{i}") for i in range(8)]
    total = d.agg(*parts, F.count("*").alias("rows"))
    return total.select(F.sha2(F.concat_ws(",", *[F.col(f"p{i}").cast("decimal(30,0)").cast("string") for i in range(8)], F.col("rows").cast("string")), 256).alias("digest"), "rows")


def bounded_count(df: DataFrame, limit: int) -> DataFrame:
    """(count, lower_bound, complete): exact up to limit, else null with a lower bound."""
    n = df.limit(limit + 1).agg(F.count("*").alias("n"))
    fits = F.col("n") <= limit
    return n.select(F.when(fits, F.col("n")).alias("count"), F.least(F.col("n"), F.lit(limit)).cast("long").alias("lower_bound"), fits.alias("complete"))


def blockers(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(code, n) for each labelled set that isn't empty."""
    out = None
    for code, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def reason_codes(**conditions: Column) -> Column:
    """The names of the conditions that hold, in the order given."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]), lambda x: x.isNotNull())
