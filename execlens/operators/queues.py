"""Leases, deliveries, cursors and obligations as facts derived from their records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clock_upsert(clocks: DataFrame, observed: DataFrame, key: str, at: str) -> DataFrame:
    """(key, at): each clock never goes back: the greatest of what it was and what was observed since."""
    return clocks.select(key, at).unionByName(observed.select(key, at)).groupBy(key).agg(F.max(at).alias(at))


def lease_grants(log: DataFrame, key: str, order: str, granted: Column) -> DataFrame:
    """Rows of log that grant a lease, with its fence: how many leases of the key were granted, this one included."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.where(granted).withColumn("fence", F.count("*").over(w))


def broken_fences(grants: DataFrame, key: str, order: str, fence: str = "fence") -> DataFrame:
    """Grants whose fence isn't one above the last of their key."""
    w = Window.partitionBy(key).orderBy(order)
    return grants.withColumn("_before", F.coalesce(F.lag(fence).over(w), F.lit(0))).where(F.col(fence) != F.col("_before") + 1).drop("_before")


def completion(succeeded: Column, retryable: Column, attempt: Column, max_attempts: Column) -> Column:
    """What a completion leads to: done, retry while attempts are left and the failure allows it, else dead."""
    return F.when(succeeded, "done").when(retryable & (attempt < max_attempts), "retry").otherwise("dead")


def cancellations(log: DataFrame, key: str, order: str, cancelled: Column, ran: Column) -> DataFrame:
    """(key, cancelled_at, runs): the first cancellation of each key, null without one, and how often it ran."""
    return log.groupBy(key).agg(F.min(F.when(cancelled, F.col(order))).alias("cancelled_at"), F.count_if(ran).alias("runs"))


def retried_dead(letters: DataFrame, key: str, attempts: Column, max_attempts: Column) -> DataFrame:
    """(key, state): what a manual retry makes of letters: the dead, out of attempts, are pending again; others are kept."""
    return letters.groupBy(key).agg(F.when(F.max(attempts) >= F.max(max_attempts), "pending").otherwise("kept").alias("state"))


def apply_deletions(rows: DataFrame, plan: DataFrame, key: str, revision: str) -> tuple[DataFrame, DataFrame]:
    """Rows that a deletion plan of (key, revision) leaves, and per key the watermark through which they are gone."""
    return rows.join(plan.select(key, revision), [key, revision], "left_anti"), plan.groupBy(key).agg(F.max(revision).alias("expired_through"))


def parked(executions: DataFrame, effects: DataFrame, key: str, ended: Column, unfinished: Column) -> DataFrame:
    """Ended executions that leave unfinished effects, which need recovery."""
    return executions.where(ended).join(effects.where(unfinished).select(key), key, "left_semi")


def overdrawn(ledger: DataFrame, allowances: DataFrame, scope: str, order: Sequence[str], amount: str, allowance: str) -> DataFrame:
    """Ledger rows after which their scope has spent more than its allowance, with what was spent by then."""
    w = Window.partitionBy(scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("spent", F.sum(amount).over(w)).join(allowances.select(scope, allowance), scope).where(F.col("spent") > F.col(allowance))


def continuations(runs: DataFrame, run: str, next_run: Column) -> DataFrame:
    """(previous, next): links from runs to the runs that continue them, of those that exist."""
    return runs.select(F.col(run).alias("previous"), next_run.alias("next")).join(runs.select(F.col(run).alias("next")), "next", "left_semi").select("previous", "next")


def acknowledged(cursors: DataFrame, acks: DataFrame, key: str, cursor: str) -> DataFrame:
    """(key, cursor): after acknowledgements in any order; a cursor moves forward only, and only for a subscription that exists."""
    best = acks.groupBy(key).agg(F.max(cursor).alias("_ack"))
    return cursors.join(best, key, "left").select(key, F.greatest(F.col(cursor), F.col("_ack")).alias(cursor))


def incarnations(totals: DataFrame, keys: Sequence[str], incarnation: str, amount: str) -> DataFrame:
    """(keys, incarnation, total): the newest collector of each key, and the totals of all: each counts with its greatest, since a collector's own total only grows."""
    each = totals.groupBy(*keys, incarnation).agg(F.max(amount).alias("_amount"))
    return each.groupBy(*keys).agg(F.max(incarnation).alias("incarnation"), F.sum("_amount").alias("total"))


def expired(leases: DataFrame, key: str, expires_at: str, now: Column) -> DataFrame:
    """(key, lease_expires_at) of keys whose last lease is over."""
    return leases.groupBy(key).agg(F.max(expires_at).alias("lease_expires_at")).where(F.col("lease_expires_at") <= now)


def dead_letters(failures: DataFrame, key: str, max_attempts: int) -> DataFrame:
    """(key, tries) of keys that failed as often as they may, or more."""
    return failures.groupBy(key).agg(F.count("*").alias("tries")).where(F.col("tries") >= max_attempts)


def receipts(results: DataFrame, key: str, **streams: DataFrame) -> DataFrame:
    """(key, a boolean per stream): which of several independent receipt streams know each result."""
    out = results.select(key).distinct()
    for name, s in streams.items():
        out = out.join(s.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    return out.select(key, *[F.col(f"_{name}").isNotNull().alias(name) for name in streams])


def two_hop_latency(first: DataFrame, second: DataFrame, key: str, at: str, then: str) -> DataFrame:
    """(key, latency): from a record to its first appearance in the next queue; keys that have not arrived are left out."""
    return first.join(second.groupBy(key).agg(F.min(then).alias("_then")), key).select(key, (F.col("_then") - F.col(at)).alias("latency"))


def continuity(samples: DataFrame, keys: Sequence[str], order: Sequence[str], wall: str, elapsed: str, domain: str, max_gap: float) -> DataFrame:
    """samples, in their order, with continuity: first, unknown_domain, domain_change, elapsed_backward, wall_backward, gap, clock_jump or continuous.

    Elapsed time compares within one clock domain only; a gap is elapsed time beyond max_gap, a clock
    jump a wall clock that moved further from the elapsed one than that.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    s = samples.withColumns({f"_{c}": F.lag(c).over(w) for c in (wall, elapsed, domain)})
    gone, moved = F.col(elapsed) - F.col(f"_{elapsed}"), F.col(wall) - F.col(f"_{wall}")
    kind = (
        F.when(F.col(domain).isNull(), "unknown_domain").when(F.col(f"_{elapsed}").isNull(), "first").when(~F.col(domain).eqNullSafe(F.col(f"_{domain}")), "domain_change")
        .when(gone < 0, "elapsed_backward").when(moved < 0, "wall_backward").when(gone > max_gap, "gap").when(F.abs(moved - gone) > max_gap, "clock_jump").otherwise("continuous")
    )
    return s.withColumn("continuity", kind).drop(f"_{wall}", f"_{elapsed}", f"_{domain}")


def tick_counts(log: DataFrame, at: str, length: int) -> DataFrame:
    """(tick, n): rows of each turn of a polling loop of so long a period."""
    return log.groupBy(F.floor(F.col(at) / F.lit(length)).cast("long").alias("tick")).agg(F.count("*").alias("n"))


def wait_intervals(log: DataFrame, key: str, at: str, begins: Column, ends: Column) -> DataFrame:
    """(key, started_at, ended_at): the first begin and the last end, null while there is none."""
    return log.groupBy(key).agg(F.min(F.when(begins, F.col(at))).alias("started_at"), F.max(F.when(ends, F.col(at))).alias("ended_at"))
