"""Reports over all runs at once: work availability, run diagnostics and cancellation evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import aggs
from .checks import TERMINAL

LIVE = ("leased", "running")
OPEN_EFFECTS = ("performing", "indeterminate")
RUN_TERMINAL = ("succeeded", "failed", "cancelled")


def _per_run(df: DataFrame, **counts: Column) -> DataFrame:
    return df.groupBy("run_id").agg(*aggs.count_where(**counts))


def work_availability(
    runs: DataFrame, registrations: DataFrame, executions: DataFrame, commands: DataFrame, results: DataFrame, effects: DataFrame, tasks: DataFrame, waits: DataFrame,
    now: Column, revisions: Sequence[str] | None = None, effect_scan_limit: int = 1000,
) -> DataFrame:
    """Per run what could be claimed now, what is under way, what keeps the rest, and why; nothing is changed.

    runs (run_id, state), registrations (run_id, execution_id), executions (execution_id, state,
    registry_revision, next_attempt_at, lease_expires_at), commands (run_id, delivered), results
    (execution_id, state), effects (execution_id, state), tasks (run_id), waits (run_id, state).

    Without revisions claimable_now is null, not checked.  An execution that is registered but not
    known makes the number of results to sync unknown.  Effects have a bound: if there are more than
    effect_scan_limit in all, their number is null rather than a part of it; a bound of 0 checks none.
    Counts are partial sums before any shuffle; each table is read once.
    """
    s, due = F.col("state"), F.col("next_attempt_at")
    known = registrations.select("run_id", "execution_id").join(executions.withColumn("_known", F.lit(True)), "execution_id", "left")
    queued = (s == "queued") & (due <= now)
    live, gone = s.isin(*LIVE) & (F.col("lease_expires_at") > now), s.isin(*LIVE) & (F.col("lease_expires_at") <= now)
    later = (s == "queued") & (due > now)
    counts = known.groupBy("run_id").agg(
        *aggs.count_where(
            queued_ready=queued, claimable_now=queued & (F.col("registry_revision").isin(*revisions) if revisions else F.lit(False)), active_leases=live, expired_leases=gone,
            retry_backoff=later, recovery_required=s == "recovery_required", to_sync=s.isin(*TERMINAL), missing=F.col("_known").isNull(),
        ),
        F.min(F.when(later, due)).alias("next_retry"), F.min(F.when(live, F.col("lease_expires_at"))).alias("next_expiry"),
    )
    delivery = _per_run(registrations.select("run_id", "execution_id").join(results.select("execution_id", "state"), "execution_id"), pending_delivery=s != "delivered")
    bound = effects.limit(effect_scan_limit + 1).agg((F.count("*") <= effect_scan_limit).alias("effects_complete"))
    open_effects = _per_run(registrations.select("run_id", "execution_id").join(effects.where(s.isin(*OPEN_EFFECTS)).select("execution_id"), "execution_id"), unknown_effects=F.lit(True))
    out = runs.select("run_id", "state")
    for part in (counts, _per_run(commands, pending_commands=~F.col("delivered")), delivery, open_effects, _per_run(tasks, tasks=F.lit(True)), _per_run(waits, open_waits=s == "open")):
        out = out.join(part, "run_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    every = ("queued_ready", "claimable_now", "active_leases", "expired_leases", "retry_backoff", "recovery_required", "to_sync", "missing", "pending_commands", "pending_delivery", "unknown_effects", "tasks", "open_waits")
    out = out.withColumns({c: n(c) for c in every}).withColumn("effects_complete", bound.scalar())
    checked = effect_scan_limit > 0
    out = out.withColumn("effects_complete", F.col("effects_complete") & F.lit(checked))
    out = out.withColumn("unknown_effects", F.when(F.col("effects_complete"), F.col("unknown_effects")))
    if revisions is None:
        out = out.withColumn("claimable_now", F.lit(None).cast("long"))
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    reasons = aggs.reason_codes(
        terminal_run=s.isin(*RUN_TERMINAL), no_tasks=F.col("tasks") == 0, binding_not_checked=F.lit(revisions is None), claimable_now=some("claimable_now"),
        binding_mismatch=F.coalesce(F.col("queued_ready") > F.col("claimable_now"), F.lit(False)), active_leases=some("active_leases"), expired_leases_pending_reap=some("expired_leases"),
        retry_backoff=some("retry_backoff"), pending_commands=some("pending_commands"), pending_result_sync=some("to_sync"), pending_result_delivery=some("pending_delivery"),
        application_wait=some("open_waits"), recovery_required=some("recovery_required"), unknown_effects=some("unknown_effects"), execution_not_observed=some("missing"),
        effects_not_checked=F.lit(not checked), effect_scan_limit_exceeded=F.lit(checked) & ~F.col("effects_complete"),
    )
    return out.select(
        "run_id", "state", *[c for c in every if c not in ("to_sync",)], F.when(F.col("missing") == 0, F.col("to_sync")).alias("pending_sync"), "next_retry",
        F.least("next_retry", "next_expiry").alias("next_hint"), reasons.alias("reasons"), (F.col("effects_complete") & (F.col("missing") == 0)).alias("complete"),
    )


def run_diagnostics(tasks: DataFrame, executions: DataFrame, waits: DataFrame, now: Column, task_limit: int = 50, count_limit: int = 1000) -> DataFrame:
    """Per run a page of its first task_limit tasks, each with what blocks it, beside the run's totals.

    tasks (run_id, task_id, execution_id, dependencies: array of task ids), executions (execution_id,
    state, next_attempt_at, lease_expires_at), waits (run_id, state).  Totals are exact up to
    count_limit and null above it, with a lower bound.  A dependency blocks until it is terminal; an
    unknown execution is its own blocker.  Pages are cut by rank before the shuffle of whole runs.
    """
    s = F.col("state")
    e = executions.select("execution_id", "state", "next_attempt_at", "lease_expires_at", F.lit(True).alias("_known"))
    each = tasks.select("run_id", "task_id", "execution_id", "dependencies").join(e, "execution_id", "left")
    totals = each.groupBy("run_id").agg(F.count("*").alias("_n"), *aggs.count_where(settled=s.isin(*TERMINAL)))
    waiting = waits.groupBy("run_id").agg(F.count_if(s == "open").alias("open_waits"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("task_id"))
    page = each.withColumn("rank", rank).where(F.col("rank") <= task_limit)
    needs = page.select("run_id", "task_id", F.explode("dependencies").alias("need"))
    states = each.select("run_id", F.col("task_id").alias("need"), s.isin(*TERMINAL).alias("_done"))
    unmet = needs.join(states, ["run_id", "need"], "left").where(~F.coalesce("_done", F.lit(False))).groupBy("run_id", "task_id").agg(F.count("*").alias("unmet"))
    blocker = (
        F.when(F.col("_known").isNull(), "execution_not_observed").when(s.isin(*TERMINAL), None).when(F.col("unmet") > 0, "dependencies")
        .when(s == "recovery_required", "recovery_required").when((s == "queued") & (F.col("next_attempt_at") > now), "retry_backoff")
        .when(s.isin(*LIVE) & (F.col("lease_expires_at") <= now), "expired_lease").when(s.isin(*LIVE), "running").when(s == "queued", "claimable")
    )
    fits = F.col("_n") <= count_limit
    out = page.join(unmet, ["run_id", "task_id"], "left").join(totals, "run_id").join(waiting, "run_id", "left")
    return out.select(
        "run_id", "rank", "task_id", "execution_id", "state", F.coalesce("unmet", F.lit(0)).cast("long").alias("unmet"), blocker.alias("blocker"),
        F.when(fits, F.col("_n")).alias("tasks"), F.least(F.col("_n"), F.lit(count_limit)).cast("long").alias("tasks_at_least"), "settled",
        F.coalesce("open_waits", F.lit(0)).cast("long").alias("open_waits"), (F.col("_n") > task_limit).alias("has_more"),
    )


UNSETTLED_EFFECTS = ("prepared", "performing", "indeterminate")
EFFECTS_SHOWN = 100


def cancellation_evidence(
    attempts: DataFrame, commands: DataFrame, executions: DataFrame, effects: DataFrame, receipts: DataFrame, reaped: DataFrame, sandboxes: DataFrame, history: bool = False,
) -> DataFrame:
    """Per task the evidence that its current attempt's cancellation was asked for, delivered, took the authority, and what it left; with history of all attempts.

    attempts (run_id, task_id, attempt_index, execution_id, state, dispatched, cancel_reason), commands
    (execution_id, delivered; cancel commands only), executions (execution_id, revision, attempt,
    fence, state, recovery_target_state), effects (execution_id, state), receipts (execution_id,
    receipt_id, cleanup_state, failed_phase), reaped (execution_id: cleanup that the supervisor has
    proved), sandboxes (execution_id, attempt, fence, cleanup_confirmed).

    Each fact is confirmed, pending, failed, unknown or not_applicable; a missing receipt is never
    evidence that nothing happened outside.  Sandboxes of another generation are an issue and no
    evidence; more than EFFECTS_SHOWN effects leave the external fact unknown.  Every source is
    summed per execution before it joins.
    """
    x = F.col
    if not history:
        last = F.max_by(F.struct("attempt_index", "execution_id", "state", "dispatched", "cancel_reason"), "attempt_index").alias("last")
        attempts = attempts.groupBy("run_id", "task_id").agg(last).select("run_id", "task_id", "last.*")
    seen = executions.select("execution_id", "revision", "attempt", "fence", x("state").alias("_state"), x("recovery_target_state").alias("_target"), F.lit(True).alias("_known"))
    asked = commands.groupBy("execution_id").agg(F.count("*").alias("_asked"), F.bool_and("delivered").alias("_delivered"))
    done = effects.groupBy("execution_id").agg(F.count("*").alias("_effects"), F.bool_or(x("state").isin(*UNSETTLED_EFFECTS)).alias("_unsettled"))
    proof = receipts.groupBy("execution_id").agg(
        F.count("*").alias("_receipts"), F.bool_or(x("cleanup_state") == "confirmed").alias("_cleaned"), F.min_by("cleanup_state", F.when(x("cleanup_state").isNotNull(), x("receipt_id"))).alias("_cleanup"),
        F.array_sort(F.collect_set("failed_phase")).alias("_failed"),
    )
    of_generation = sandboxes.join(executions.select("execution_id", x("attempt").alias("_a"), x("fence").alias("_f")), "execution_id").withColumn("_same", (x("attempt") == x("_a")) & (x("fence") == x("_f")))
    boxes = of_generation.groupBy("execution_id").agg(F.bool_or(~x("_same")).alias("_other"), F.bool_and(x("cleanup_confirmed") | ~x("_same")).alias("_boxes_clean"))
    j = attempts
    for part in (asked, seen, done, proof, reaped.select("execution_id", F.lit(True).alias("_reaped")).distinct(), boxes):
        j = j.join(part, "execution_id", "left")
    yes = lambda c: F.coalesce(x(c) if isinstance(c, str) else c, F.lit(False))
    known, intent, receipt = yes("_known"), x("_asked").isNotNull() | x("cancel_reason").isNotNull(), yes("_known") & x("_receipts").isNotNull()
    never = x("cancel_reason").isNotNull() & ~x("dispatched")
    committed = known & (yes(x("_state") == "cancelled") | yes(x("_target") == "cancelled"))
    failed = F.coalesce(x("_failed"), F.array().cast("array<string>"))
    j = j.withColumns({
        "request": F.when(committed | intent | receipt, "confirmed").otherwise("unknown"),
        "request_code": F.when(committed, "kernel_cancel_committed").when(intent, "application_cancel_intent").when(receipt, "runtime_request_persisted").otherwise("no_cancel_intent_observed"),
        "delivery": F.when(x("_delivered"), "confirmed").when(x("_asked").isNotNull(), "pending").when(never, "not_applicable").otherwise("unknown"),
        "authority": F.when(~known, "unknown").when(x("_state").isin(*TERMINAL, "recovery_required"), "confirmed").otherwise("pending"),
        "local": F.when(~known, F.when(never, "not_applicable").otherwise("unknown")).when(yes("_cleaned") | yes("_reaped") & ~yes(x("_cleanup") == "not_applicable"), "confirmed")
        .when(x("_cleanup").isNotNull(), x("_cleanup")).when(F.array_contains(failed, "process_cleanup"), "failed").otherwise("unknown"),
        "external": F.when(~known, "unknown").when(yes("_unsettled") | yes(x("_effects") > EFFECTS_SHOWN), "unknown").when(x("_effects").isNotNull(), "confirmed").otherwise("not_applicable"),
    })
    boxed = known & x("_other").isNotNull()
    local_open = x("local").isin("unknown", "failed")
    cleanup = F.when(~boxed, x("local")).when(x("_other"), "unknown").when(~x("_boxes_clean"), "pending").when(local_open, "unknown").otherwise("confirmed")
    issues = F.concat(F.transform(F.when(known, failed).otherwise(F.array().cast("array<string>")), lambda p: F.concat(F.lit("cancellation_phase_failed:"), p)), F.when(boxed & x("_other"), F.array(F.lit("sandbox_evidence_other_generation"))).otherwise(F.array().cast("array<string>")))
    return j.select(
        "run_id", "task_id", "attempt_index", "execution_id", "revision", "attempt", "fence", x("_state").alias("execution_state"), "state", F.when(x("state").isin(*TERMINAL), x("state")).alias("terminal"),
        "request", "request_code", "delivery", "authority", "local", "external", cleanup.alias("cleanup"), F.when(known, F.least(F.coalesce("_effects", F.lit(0)), F.lit(EFFECTS_SHOWN))).otherwise(0).cast("long").alias("effects"),
        yes(known & (x("_effects") > EFFECTS_SHOWN)).alias("effects_truncated"), F.when(known, F.coalesce("_receipts", F.lit(0))).otherwise(0).cast("long").alias("receipts"), issues.alias("issues"),
    )
