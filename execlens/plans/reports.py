"""Composite read-only reports over record tables, and their queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggs, paging, reports
from . import views as V
from .catalog import query
from .scans import NOW


def health(executions: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    """One row: counts by state, due and expired work, queue backlog."""
    s, at = F.col("state"), F.col("created_at")
    a = executions.agg(*aggs.count_where(queued=s == "O", running=s == "P", finished=s == "F", due=(s == "O") & (at <= now)))
    b = queue.agg(*aggs.count_where(undelivered=F.col("reason") == "N", dead=F.col("reason") == "R"))
    return a.select("*", *[b.select(c).scalar().alias(c) for c in ("undelivered", "dead")])


@query("rpt01_store_health", f"SELECT * FROM (SELECT count(*) FILTER (state = 'O') AS queued, count(*) FILTER (state = 'P') AS running, count(*) FILTER (state = 'F') AS finished, count(*) FILTER (state = 'O' AND created_at <= {NOW}) AS due FROM executions), (SELECT count(*) FILTER (reason = 'N') AS undelivered, count(*) FILTER (reason = 'R') AS dead FROM attempts)")
def _(spark, d):
    return health(V.executions(spark, d), V.attempts(spark, d), F.lit(NOW))


# the reports' states: O waits for its time, P is leased, F is done; some rows are rare states
STATE_OF = "CASE WHEN execution_id % 41 = 0 THEN 'recovery_required' WHEN state = 'O' THEN 'queued' WHEN state = 'P' THEN 'leased' WHEN execution_id % 10 = 0 THEN 'timed_out' ELSE 'succeeded' END"
KERNEL_SQL = f"kernel AS (SELECT execution_id, {STATE_OF} AS state, revision AS registry_revision, created_at AS next_attempt_at, created_at + 30 AS lease_expires_at FROM executions WHERE execution_id % 11 <> 0)"


def kernel(spark, d):
    """What the execution log knows: most registered executions, not all."""
    return V.executions(spark, d).where("execution_id % 11 <> 0").selectExpr("execution_id", f"{STATE_OF} AS state", "revision AS registry_revision", "created_at AS next_attempt_at", "created_at + 30 AS lease_expires_at")


def open_waits(spark, d):
    return V.items(spark, d).select("run_id", F.when(F.col("revision") % 2 == 0, "open").otherwise("released").alias("state"))


WAITS_SQL = "waits AS (SELECT run_id, count(*) FILTER (revision % 2 = 0) AS open_waits FROM items GROUP BY 1)"


@query("rpt02_run_diagnostics", f"""WITH {KERNEL_SQL}, {WAITS_SQL},
tasks AS (SELECT run_id, execution_id AS task_id, execution_id, lag(execution_id) OVER (PARTITION BY run_id ORDER BY execution_id) AS need FROM executions),
j AS (SELECT t.run_id, t.task_id, t.execution_id, k.state, k.next_attempt_at, k.lease_expires_at, k.execution_id IS NOT NULL AS known, need IS NOT NULL AND coalesce(n.state NOT IN ('succeeded', 'failed', 'timed_out', 'cancelled', 'dead'), true) AS unmet,
  row_number() OVER (PARTITION BY t.run_id ORDER BY t.task_id) AS rank FROM tasks t LEFT JOIN kernel k ON k.execution_id = t.execution_id LEFT JOIN kernel n ON n.execution_id = t.need),
n AS (SELECT run_id, count(*) AS n, count(*) FILTER (state IN ('succeeded', 'failed', 'timed_out', 'cancelled', 'dead')) AS settled FROM j GROUP BY 1)
SELECT run_id, CAST(rank AS INTEGER) AS rank, task_id, execution_id, state, CAST(unmet AS BIGINT) AS unmet,
CASE WHEN NOT known THEN 'execution_not_observed' WHEN state IN ('succeeded', 'failed', 'timed_out', 'cancelled', 'dead') THEN NULL WHEN unmet THEN 'dependencies' WHEN state = 'recovery_required' THEN 'recovery_required'
  WHEN state = 'queued' AND next_attempt_at > {NOW} THEN 'retry_backoff' WHEN state IN ('leased', 'running') AND lease_expires_at <= {NOW} THEN 'expired_lease' WHEN state IN ('leased', 'running') THEN 'running' WHEN state = 'queued' THEN 'claimable' END AS blocker,
CASE WHEN n <= 15 THEN n END AS tasks, CAST(least(n, 15) AS BIGINT) AS tasks_at_least, settled, coalesce(open_waits, 0) AS open_waits, n > 10 AS has_more
FROM j JOIN n USING (run_id) LEFT JOIN waits USING (run_id) WHERE rank <= 10""")
def _(spark, d):
    from pyspark.sql import Window

    before = F.lag("execution_id").over(Window.partitionBy("run_id").orderBy("execution_id"))
    tasks = V.executions(spark, d).select("run_id", F.col("execution_id").alias("task_id"), "execution_id", F.array_compact(F.array(before)).alias("dependencies"))
    return reports.run_diagnostics(tasks, kernel(spark, d), open_waits(spark, d), F.lit(NOW), task_limit=10, count_limit=15)


@query("rpt03_cancellation_evidence", f"""WITH {KERNEL_SQL},
t AS (SELECT run_id, execution_id // 2 AS task_id, execution_id AS attempt_index, execution_id, CASE WHEN state = 'F' THEN 'cancelled' ELSE 'running' END AS state, revision <> '5-LOW' AS dispatched, execution_id % 5 = 0 AS cancels FROM executions
  QUALIFY row_number() OVER (PARTITION BY run_id, execution_id // 2 ORDER BY execution_id DESC) = 1),
k AS (SELECT execution_id, registry_revision, state, CASE WHEN state = 'recovery_required' AND execution_id % 2 = 0 THEN 'cancelled' END AS target FROM kernel),
c AS (SELECT execution_id, bool_and(state = 'F') AS delivered FROM attempts WHERE attempt = 1 AND reason <> 'A' GROUP BY 1),
f AS (SELECT execution_id, count(*) AS n, bool_or(reason = 'R') AS unsettled FROM attempts WHERE attempt >= 5 GROUP BY 1),
r AS (SELECT execution_id, count(*) AS n, bool_or(reason = 'N') AS cleaned, arg_min(CASE reason WHEN 'N' THEN 'confirmed' WHEN 'A' THEN 'pending' END, CASE WHEN reason <> 'R' THEN attempt END) AS cleanup,
  coalesce(list_sort(list(DISTINCT CASE WHEN amount % 2 = 0 THEN 'process_cleanup' ELSE 'provider_cancel' END) FILTER (reason = 'R')), []) AS failed FROM attempts WHERE attempt IN (2, 3) GROUP BY 1),
p AS (SELECT DISTINCT execution_id FROM attempts WHERE attempt = 3 AND amount % 3 = 0),
b AS (SELECT execution_id, bool_or(amount % 4 <> 1) AS other, bool_and(attempts.state = 'F' OR amount % 4 <> 1) AS clean FROM attempts JOIN kernel USING (execution_id) WHERE attempt = 4 AND amount % 4 < 3 GROUP BY 1),
j AS (SELECT t.*, k.registry_revision AS revision, k.state AS execution_state, k.execution_id IS NOT NULL AS known, coalesce(k.target = 'cancelled', false) AS committed, c.execution_id IS NOT NULL AS asked, c.delivered, f.n AS effects, coalesce(unsettled, false) AS unsettled,
  r.n AS receipts, coalesce(cleaned, false) AS cleaned, cleanup, coalesce(failed, []) AS failed, p.execution_id IS NOT NULL AS reaped, other, clean
  FROM t LEFT JOIN k USING (execution_id) LEFT JOIN c USING (execution_id) LEFT JOIN f USING (execution_id) LEFT JOIN r USING (execution_id) LEFT JOIN p USING (execution_id) LEFT JOIN b USING (execution_id)),
l AS (SELECT *, CASE WHEN NOT known AND cancels AND NOT dispatched THEN 'not_applicable' WHEN NOT known THEN 'unknown' WHEN cleaned OR reaped THEN 'confirmed' WHEN cleanup IS NOT NULL THEN cleanup WHEN list_contains(failed, 'process_cleanup') THEN 'failed' ELSE 'unknown' END AS local FROM j)
SELECT run_id, task_id, attempt_index, execution_id, revision, CASE WHEN known THEN CAST(4 AS BIGINT) END AS attempt, CASE WHEN known THEN CAST(1 AS BIGINT) END AS fence, execution_state, state, CASE WHEN state = 'cancelled' THEN state END AS terminal,
CASE WHEN committed OR asked OR cancels OR (known AND receipts > 0) THEN 'confirmed' ELSE 'unknown' END AS request,
CASE WHEN committed THEN 'kernel_cancel_committed' WHEN asked OR cancels THEN 'application_cancel_intent' WHEN known AND receipts > 0 THEN 'runtime_request_persisted' ELSE 'no_cancel_intent_observed' END AS request_code,
CASE WHEN asked AND delivered THEN 'confirmed' WHEN asked THEN 'pending' WHEN cancels AND NOT dispatched THEN 'not_applicable' ELSE 'unknown' END AS delivery,
CASE WHEN NOT known THEN 'unknown' WHEN execution_state IN ('queued', 'leased', 'running') THEN 'pending' ELSE 'confirmed' END AS authority, local,
CASE WHEN NOT known OR unsettled THEN 'unknown' WHEN effects > 0 THEN 'confirmed' ELSE 'not_applicable' END AS external,
CASE WHEN NOT known OR other IS NULL THEN local WHEN other THEN 'unknown' WHEN NOT clean THEN 'pending' WHEN local IN ('unknown', 'failed') THEN 'unknown' ELSE 'confirmed' END AS cleanup,
CASE WHEN known THEN coalesce(effects, 0) ELSE 0 END AS effects, false AS effects_truncated, CASE WHEN known THEN coalesce(receipts, 0) ELSE 0 END AS receipts,
concat_ws(',', CASE WHEN known AND len(failed) > 0 THEN 'cancellation_phase_failed:' || array_to_string(failed, ',cancellation_phase_failed:') END, CASE WHEN known AND other THEN 'sandbox_evidence_other_generation' END) AS issues FROM l""")
def _(spark, d):
    a = V.attempts(spark, d)
    amount, reason = F.col("amount"), F.col("reason")
    tasks = V.executions(spark, d).select(
        "run_id", F.expr("execution_id DIV 2").alias("task_id"), F.col("execution_id").alias("attempt_index"), "execution_id", F.when(F.col("state") == "F", "cancelled").otherwise("running").alias("state"),
        (F.col("revision") != "5-LOW").alias("dispatched"), F.when(F.col("execution_id") % 5 == 0, "asked").alias("cancel_reason"),
    )
    target = F.when((F.col("state") == "recovery_required") & (F.col("execution_id") % 2 == 0), "cancelled")
    known = kernel(spark, d).select("execution_id", F.col("registry_revision").alias("revision"), F.lit(4).cast("long").alias("attempt"), F.lit(1).cast("long").alias("fence"), "state", target.alias("recovery_target_state"))
    commands = a.where("attempt = 1 AND reason <> 'A'").select("execution_id", (F.col("state") == "F").alias("delivered"))
    effects = a.where("attempt >= 5").select("execution_id", F.when(reason == "R", "indeterminate").otherwise("committed").alias("state"))
    phase = F.when(reason == "R", F.when(amount % 2 == 0, "process_cleanup").otherwise("provider_cancel"))
    receipts = a.where("attempt IN (2, 3)").select("execution_id", F.col("attempt").alias("receipt_id"), F.when(reason == "N", "confirmed").when(reason == "A", "pending").alias("cleanup_state"), phase.alias("failed_phase"))
    boxes = a.where("attempt = 4 AND amount % 4 < 3").select("execution_id", "attempt", (amount % 4).alias("fence"), (F.col("state") == "F").alias("cleanup_confirmed"))
    got = reports.cancellation_evidence(tasks, commands, known, effects, receipts, a.where("attempt = 3 AND amount % 3 = 0"), boxes)
    return got.withColumn("issues", F.array_join("issues", ","))


@query("rpt04_execution_origin", "SELECT x.id AS execution_id, e.run_id, r.kind, CASE WHEN e.execution_id IS NULL THEN 'unknown_execution' WHEN r.run_id IS NULL THEN 'unknown_run' ELSE 'found' END AS reason FROM (SELECT DISTINCT sequence * 7 AS id FROM ev) x LEFT JOIN executions e ON e.execution_id = x.id LEFT JOIN (SELECT * FROM runs WHERE owner < 15) r USING (run_id)")
def _(spark, d):
    x = V.events(spark, d).select((F.col("sequence") * 7).alias("execution_id")).distinct()
    e = V.executions(spark, d).select("execution_id", "run_id", F.lit(True).alias("_e"))
    r = V.runs(spark, d).where("owner < 15").select("run_id", "kind")
    j = x.join(e, "execution_id", "left").join(r, "run_id", "left")
    reason = F.when(F.col("_e").isNull(), "unknown_execution").when(F.col("kind").isNull(), "unknown_run").otherwise("found")
    return j.select("execution_id", "run_id", "kind", reason.alias("reason"))


@query("rpt05_storage_preflight", "SELECT 'attempts' AS name, count(*) AS n, count(*) FILTER (amount IS NULL OR amount < 1) AS broken FROM attempts UNION ALL SELECT 'executions', count(*), count(*) FILTER (state NOT IN ('F', 'O', 'P')) FROM executions")
def _(spark, d):
    a = V.attempts(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("amount").isNull() | (F.col("amount") < 1)).alias("broken")).withColumn("name", F.lit("attempts"))
    e = V.executions(spark, d).agg(F.count("*").alias("n"), F.count_if(~F.col("state").isin("F", "O", "P")).alias("broken")).withColumn("name", F.lit("executions"))
    return a.unionByName(e).select("name", "n", "broken")


@query("rpt06_storage_usage", "SELECT lang AS category, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1", views=False)
def _(spark, d):
    return V.read(spark, d, "documents").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


RETENTION = """SELECT run_id, revision, concat_ws(',', CASE WHEN baseline THEN 'baseline' END, CASE WHEN newest <= 2 THEN 'last_n' END, CASE WHEN pinned THEN 'receipt' END) AS reasons
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY revision DESC) AS newest, revision = max(revision) FILTER (revision <= 1) OVER (PARTITION BY run_id, item_key) AS baseline, revision % 5 = 3 AS pinned FROM items)"""


@query("rpt07_retention_plan", f"SELECT run_id, revision, CASE WHEN reasons = '' THEN 'delete' ELSE 'keep' END AS action, reasons FROM ({RETENTION})")
def _(spark, d):
    from pyspark.sql import Window

    i = V.items(spark, d)
    newest = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("revision").desc()))
    base = F.max(F.when(F.col("revision") <= 1, F.col("revision"))).over(Window.partitionBy("run_id", "item_key"))
    i = i.withColumns({"newest": newest, "base": base})
    why = aggs.reason_codes(baseline=F.coalesce(F.col("revision") == F.col("base"), F.lit(False)), last_n=F.col("newest") <= 2, receipt=F.col("revision") % 5 == 3)
    return i.select("run_id", "revision", F.when(F.size(why) == 0, "delete").otherwise("keep").alias("action"), F.array_join(why, ",").alias("reasons"))


@query("rpt08_disposal_plan", "SELECT run_id, count(*) FILTER (state = 'P') AS running, count(*) FILTER (state = 'O') AS queued, count(*) FILTER (state <> 'F') = 0 AS disposable FROM executions GROUP BY 1")
def _(spark, d):
    s = F.col("state")
    return V.executions(spark, d).groupBy("run_id").agg(*aggs.count_where(running=s == "P", queued=s == "O"), (F.count_if(s != "F") == 0).alias("disposable"))


CLAIMED = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@query("rpt09_work_availability", f"""WITH {KERNEL_SQL}, {WAITS_SQL},
k AS (SELECT e.run_id, e.execution_id, k.* EXCLUDE (execution_id), k.execution_id IS NULL AS missing FROM executions e LEFT JOIN kernel k USING (execution_id)),
c AS (SELECT run_id, count(*) FILTER (state = 'queued' AND next_attempt_at <= {NOW}) AS queued_ready, count(*) FILTER (state = 'queued' AND next_attempt_at <= {NOW} AND registry_revision IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS claimable_now,
  count(*) FILTER (state IN ('leased', 'running') AND lease_expires_at > {NOW}) AS active_leases, count(*) FILTER (state IN ('leased', 'running') AND lease_expires_at <= {NOW}) AS expired_leases,
  count(*) FILTER (state = 'queued' AND next_attempt_at > {NOW}) AS retry_backoff, count(*) FILTER (state = 'recovery_required') AS recovery_required,
  count(*) FILTER (state IN ('succeeded', 'failed', 'timed_out', 'cancelled', 'dead')) AS to_sync, count(*) FILTER (missing) AS missing,
  min(next_attempt_at) FILTER (state = 'queued' AND next_attempt_at > {NOW}) AS next_retry, min(lease_expires_at) FILTER (state IN ('leased', 'running') AND lease_expires_at > {NOW}) AS next_expiry FROM k GROUP BY 1),
o AS (SELECT execution_id AS run_id, count(*) FILTER (event_type <> 'purchase') AS pending_commands FROM ev GROUP BY 1),
r AS (SELECT run_id, count(*) FILTER (reason <> 'N') AS pending_delivery FROM executions JOIN attempts USING (execution_id) WHERE attempt = 1 GROUP BY 1),
x AS (SELECT count(*) <= 1000 AS ok FROM attempts WHERE attempt = 7),
f AS (SELECT run_id, count(*) AS unknown_effects FROM executions JOIN attempts USING (execution_id) WHERE attempt = 7 AND reason = 'R' GROUP BY 1),
t AS (SELECT run_id, count(*) AS tasks FROM items GROUP BY 1),
a AS (SELECT runs.run_id, CASE WHEN runs.run_id % 17 = 0 THEN 'succeeded' ELSE 'running' END AS state, coalesce(queued_ready, 0) AS queued_ready, coalesce(claimable_now, 0) AS claimable_now, coalesce(active_leases, 0) AS active_leases, coalesce(expired_leases, 0) AS expired_leases,
  coalesce(retry_backoff, 0) AS retry_backoff, coalesce(recovery_required, 0) AS recovery_required, coalesce(to_sync, 0) AS to_sync, coalesce(missing, 0) AS missing, coalesce(pending_commands, 0) AS pending_commands, coalesce(pending_delivery, 0) AS pending_delivery,
  CASE WHEN ok THEN coalesce(unknown_effects, 0) END AS unknown_effects, coalesce(tasks, 0) AS tasks, coalesce(open_waits, 0) AS open_waits, next_retry, least(next_retry, next_expiry) AS next_hint, ok
  FROM runs LEFT JOIN c USING (run_id) LEFT JOIN o USING (run_id) LEFT JOIN r USING (run_id) LEFT JOIN f USING (run_id) LEFT JOIN t USING (run_id) LEFT JOIN waits USING (run_id) CROSS JOIN x)
SELECT run_id, state, queued_ready, claimable_now, active_leases, expired_leases, retry_backoff, recovery_required, missing, pending_commands, pending_delivery, unknown_effects, tasks, open_waits, CASE WHEN missing = 0 THEN to_sync END AS pending_sync, next_retry, next_hint,
concat_ws(',', CASE WHEN state = 'succeeded' THEN 'terminal_run' END, CASE WHEN tasks = 0 THEN 'no_tasks' END, CASE WHEN claimable_now > 0 THEN 'claimable_now' END, CASE WHEN queued_ready > claimable_now THEN 'binding_mismatch' END, CASE WHEN active_leases > 0 THEN 'active_leases' END,
  CASE WHEN expired_leases > 0 THEN 'expired_leases_pending_reap' END, CASE WHEN retry_backoff > 0 THEN 'retry_backoff' END, CASE WHEN pending_commands > 0 THEN 'pending_commands' END, CASE WHEN to_sync > 0 THEN 'pending_result_sync' END, CASE WHEN pending_delivery > 0 THEN 'pending_result_delivery' END,
  CASE WHEN open_waits > 0 THEN 'application_wait' END, CASE WHEN recovery_required > 0 THEN 'recovery_required' END, CASE WHEN unknown_effects > 0 THEN 'unknown_effects' END, CASE WHEN missing > 0 THEN 'execution_not_observed' END, CASE WHEN NOT ok THEN 'effect_scan_limit_exceeded' END) AS reasons, ok AND missing = 0 AS complete FROM a""")
def _(spark, d):
    e, a, items = V.executions(spark, d), V.attempts(spark, d), V.items(spark, d)
    runs = V.runs(spark, d).select("run_id", F.when(F.col("run_id") % 17 == 0, "succeeded").otherwise("running").alias("state"))
    commands = V.events(spark, d).select(F.col("execution_id").alias("run_id"), (F.col("event_type") == "purchase").alias("delivered"))
    results = a.where("attempt = 1").select("execution_id", F.when(F.col("reason") == "N", "delivered").otherwise("pending").alias("state"))
    effects = a.where("attempt = 7").select("execution_id", F.when(F.col("reason") == "R", "indeterminate").otherwise("committed").alias("state"))
    got = reports.work_availability(runs, e, kernel(spark, d), commands, results, effects, items.select("run_id"), open_waits(spark, d), F.lit(NOW), CLAIMED)
    return got.withColumn("reasons", F.array_join("reasons", ","))


@query("rpt10_execution_observation", "SELECT execution_id, event_type, count(*) AS count, min(sequence) AS first_at, max(sequence) AS last_at, CASE WHEN max(sequence) >= 9000 THEN 'observed' ELSE 'unknown' END AS seen FROM ev GROUP BY ALL")
def _(spark, d):
    g = V.events(spark, d).groupBy("execution_id", "event_type").agg(F.count("*").alias("count"), F.min("sequence").alias("first_at"), F.max("sequence").alias("last_at"))
    return g.withColumn("seen", F.when(F.col("last_at") >= 9000, "observed").otherwise("unknown"))


@query("rpt11_legacy_page", "SELECT e.execution_id, e.created_at, a.attempt FROM (SELECT execution_id, created_at FROM executions WHERE (created_at, execution_id) > (9500, 100) ORDER BY created_at, execution_id LIMIT 50) e LEFT JOIN (SELECT execution_id, max(attempt) AS attempt FROM attempts GROUP BY 1) a USING (execution_id)")
def _(spark, d):
    e = paging.keyset_page(V.executions(spark, d).select("created_at", "execution_id"), ["created_at", "execution_id"], [F.lit(9500).cast("long"), F.lit(100).cast("long")], 50)
    return e.join(V.attempts(spark, d).groupBy("execution_id").agg(F.max("attempt").alias("attempt")), "execution_id", "left").select("execution_id", "created_at", "attempt")


@query("rpt12_cleanup_scan", "SELECT execution_id, arg_max(event_type, sequence) AS phase, max(sequence) AS sequence FROM ev WHERE event_type IN ('view', 'click') GROUP BY 1")
def _(spark, d):
    return V.events(spark, d).where(F.col("event_type").isin("view", "click")).groupBy("execution_id").agg(F.max_by("event_type", "sequence").alias("phase"), F.max("sequence").alias("sequence"))


@query("rpt13_pending_recoveries", "SELECT execution_id, run_id FROM executions WHERE state = 'P' ORDER BY created_at, execution_id LIMIT 50")
def _(spark, d):
    return V.executions(spark, d).where("state = 'P'").orderBy("created_at", "execution_id").limit(50).select("execution_id", "run_id")


@query("rpt14_stall_status", "SELECT e.execution_id, count(*) AS stalls, r.kind FROM ev e JOIN runs r ON r.run_id = e.execution_id WHERE e.value < 5 GROUP BY ALL")
def _(spark, d):
    e = V.events(spark, d).where("value < 5").groupBy("execution_id").agg(F.count("*").alias("stalls"))
    return e.join(V.runs(spark, d).select(F.col("run_id").alias("execution_id"), "kind"), "execution_id")


@query("rpt15_identity_verdicts", "SELECT revision, bool_and(state IN ('F', 'O', 'P')) AS compatible, count(DISTINCT state) AS states FROM executions GROUP BY 1")
def _(spark, d):
    return V.executions(spark, d).groupBy("revision").agg(F.bool_and(F.col("state").isin("F", "O", "P")).alias("compatible"), F.count_distinct("state").alias("states"))
