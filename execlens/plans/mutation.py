"""Queries: state transitions, mutation semantics as folds and what-ifs, integrity scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import checks, dedup, fold, graph, history, queues
from . import views as V
from .catalog import query
from .scans import NOW

# events as a transition log: a type stands for the state it leads to
def state_of_event():
    return F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "leased").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "succeeded").otherwise("failed")

STATE_SQL = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'leased' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END"
LOG_SQL = f"log AS (SELECT execution_id, sequence, {STATE_SQL} AS to_state, lag({STATE_SQL}) OVER w AS from_state, row_number() OVER w AS revision FROM ev WINDOW w AS (PARTITION BY execution_id ORDER BY sequence))"
# the legal edges once more, written out for the oracle (fixed values)
LEGAL_SQL = """('queued', 'leased'), ('queued', 'cancelled'), ('queued', 'dead'), ('queued', 'recovery_required'),
('leased', 'running'), ('leased', 'queued'), ('leased', 'cancelled'), ('leased', 'dead'), ('leased', 'recovery_required'),
('running', 'queued'), ('running', 'succeeded'), ('running', 'failed'), ('running', 'timed_out'), ('running', 'cancelled'), ('running', 'dead'), ('running', 'recovery_required'),
('recovery_required', 'queued'), ('recovery_required', 'cancelled')"""


def log(spark, d):
    w = Window.partitionBy("execution_id").orderBy("sequence")
    e = V.events(spark, d).withColumn("to_state", state_of_event())
    return e.select("execution_id", "sequence", "to_state", F.lag("to_state").over(w).alias("from_state"), F.row_number().over(w).cast("long").alias("revision"), F.col("sequence").alias("created_at"))


@query("dml01_illegal_transitions", f"WITH {LOG_SQL} SELECT from_state, to_state, count(*) AS n FROM log WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (VALUES {LEGAL_SQL}) GROUP BY ALL")
def _(spark, d):
    return checks.illegal_transitions(log(spark, d))


@query("dml02_replayed_runs")
def _(spark, d):
    kind = F.when(F.col("revision") == 0, "add_task").when(F.col("item_key") == "assistant", "result").when(F.col("revision") % 4 == 2, "new_attempt").otherwise("dispatch")
    state = F.when(F.col("item_key") == "assistant", F.when(F.col("revision") % 3 == 0, "failed").otherwise("succeeded"))
    data = F.to_json(F.struct(F.lit("t").alias("task_id"), state.alias("state")))
    ops = V.items(spark, d).select(F.col("run_id").cast("string").alias("run_id"), "revision", kind.alias("kind"), data.alias("data"))
    return fold.replay_operations(ops)


@query("dml03_upsert", "SELECT run_id, item_key, revision FROM (SELECT *, row_number() OVER (PARTITION BY run_id, item_key ORDER BY revision DESC) AS n FROM items) WHERE n = 1")
def _(spark, d):
    i = V.items(spark, d)
    old = i.where("revision <= 2").groupBy("run_id", "item_key").agg(F.max("revision").alias("revision"))
    return history.upsert(old, i.where("revision > 2").select("run_id", "item_key", "revision"), ["run_id", "item_key"], "revision")


@query("dml04_clock_upsert", "SELECT execution_id, CASE WHEN execution_id % 2 = 0 THEN greatest(max(sequence), 5000) ELSE max(sequence) END AS clock FROM ev GROUP BY 1")
def _(spark, d):
    observed = V.events(spark, d).select("execution_id", F.col("sequence").alias("clock"))
    clocks = observed.where("execution_id % 2 = 0").select("execution_id", F.lit(5000).cast("long").alias("clock")).distinct()
    return queues.clock_upsert(clocks, observed, "execution_id", "clock")


@query("dml05_revision_gaps", "SELECT run_id, revision FROM (SELECT *, lag(revision) OVER (PARTITION BY run_id ORDER BY revision) AS p FROM items WHERE (run_id + revision) % 9 <> 0) WHERE revision <> p + 1")
def _(spark, d):
    return checks.revision_gaps(V.items(spark, d).where("(run_id + revision) % 9 <> 0"), "run_id", "revision").select("run_id", "revision")


@query("dml06_submit_conflicts", "SELECT execution_id, count(DISTINCT part) AS contents FROM attempts WHERE attempt = 1 GROUP BY 1 HAVING count(DISTINCT part) > 1")
def _(spark, d):
    return dedup.conflicting(V.attempts(spark, d).where("attempt = 1"), "execution_id", "part")


@query("dml07_lease_grants", f"WITH {LOG_SQL} SELECT execution_id, sequence, count(*) OVER (PARTITION BY execution_id ORDER BY sequence) AS fence FROM log WHERE to_state = 'leased'")
def _(spark, d):
    return queues.lease_grants(log(spark, d), "execution_id", "sequence", F.col("to_state") == "leased").select("execution_id", "sequence", "fence")


@query("dml08_reap", f"SELECT execution_id, attempt, CASE WHEN attempt >= 5 THEN 'dead' ELSE 'queued' END AS next_state, CASE WHEN attempt < 5 THEN {NOW} + least(30.0, 2.0 * pow(2.0, attempt - 1)) END AS next_attempt_at FROM (SELECT execution_id, max(attempt) AS attempt, max(shipped) AS shipped FROM attempts GROUP BY 1) WHERE shipped <= {NOW}")
def _(spark, d):
    a = V.attempts(spark, d).groupBy("execution_id").agg(F.max("attempt").alias("attempt"), F.max("shipped").alias("lease_expires_at")).withColumn("state", F.lit("running"))
    return fold.reap(a, F.lit(NOW), 2, 2, 30, 5).select("execution_id", "attempt", "next_state", "next_attempt_at")


@query("dml09_retry_decision", "SELECT execution_id, attempt, CASE WHEN reason = 'R' AND attempt < 4 THEN 'retry' WHEN reason = 'R' THEN 'dead' ELSE 'done' END AS decision, count(*) AS n FROM attempts GROUP BY ALL")
def _(spark, d):
    made = queues.completion(F.col("reason") != "R", F.lit(True), F.col("attempt"), F.lit(4))
    return V.attempts(spark, d).groupBy("execution_id", "attempt", made.alias("decision")).agg(F.count("*").alias("n"))


@query("dml10_terminal_invariant", "SELECT execution_id, CASE WHEN state = 'F' AND r IS NULL THEN 'terminal without result' WHEN state <> 'F' AND r IS NOT NULL THEN 'result before the end' WHEN state = 'F' AND n IS NULL THEN 'terminal without outbox row' WHEN state <> 'F' AND n IS NOT NULL THEN 'outbox row before the end' END AS problem FROM (SELECT execution_id, state, CASE WHEN total > 1000 AND state = 'F' THEN 'x' END AS r FROM executions) LEFT JOIN (SELECT execution_id, count(*) AS n FROM attempts WHERE reason = 'A' GROUP BY 1) USING (execution_id) WHERE problem IS NOT NULL")
def _(spark, d):
    e = V.executions(spark, d).select("execution_id", "state", F.when((F.col("total") > 1000) & (F.col("state") == "F"), "x").alias("result_json"))
    return fold.terminal_mismatch(e, V.attempts(spark, d).where("reason = 'A'"), ["F"])


@query("dml11_cancellations", f"WITH {LOG_SQL} SELECT execution_id, min(sequence) FILTER (to_state = 'failed') AS cancelled_at, count(*) FILTER (to_state = 'running') AS runs FROM log GROUP BY 1")
def _(spark, d):
    return queues.cancellations(log(spark, d), "execution_id", "sequence", F.col("to_state") == "failed", F.col("to_state") == "running")


@query("dml12_queue_reap", "SELECT CASE WHEN attempt >= 6 THEN 'dead' ELSE 'pending' END AS state, count(*) AS n FROM attempts WHERE state = 'O' GROUP BY 1")
def _(spark, d):
    s = X.retry_state(F.col("attempt"), F.lit(6), "pending", "dead")
    return V.attempts(spark, d).where("state = 'O'").groupBy(s.alias("state")).agg(F.count("*").alias("n"))


@query("dml13_dead_letter_retry", "SELECT execution_id, CASE WHEN max(attempt) >= 7 THEN 'pending' ELSE 'kept' END AS state FROM attempts WHERE reason = 'R' GROUP BY 1")
def _(spark, d):
    return queues.retried_dead(V.attempts(spark, d).where("reason = 'R'"), "execution_id", F.col("attempt"), F.lit(7))


@query("dml14_scd2", "SELECT run_id, item_key, revision, lead(revision) OVER (PARTITION BY run_id ORDER BY revision) AS valid_to FROM (SELECT *, lag(item_key) OVER (PARTITION BY run_id ORDER BY revision) AS p FROM items) WHERE p IS DISTINCT FROM item_key")
def _(spark, d):
    return history.changed_versions(V.items(spark, d).select("run_id", "item_key", "revision"), ["run_id"], ["revision"], "item_key")


@query("dml15_retention_delete", "SELECT run_id, count(*) FILTER (revision > 2) AS kept, max(revision) FILTER (revision <= 2) AS expired_through FROM items GROUP BY 1")
def _(spark, d):
    i = V.items(spark, d)
    left, gone = queues.apply_deletions(i, i.where("revision <= 2"), "run_id", "revision")
    kept = left.groupBy("run_id").agg(F.count("*").alias("kept"))
    return i.select("run_id").distinct().join(kept, "run_id", "left").join(gone, "run_id", "left").select("run_id", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), "expired_through")


@query("dml16_open_effects", f"WITH {LOG_SQL} SELECT execution_id AS effect_id, arg_max(to_state, revision) AS state FROM log GROUP BY 1 HAVING arg_max(to_state, revision) IN ('leased', 'running')")
def _(spark, d):
    e = log(spark, d).withColumn("effect_id", F.col("execution_id"))
    return fold.open_effects(e, ["leased", "running"]).select("effect_id", "state")


@query("dml17_parked_executions", "SELECT DISTINCT e.execution_id FROM executions e JOIN attempts a USING (execution_id) WHERE e.state = 'F' AND a.state = 'O' AND a.reason = 'N'")
def _(spark, d):
    return queues.parked(V.executions(spark, d), V.attempts(spark, d), "execution_id", F.col("state") == "F", (F.col("state") == "O") & (F.col("reason") == "N")).select("execution_id")


@query("dml18_overdrawn", "SELECT execution_id, run_id FROM (SELECT *, sum(total) OVER (PARTITION BY run_id ORDER BY created_at, execution_id ROWS UNBOUNDED PRECEDING) AS spent FROM executions WHERE state = 'F') JOIN runs USING (run_id) WHERE spent > allowance * 100")
def _(spark, d):
    allowances = V.runs(spark, d).select("run_id", (F.col("allowance") * 100).alias("limit"))
    return queues.overdrawn(V.executions(spark, d).where("state = 'F'"), allowances, "run_id", ["created_at", "execution_id"], "total", "limit").select("execution_id", "run_id")


@query("dml19_projection_sync", f"WITH {LOG_SQL} SELECT execution_id, max(revision) AS revision, arg_max(to_state, revision) AS state FROM log GROUP BY 1")
def _(spark, d):
    return fold.fold_executions(log(spark, d)).select("execution_id", "revision", "state")


@query("dml20_continuations", "SELECT run_id AS previous, run_id * 2 + 1 AS next FROM runs WHERE run_id * 2 + 1 IN (SELECT run_id FROM runs)")
def _(spark, d):
    return queues.continuations(V.runs(spark, d), "run_id", F.col("run_id") * 2 + 1)


@query("dml21_control_intervals", "SELECT run_id, created_at, lead(created_at) OVER (PARTITION BY run_id ORDER BY created_at) AS valid_to FROM (SELECT DISTINCT run_id, created_at FROM executions)")
def _(spark, d):
    return history.intervals(V.executions(spark, d).select("run_id", "created_at").distinct(), ["run_id"], "created_at")


@query("chk01_row_invariants", "SELECT * FROM (SELECT 'amount over 45' AS rule, count(*) FILTER (NOT amount <= 45) AS n FROM attempts UNION ALL SELECT 'attempt under 7', count(*) FILTER (NOT attempt < 7) FROM attempts UNION ALL SELECT 'state known', count(*) FILTER (NOT state IN ('F', 'O')) FROM attempts) WHERE n > 0")
def _(spark, d):
    return checks.violations(V.attempts(spark, d), {"amount over 45": F.col("amount") <= 45, "attempt under 7": F.col("attempt") < 7, "state known": F.col("state").isin("F", "O")})


@query("chk02_keys_and_references", "SELECT 'duplicate' AS problem, count(*) AS n FROM (SELECT 1 FROM attempts GROUP BY execution_id, attempt HAVING count(*) > 1) UNION ALL SELECT 'orphan', count(*) FROM attempts WHERE execution_id NOT IN (SELECT execution_id FROM executions WHERE state <> 'P')")
def _(spark, d):
    a = V.attempts(spark, d)
    twice = checks.duplicate_keys(a, ["execution_id", "attempt"]).agg(F.count("*").alias("n")).select(F.lit("duplicate").alias("problem"), "n")
    lost = checks.orphans(a, "execution_id", V.executions(spark, d).where("state <> 'P'"), "execution_id").agg(F.count("*").alias("n")).select(F.lit("orphan").alias("problem"), "n")
    return twice.unionByName(lost)


# Graphs: a binary forest over executions, and a graph with cycles over nations
def tree(spark, d):
    return V.executions(spark, d).where("execution_id > 0").select(F.expr("execution_id div 2").alias("src"), F.col("execution_id").alias("dst"))


def rings(spark, d):
    n = V.read(spark, d, "nation").select(F.col("n_nationkey").alias("n"))
    return n.select(F.col("n").alias("src"), ((F.col("n") * 7 + 3) % 25).alias("dst")).unionByName(n.where("n % 4 = 0").select(F.col("n").alias("src"), ((F.col("n") + 9) % 25).alias("dst")))


TREE_SQL = "tree AS (SELECT execution_id // 2 AS src, execution_id AS dst FROM executions WHERE execution_id > 0)"
RINGS_SQL = "rings AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 9) % 25 FROM nation WHERE n_nationkey % 4 = 0)"
REACH_SQL = f"{RINGS_SQL}, reach(src, dst) AS (SELECT src, dst FROM rings UNION SELECT r.src, e.dst FROM reach r JOIN rings e ON e.src = r.dst)"


@query("gra01_dependency_cycle", f"WITH RECURSIVE {REACH_SQL} SELECT EXISTS (SELECT 1 FROM reach WHERE src = 5 AND dst = 3) AS closes_cycle", views=False)
def _(spark, d):
    return spark.range(1).select(F.lit(graph.reaches(rings(spark, d), 3, 5)).alias("closes_cycle"))


@query("gra02_acyclic", "SELECT true AS tree_acyclic, false AS rings_acyclic", views=False)
def _(spark, d):
    a, b = (graph.cyclic_nodes(g(spark, d)).isEmpty() for g in (tree, rings))
    return spark.range(1).select(F.lit(a).alias("tree_acyclic"), F.lit(b).alias("rings_acyclic"))


@query("gra03_strong_components", f"WITH RECURSIVE {REACH_SQL} SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1", views=False)
def _(spark, d):
    return graph.strong_components(rings(spark, d))


@query("gra04_forward_closure", "SELECT execution_id AS node FROM executions WHERE " + " OR ".join(f"execution_id // {1 << k} = 5" for k in range(0, 24)))
def _(spark, d):
    return graph.closure(tree(spark, d), spark.range(1).select(F.lit(5).cast("long").alias("node"))).select("node")


@query("gra05_revision_impact")
def _(spark, d):
    e = V.executions(spark, d)
    task = e.select(F.col("execution_id").alias("task_id"), F.col("state").alias("declaration"))
    new = task.where("task_id % 97 <> 0").withColumn("declaration", F.when(F.col("task_id") % 501 == 0, "X").otherwise(F.col("declaration")))
    changed = task.where("task_id = 1234").select("task_id")
    return graph.preview_impact(task, new, changed, tree(spark, d))


@query("gra06_wait_cycle", f"WITH RECURSIVE {REACH_SQL} SELECT count(DISTINCT dst) AS reached, bool_or(dst = 8) AS cyclic, count(DISTINCT dst) > 256 AS child_graph_limit FROM reach WHERE src = 8", views=False)
def _(spark, d):
    g = rings(spark, d)
    first = g.where("src = 8").select(F.col("dst").alias("node"))
    r = graph.closure(g, first)
    return r.agg(F.count("*").alias("reached"), F.bool_or(F.col("node") == 8).alias("cyclic"), (F.count("*") > 256).alias("child_graph_limit"))


@query("gra07_continuation_chain", "WITH RECURSIVE links AS (SELECT run_id AS p, run_id * 2 + 1 AS n FROM runs WHERE run_id * 2 + 1 IN (SELECT run_id FROM runs)), walk(start, direct, cur) AS (SELECT p, n, n FROM links UNION ALL SELECT w.start, w.direct, l.n FROM walk w JOIN links l ON l.p = w.cur) SELECT start, direct, max(cur) AS final, false AS cyclic FROM walk GROUP BY ALL")
def _(spark, d):
    r = V.runs(spark, d)
    return graph.chain_ends(queues.continuations(r, "run_id", F.col("run_id") * 2 + 1))


@query("gra08_content_garbage", "SELECT execution_id AS node FROM executions WHERE execution_id NOT IN (SELECT execution_id FROM executions WHERE execution_id = 0 OR " + " OR ".join(f"execution_id // {1 << k} IN (3, 4)" for k in range(0, 24)) + ")")
def _(spark, d):
    nodes = V.executions(spark, d).select(F.col("execution_id").alias("node"))
    roots = spark.range(1).select(F.explode(F.array(F.lit(0).cast("long"), F.lit(3).cast("long"), F.lit(4).cast("long"))).alias("node"))
    return graph.unreachable(nodes, tree(spark, d).where("src > 0"), roots)


@query("gra09_ancestor_depth", "SELECT execution_id AS node, CAST(CASE WHEN execution_id = 0 THEN 0 ELSE floor(log2(execution_id)) + 1 END AS BIGINT) AS depth FROM executions")
def _(spark, d):
    p = V.executions(spark, d).select(F.col("execution_id").alias("node"), F.when(F.col("execution_id") > 0, F.expr("execution_id div 2")).alias("parent"))
    return graph.depths(p)


@query("gra10_provenance_degree", "SELECT worker, count(DISTINCT execution_id) AS refs FROM attempts GROUP BY 1")
def _(spark, d):
    return V.attempts(spark, d).select("worker", "execution_id").distinct().groupBy("worker").agg(F.count("*").alias("refs"))


@query("gra11_readiness", f"WITH {TREE_SQL} SELECT dst AS task_id, bool_and(coalesce(s.state = 'F', false)) AS ready FROM tree LEFT JOIN executions s ON s.execution_id = src GROUP BY 1")
def _(spark, d):
    t = tree(spark, d).select(F.col("dst").alias("task_id"), F.col("src").alias("dependency"))
    return graph.ready(t, V.executions(spark, d).select(F.col("execution_id").alias("task_id"), "state"), ["F"])


@query("sort09_topological")
def _(spark, d):
    e = V.executions(spark, d)
    up = e.select(F.col("run_id"), F.col("execution_id").alias("dep"))
    j = e.alias("a").join(up.alias("b"), (F.col("a.run_id") == F.col("b.run_id")) & (F.col("b.dep") == F.expr("a.execution_id div 2")) & (F.col("a.execution_id") > 0), "left")
    t = j.select(F.col("a.run_id").cast("string").alias("run_id"), F.col("a.execution_id").cast("string").alias("task_id"), F.array(F.col("b.dep").cast("string")).alias("dependencies"))
    return graph.topological(t)
