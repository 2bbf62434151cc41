"""Queries: the batch forms of the stream operators, and bounded drains of a log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggs, graph, history, joins, queues
from ..streaming import operators as S
from . import views as V
from .catalog import query
from .scans import NOW


@query("str01_logical_clock", "SELECT sequence, max(value) OVER (PARTITION BY execution_id ORDER BY sequence) AS logical_at FROM ev")
def _(spark, d):
    return history.monotone_clock(V.events(spark, d), "sequence", "value", ["execution_id"]).select("sequence", "logical_at")


@query("str02_stale_cursors", "SELECT run_id, CAST(c AS BIGINT) AS cursor, c < expired AS stale FROM (SELECT run_id, min(revision) + 1 AS expired, run_id % 4 AS c FROM items GROUP BY run_id)")
def _(spark, d):
    w = V.items(spark, d).groupBy("run_id").agg((F.min("revision") + 1).alias("expired_through"), F.max("revision").alias("high_water"))
    return S.lag(w, w.select("run_id", (F.col("run_id") % 4).alias("cursor")), "run_id").select("run_id", "cursor", "stale")


@query("str03_subscription_cursors", "SELECT run_id, greatest(max(revision) FILTER (revision <= 4), run_id % 7) AS cursor FROM items GROUP BY 1")
def _(spark, d):
    i = V.items(spark, d)
    cursors = i.select("run_id", (F.col("run_id") % 7).alias("cursor")).distinct()
    return queues.acknowledged(cursors, i.where("revision <= 4").select("run_id", F.col("revision").alias("cursor")), "run_id", "cursor")


@query("str04_drained_projection", "SELECT event_type, count(*) AS n, CAST(sum(sequence) AS BIGINT) AS checksum FROM ev GROUP BY 1")
def _(spark, d):
    """Drains the log through a stream into a keyed sink and reads that back."""
    base = graph.written(V.events(spark, d).select("sequence", "execution_id", "event_type"))
    path = base.inputFiles()[0].rsplit("/", 1)[0]
    out = f"{path}-drained"
    S.drain(S.log_stream(spark, path, base.schema), S.keyed_sink(out, ["sequence"]), f"{path}-cursor")
    return S.delivered(spark, out, ["sequence"]).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("sequence").alias("checksum"))


@query("str05_subscriber_lag", "SELECT run_id, max(revision) - min(revision) AS lag FROM items GROUP BY 1")
def _(spark, d):
    w = V.items(spark, d).groupBy("run_id").agg(F.max("revision").alias("high_water"), F.min("revision").alias("cursor"), F.min("revision").alias("expired_through"))
    return S.lag(w.select("run_id", "high_water", "expired_through"), w.select("run_id", "cursor"), "run_id").select("run_id", "lag")


@query("str06_stall_windows")
def _(spark, d):
    e = V.events(spark, d).select("execution_id", F.col("sequence").cast("double").alias("at"), (F.col("value") > 200).cast("int").alias("moved"), F.when(F.col("event_type") != "error", 1).alias("known"))
    w = Window.partitionBy("execution_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    s = e.select("execution_id", "at", F.when(F.col("known") == 1, F.sum("moved").over(w)).alias("progress"), F.lit(0).cast("long").alias("activity"))
    return S.stall_batch(s, 50.0, 3, 400.0)


@query("str07_episodes", "SELECT execution_id, min(sequence) AS started_at, CASE WHEN count(*) = count(nxt) THEN max(nxt) END AS ended_at, count(*) AS windows FROM (SELECT *, sum(CASE WHEN value < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY execution_id ORDER BY sequence) AS island, lead(sequence) OVER (PARTITION BY execution_id ORDER BY sequence) AS nxt FROM ev) WHERE value < 60 GROUP BY execution_id, island HAVING count(*) >= 3")
def _(spark, d):
    e = history.episodes(V.events(spark, d).select("execution_id", "sequence", "value"), ["execution_id"], "sequence", F.col("value") < 60, 3)
    return e.select("execution_id", "started_at", "ended_at", F.col("windows").cast("long").alias("windows"))


@query("str08_sequence_dedup", "SELECT execution_id, event_type, max(sequence) AS sequence, arg_max(value, sequence) AS value FROM ev GROUP BY ALL")
def _(spark, d):
    return joins.latest(V.events(spark, d).select("execution_id", "event_type", "sequence", "value"), ["execution_id", "event_type"], ["sequence"])


@query("str09_incarnations", "SELECT execution_id, max(attempt) AS incarnation, CAST(sum(amount) AS BIGINT) AS total FROM (SELECT execution_id, attempt, max(amount) AS amount FROM attempts GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    return queues.incarnations(V.attempts(spark, d), ["execution_id"], "attempt", "amount")


@query("str10_late_rows", "SELECT execution_id, count(*) FILTER (attempt < m) AS late, count(*) FILTER (attempt = m) AS current FROM (SELECT *, max(attempt) OVER (PARTITION BY execution_id) AS m FROM attempts) GROUP BY 1")
def _(spark, d):
    a = V.attempts(spark, d)
    m = a.groupBy("execution_id").agg(F.max("attempt").alias("m"))
    return a.join(m, "execution_id").groupBy("execution_id").agg(*aggs.count_where(late=F.col("attempt") < F.col("m"), current=F.col("attempt") == F.col("m")))


@query("str11_capture_gaps", "SELECT execution_id, CAST(sum(gap) AS BIGINT) AS gaps FROM (SELECT execution_id, sequence - lag(sequence) OVER (PARTITION BY execution_id ORDER BY sequence) - 1 AS gap FROM ev) WHERE gap > 100 GROUP BY 1")
def _(spark, d):
    e = history.deltas(V.events(spark, d), ["execution_id"], ["sequence"], "sequence").withColumn("gap", F.col("delta") - 1)
    return e.where("gap > 100").groupBy("execution_id").agg(F.sum("gap").alias("gaps"))


@query("str12_expired_leases", f"SELECT execution_id, max(shipped) AS lease_expires_at FROM attempts GROUP BY 1 HAVING max(shipped) <= {NOW}")
def _(spark, d):
    return queues.expired(V.attempts(spark, d), "execution_id", "shipped", F.lit(NOW))


@query("str13_dead_letters", "SELECT execution_id, count(*) AS tries FROM attempts WHERE reason = 'R' GROUP BY 1 HAVING count(*) >= 3")
def _(spark, d):
    return queues.dead_letters(V.attempts(spark, d).where("reason = 'R'"), "execution_id", 3)


@query("str14_result_receipts", "SELECT e.execution_id, d.execution_id IS NOT NULL AS delivered, c.execution_id IS NOT NULL AS confirmed FROM executions e LEFT JOIN (SELECT DISTINCT execution_id FROM attempts WHERE reason = 'A') d USING (execution_id) LEFT JOIN (SELECT DISTINCT execution_id FROM attempts WHERE reason = 'N') c USING (execution_id) WHERE e.state = 'F'")
def _(spark, d):
    a = V.attempts(spark, d)
    return queues.receipts(V.executions(spark, d).where("state = 'F'"), "execution_id", delivered=a.where("reason = 'A'"), confirmed=a.where("reason = 'N'"))


@query("str15_two_hop_latency", "SELECT execution_id, min(shipped) - created_at AS latency FROM executions JOIN attempts USING (execution_id) GROUP BY execution_id, created_at")
def _(spark, d):
    return queues.two_hop_latency(V.executions(spark, d), V.attempts(spark, d), "execution_id", "created_at", "shipped")


@query("str16_open_obligations", "SELECT execution_id FROM executions WHERE state = 'P' AND execution_id NOT IN (SELECT execution_id FROM attempts WHERE reason = 'A')")
def _(spark, d):
    return joins.absent(V.executions(spark, d).where("state = 'P'").select("execution_id"), V.attempts(spark, d).where("reason = 'A'"), ["execution_id"])


@query("str17_clock_continuity", """SELECT sequence, CASE WHEN event_type = 'signup' THEN 'unknown_domain' WHEN p IS NULL THEN 'first' WHEN dm IS DISTINCT FROM t THEN 'domain_change' WHEN wall < pw THEN 'wall_backward' WHEN sequence - p > 300 THEN 'gap' WHEN abs((wall - pw) - (sequence - p)) > 300 THEN 'clock_jump' ELSE 'continuous' END AS continuity
FROM (SELECT *, lag(sequence) OVER w AS p, lag(wall) OVER w AS pw, lag(dm) OVER w AS t FROM (SELECT *, sequence + CASE WHEN sequence % 50 = 0 THEN 1000 ELSE 0 END AS wall, CASE WHEN event_type = 'signup' THEN NULL WHEN execution_id % 2 = 0 THEN 'boot' ELSE event_type END AS dm FROM ev) WINDOW w AS (PARTITION BY execution_id ORDER BY sequence))""")
def _(spark, d):
    domain = F.when(F.col("event_type") == "signup", None).when(F.col("execution_id") % 2 == 0, "boot").otherwise(F.col("event_type"))
    e = V.events(spark, d).select("execution_id", "sequence", domain.alias("domain"), (F.col("sequence") + F.when(F.col("sequence") % 50 == 0, 1000).otherwise(0)).alias("wall"))
    return queues.continuity(e, ["execution_id"], ["sequence"], "wall", "sequence", "domain", 300).select("sequence", "continuity")


@query("str18_tick_counts", "SELECT sequence // 500 AS tick, count(*) AS n FROM ev GROUP BY 1")
def _(spark, d):
    return queues.tick_counts(V.events(spark, d), "sequence", 500)


@query("str19_wait_intervals", "SELECT execution_id, min(sequence) FILTER (event_type = 'view') AS started_at, max(sequence) FILTER (event_type = 'click') AS ended_at FROM ev GROUP BY 1")
def _(spark, d):
    return queues.wait_intervals(V.events(spark, d), "execution_id", "sequence", F.col("event_type") == "view", F.col("event_type") == "click")


@query("str20_lifecycle_order", "SELECT execution_id, min(sequence) AS sequence FROM ev WHERE event_type IN ('signup', 'error') GROUP BY 1")
def _(spark, d):
    q = V.events(spark, d)
    return joins.head_of_line(q, "execution_id", "sequence", F.col("event_type").isin("signup", "error")).select("execution_id", "sequence")


@query("udf01_handler", "SELECT run_id, revision, CAST(length(value) AS BIGINT) AS result FROM items")
def _(spark, d):
    from ..functions.handlers import apply_handler

    return apply_handler(V.items(spark, d).select("run_id", "revision", "value"), lambda pdf: pdf.assign(result=pdf["value"].str.len())[["run_id", "revision", "result"]], "run_id long, revision long, result long")


@query("udf02_registry_revision", "SELECT execution_id, sha256(revision || ':' || state) AS fingerprint FROM executions")
def _(spark, d):
    return V.executions(spark, d).select("execution_id", F.sha2(F.concat_ws(":", "revision", "state"), 256).alias("fingerprint"))
