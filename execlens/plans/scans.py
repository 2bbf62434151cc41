"""Queries: sources, projections, predicates, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..operators import aggs, graph, history, paging
from ..sources import store
from . import views as V
from .catalog import query

NOW = 10_000  # days since 1970: May 1997, the queries' clock


@query("src01_read_store", "SELECT execution_id, state, created_at FROM executions")
def _(spark, d):
    return V.executions(spark, d).select("execution_id", "state", "created_at")


@query("src02_read_only_scan", "SELECT count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM attempts WHERE state = 'F'")
def _(spark, d):
    return V.attempts(spark, d).where("state = 'F'").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("src03_two_stores", "SELECT kind, count(*) AS n FROM executions JOIN runs USING (run_id) GROUP BY kind")
def _(spark, d):
    return V.executions(spark, d).join(V.runs(spark, d), "run_id").groupBy("kind").agg(F.count("*").alias("n"))


@query("src04_point_lookup", "SELECT * FROM executions WHERE execution_id = 77")
def _(spark, d):
    return V.executions(spark, d).where("execution_id = 77")


@query("src05_entity_history", "SELECT sequence, event_type, value FROM ev WHERE execution_id = 7")
def _(spark, d):
    return V.events(spark, d).where("execution_id = 7").select("sequence", "event_type", "value").orderBy("sequence")


@query("src06_event_tail", "SELECT sequence, execution_id, event_type FROM ev WHERE sequence > 500 ORDER BY sequence LIMIT 100")
def _(spark, d):
    return paging.keyset_page(V.events(spark, d).select("sequence", "execution_id", "event_type"), ["sequence"], [F.lit(500).cast("long")], 100)


@query("src07_run_events_unexpired", "SELECT e.sequence, e.execution_id FROM ev e WHERE e.sequence > 100 AND e.sequence > (SELECT min(sequence) + 20 FROM ev x WHERE x.execution_id = e.execution_id)")
def _(spark, d):
    e = V.events(spark, d)
    expired = e.groupBy("execution_id").agg((F.min("sequence") + 20).alias("expired_through"))
    return e.where("sequence > 100").join(expired, "execution_id").where("sequence > expired_through").select("sequence", "execution_id")


@query("src08_observe_run", "SELECT i.run_id, count(*) AS items, max(revision) AS high_water, (SELECT count(*) FROM ev WHERE ev.execution_id = i.run_id) AS events FROM items i GROUP BY i.run_id")
def _(spark, d):
    i = V.items(spark, d).groupBy("run_id").agg(F.count("*").alias("items"), F.max("revision").alias("high_water"))
    e = V.events(spark, d).groupBy(F.col("execution_id").alias("run_id")).agg(F.count("*").alias("events"))
    return i.join(e, "run_id", "left").select("run_id", "items", "high_water", F.coalesce("events", F.lit(0)).cast("long").alias("events"))


@query("src09_telemetry_page", "SELECT * FROM (SELECT execution_id, sequence, CAST(sum(strlen(payload)) OVER (PARTITION BY execution_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_bytes FROM ev) WHERE running_bytes <= 200")
def _(spark, d):
    return history.byte_page(V.events(spark, d), ["execution_id"], ["sequence"], F.octet_length("payload"), 200).select("execution_id", "sequence", "running_bytes")


@query("src10_chunked_text", "SELECT run_id, revision, CAST(k AS INTEGER) AS chunk, substr(value, CAST(k * 64 + 1 AS BIGINT), 64) AS piece FROM items, unnest(range(CAST(ceil(length(value) / 64.0) AS BIGINT))) AS g(k)")
def _(spark, d):
    i = V.items(spark, d).where("length(value) > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.length("value") - 1) / 64).cast("int"))))
    return i.select("run_id", "revision", "chunk", F.substr("value", F.col("chunk") * 64 + 1, F.lit(64)).alias("piece"))


@query("src11_reassembled_streams", "SELECT run_id, sha256(string_agg(value, '' ORDER BY revision)) AS digest, count(*) AS pages FROM items GROUP BY run_id")
def _(spark, d):
    p = F.array_sort(F.collect_list(F.struct("revision", "value")))
    return V.items(spark, d).groupBy("run_id").agg(F.sha2(F.array_join(F.transform(p, lambda x: x["value"]), ""), 256).alias("digest"), F.count("*").alias("pages"))


@query("src12_valid_json", "SELECT event_type, count(*) FILTER (json_valid(payload)) AS valid, count(*) FILTER (NOT json_valid(payload)) AS invalid FROM (SELECT event_type, CASE WHEN sequence % 10 = 0 THEN substr(payload, 1, length(payload) - 1) ELSE payload END AS payload FROM ev) GROUP BY event_type")
def _(spark, d):
    p = F.when(F.col("sequence") % 10 == 0, F.substr("payload", F.lit(1), F.length("payload") - 1)).otherwise(F.col("payload"))
    return V.events(spark, d).withColumn("p", p).groupBy("event_type").agg(F.count_if(F.try_parse_json("p").isNotNull()).alias("valid"), F.count_if(F.try_parse_json("p").isNull()).alias("invalid"))


@query("src13_content_addressed", "SELECT sha256(text) AS digest, CAST(min(strlen(text)) AS BIGINT) AS logical_bytes, count(*) AS refs FROM documents GROUP BY 1", views=False)
def _(spark, d):
    t = V.read(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("logical_bytes"))
    return t.groupBy("digest").agg(F.min("logical_bytes").alias("logical_bytes"), F.count("*").alias("refs"))


@query("src14_verified_content", "SELECT count(*) AS refs, count(*) FILTER (sha256(text) = digest) AS verified FROM (SELECT text, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS digest FROM documents)", views=False)
def _(spark, d):
    t = V.read(spark, d, "documents").withColumn("digest", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256))
    return t.agg(F.count("*").alias("refs"), F.count_if(X.content_digest("text") == F.col("digest")).alias("verified"))


@query("src15_byte_chunks", "SELECT execution_id, CAST(sum(strlen(payload)) AS BIGINT) AS bytes, count(*) AS chunks FROM ev GROUP BY execution_id")
def _(spark, d):
    return V.events(spark, d).groupBy("execution_id").agg(F.sum(F.octet_length(F.col("payload").cast("binary"))).alias("bytes"), F.count("*").alias("chunks"))


@query("snk02_snapshot", "SELECT 'executions' AS name, count(*) AS rows, true AS matches FROM executions UNION ALL SELECT 'runs', count(*), true FROM runs UNION ALL SELECT 'nation', count(*), true FROM nation")
def _(spark, d):
    """Writes a snapshot with its manifest, reads it back and holds every table against the manifest."""
    path = graph.written(spark.range(1)).inputFiles()[0].rsplit("/", 1)[0] + "-snapshot"
    tables = {"executions": V.executions(spark, d), "runs": V.runs(spark, d), "nation": V.read(spark, d, "nation")}
    made = store.snapshot(tables, path).select("name", "rows")
    return made.join(store.verify_snapshot(spark, path), "name")


@query("snk05_upgraded_rows", "SELECT execution_id, state = 'F' AS finished, CAST(created_at * 86400 AS DOUBLE) AS created_at FROM executions")
def _(spark, d):
    return V.executions(spark, d).select("execution_id", (F.col("state") == "F").alias("finished"), (F.col("created_at") * 86400).cast("double").alias("created_at"))


@query("snk06_materialised_rows", "SELECT run_id, max(created_at) AS newest FROM executions GROUP BY run_id")
def _(spark, d):
    return spark.sql("SELECT run_id, max(created_at) AS newest FROM {e} GROUP BY run_id", e=V.executions(spark, d))


@query("cat01_object_sizes", "SELECT 'items' AS name, count(*) AS n, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM items UNION ALL SELECT 'events', count(*), CAST(sum(strlen(payload)) AS BIGINT) FROM ev")
def _(spark, d):
    size = lambda df, name, c: df.agg(F.count("*").alias("n"), F.sum(F.octet_length(c)).alias("bytes")).select(F.lit(name).alias("name"), "n", "bytes")
    return size(V.items(spark, d), "items", "value").unionByName(size(V.events(spark, d), "events", "payload"))


@query("cat02_schema_check", "SELECT 'o_orderpriority: string instead of bigint' AS difference UNION ALL SELECT 'undeclared o_orderdate'", views=False)
def _(spark, d):
    from ..operators.checks import schema_difference

    declared = T.StructType().add("o_orderkey", "long").add("o_custkey", "long").add("o_orderstatus", "string").add("o_totalprice", "double").add("o_orderpriority", "long")
    found = schema_difference(V.read(spark, d, "orders").schema, declared)
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in found])).alias("difference"))


@query("prj01_decoded_rows", "SELECT sequence, CAST(json_extract(payload, '$.k') AS BIGINT) AS k FROM ev")
def _(spark, d):
    return V.events(spark, d).select("sequence", F.from_json("payload", "k bigint")["k"].alias("k"))


@query("prj02_bounded_columns", "SELECT run_id, revision, CASE WHEN strlen(value) <= 300 THEN value END AS value, strlen(value) > 300 AS value_oversized FROM items")
def _(spark, d):
    return V.items(spark, d).select("run_id", "revision", *X.bounded("value", 300))


@query("prj03_guarded_json_path", "SELECT sequence, CASE WHEN length(payload) <= 9 AND json_valid(payload) THEN json_extract_string(payload, '$.k') END AS k FROM ev")
def _(spark, d):
    return V.events(spark, d).select("sequence", X.json_path("payload", "$.k", 9).alias("k"))


@query("prj04_managed_flag", "SELECT e.execution_id, r.run_id IS NOT NULL AS managed FROM executions e LEFT JOIN (SELECT run_id FROM runs WHERE kind = 'BUILDING') r USING (run_id)")
def _(spark, d):
    r = V.runs(spark, d).where("kind = 'BUILDING'").select("run_id", F.lit(True).alias("_m"))
    return V.executions(spark, d).join(r, "run_id", "left").select("execution_id", F.col("_m").isNotNull().alias("managed"))


@query("prj05_delivery_label", "SELECT execution_id, CASE WHEN state = 'F' THEN 'delivered' WHEN total > 250000 THEN 'failed' ELSE 'pending' END AS label FROM executions")
def _(spark, d):
    return V.executions(spark, d).select("execution_id", X.delivery_label(F.col("state") == "F", F.when(F.col("total") > 250000, F.lit("x"))).alias("label"))


@query("prj06_safe_labels", "SELECT CASE WHEN regexp_full_match(revision, '[A-Za-z0-9_.:-]*') THEN revision ELSE 'other' END AS label, count(*) AS n FROM executions GROUP BY 1")
def _(spark, d):
    return V.executions(spark, d).groupBy(X.safe_label("revision").alias("label")).agg(F.count("*").alias("n"))


@query("flt01_claimable", f"SELECT execution_id FROM executions WHERE state = 'O' AND created_at <= {NOW} AND revision IN ('1-URGENT', '2-HIGH')")
def _(spark, d):
    e = V.executions(spark, d)
    return e.where(X.claimable("state", "created_at", "revision", F.lit(NOW), ["1-URGENT", "2-HIGH"], queued="O")).select("execution_id")


@query("flt02_state_set", "SELECT state, count(*) AS n FROM executions WHERE state IN ('F', 'P') GROUP BY state")
def _(spark, d):
    return V.executions(spark, d).where(X.in_states("state", ["F", "P"])).groupBy("state").agg(F.count("*").alias("n"))


@query("flt03_optional_equal", "SELECT count(*) AS n FROM attempts WHERE reason = 'R'")
def _(spark, d):
    a = X.optional_equal(X.optional_equal(V.attempts(spark, d), "reason", "R"), "state", None)
    return a.agg(F.count("*").alias("n"))


@query("flt04_id_list", "SELECT sequence FROM ev WHERE json_extract_string(payload, '$.k') IN ('3', '5', '8')")
def _(spark, d):
    return V.events(spark, d).where(F.get_json_object("payload", "$.k").isin("3", "5", "8")).select("sequence")


@query("flt05_keyset_single", "SELECT run_id FROM runs WHERE run_id > 40 ORDER BY run_id LIMIT 25")
def _(spark, d):
    return paging.keyset_page(V.runs(spark, d).select("run_id"), ["run_id"], [F.lit(40).cast("long")], 25)


@query("flt06_keyset_compound", f"SELECT created_at, execution_id FROM executions WHERE created_at > {NOW} OR (created_at = {NOW} AND execution_id > 5000) ORDER BY created_at, execution_id LIMIT 50")
def _(spark, d):
    e = V.executions(spark, d).select("created_at", "execution_id")
    return paging.keyset_page(e, ["created_at", "execution_id"], [F.lit(NOW).cast("long"), F.lit(5000).cast("long")], 50)


@query("flt07_keyset_row_value", "SELECT execution_id, attempt FROM attempts WHERE (execution_id, attempt) > (100, 4) GROUP BY ALL ORDER BY execution_id, attempt LIMIT 40")
def _(spark, d):
    a = V.attempts(spark, d).select("execution_id", "attempt").distinct()
    return paging.keyset_page(a, ["execution_id", "attempt"], [F.lit(100).cast("long"), F.lit(4).cast("long")], 40)


@query("flt08_typed_values", "SELECT sequence, CASE WHEN json_type(payload, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(payload, '$.k') AS BIGINT) END AS k FROM ev WHERE execution_id = 3")
def _(spark, d):
    v = F.try_parse_json("payload")
    return V.events(spark, d).where("execution_id = 3").select("sequence", F.when(F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")) == "BIGINT", F.try_variant_get(v, "$.k", "bigint")).alias("k"))


@query("flt09_prefix", "SELECT count(*) AS n FROM executions WHERE revision LIKE '4-%'")
def _(spark, d):
    return V.executions(spark, d).where(F.col("revision").startswith("4-")).agg(F.count("*").alias("n"))


@query("flt10_freshness", f"SELECT execution_id, CASE WHEN {NOW} - shipped BETWEEN 0 AND 90 THEN 'observed' ELSE 'unknown' END AS seen FROM (SELECT execution_id, max(shipped) AS shipped FROM attempts GROUP BY 1)")
def _(spark, d):
    a = V.attempts(spark, d).groupBy("execution_id").agg(F.max("shipped").alias("shipped"))
    return a.select("execution_id", X.freshness("shipped", F.lit(NOW), 90).alias("seen"))


@query("flt11_superseded_dispatch", "SELECT execution_id, attempt FROM attempts a WHERE reason = 'A' AND NOT EXISTS (SELECT 1 FROM attempts c WHERE c.execution_id = a.execution_id AND c.reason = 'R')")
def _(spark, d):
    a = V.attempts(spark, d)
    return a.where("reason = 'A'").join(a.where("reason = 'R'").select("execution_id"), "execution_id", "left_anti").select("execution_id", "attempt")


@query("flt12_blocked_runs", "SELECT execution_id FROM executions WHERE state = 'O' AND run_id NOT IN (SELECT run_id FROM executions WHERE state = 'P' AND total > 450000)")
def _(spark, d):
    e = V.executions(spark, d)
    return e.where("state = 'O'").join(e.where("state = 'P' AND total > 450000").select("run_id"), "run_id", "left_anti").select("execution_id")


@query("sca01_backoff", "SELECT attempt, least(60.0, 2.0 * pow(3.0, attempt - 1)) AS delay FROM (SELECT DISTINCT attempt FROM attempts)")
def _(spark, d):
    return V.attempts(spark, d).select("attempt").distinct().select("attempt", X.backoff("attempt", 2, 3, 60).alias("delay"))


@query("sca02_lengths", "SELECT run_id, revision, CAST(strlen(value) AS BIGINT) AS bytes, CAST(length(value) AS BIGINT) AS chars FROM items")
def _(spark, d):
    return V.items(spark, d).select("run_id", "revision", F.octet_length("value").cast("long").alias("bytes"), F.length("value").cast("long").alias("chars"))


@query("sca04_text_functions", "SELECT run_id, revision, substr(value, 3, 5) AS s, CAST(instr(value, 'a') AS BIGINT) AS i, lower(trim(item_key)) AS k FROM items")
def _(spark, d):
    return V.items(spark, d).select("run_id", "revision", F.substring("value", 3, 5).alias("s"), F.instr("value", "a").cast("long").alias("i"), F.lower(F.trim("item_key")).alias("k"))


@query("sca08_patterns", "SELECT count(*) FILTER (value ILIKE 'the %') AS prefixed, count(*) FILTER (regexp_matches(value, '^[A-Z][a-z]+ [a-z]')) AS shaped FROM items")
def _(spark, d):
    return V.items(spark, d).agg(F.count_if(F.col("value").ilike("the %")).alias("prefixed"), F.count_if(F.col("value").rlike("^[A-Z][a-z]+ [a-z]")).alias("shaped"))


@query("sca10_json_values", "SELECT event_type, CAST(sum(CAST(json_extract(payload, '$.k') AS BIGINT)) AS BIGINT) AS k FROM ev GROUP BY event_type")
def _(spark, d):
    return V.events(spark, d).groupBy("event_type").agg(F.sum(F.variant_get(F.parse_json("payload"), "$.k", "bigint")).alias("k"))


@query("sca12_canonical_json", "SELECT sequence, replace(payload, ' ', '') AS canonical FROM ev")
def _(spark, d):
    return V.events(spark, d).select("sequence", X.canonical_json("payload").alias("canonical"))


@query("sca13_json_quote", "SELECT run_id, '[\"' || item_key || '\"]' AS quoted FROM items GROUP BY ALL")
def _(spark, d):
    return V.items(spark, d).select("run_id", F.to_json(F.array("item_key")).alias("quoted")).distinct()


@query("sca15_coalesce_case", "SELECT execution_id, coalesce(nullif(state, 'P'), 'unknown') AS state, CASE WHEN total < 100000 THEN 0 WHEN total < 300000 THEN 1 ELSE 2 END AS size FROM executions")
def _(spark, d):
    s = F.coalesce(F.nullif(F.col("state"), F.lit("P")), F.lit("unknown"))
    return V.executions(spark, d).select("execution_id", s.alias("state"), F.when(F.col("total") < 100000, 0).when(F.col("total") < 300000, 1).otherwise(2).alias("size"))


@query("sca17_scalar_max", "SELECT execution_id, CASE WHEN a IS NOT NULL THEN greatest(a, 9000) END AS m FROM (SELECT execution_id, nullif(created_at, 9131) AS a FROM executions)")
def _(spark, d):
    a = F.nullif(F.col("created_at"), F.lit(9131).cast("long"))
    return V.executions(spark, d).select("execution_id", X.both_greatest(a, F.lit(9000).cast("long")).alias("m"))


@query("sca18_epoch", "SELECT execution_id, created_at * 86400 AS epoch FROM executions")
def _(spark, d):
    o = V.read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("execution_id"), (V.day("o_orderdate") * 86400).alias("epoch"))


@query("sca19_digests", "SELECT sequence, sha256(replace(payload, ' ', '')) AS digest, sha256('node:' || payload) AS prefixed FROM ev")
def _(spark, d):
    return V.events(spark, d).select("sequence", F.sha2(X.canonical_json("payload"), 256).alias("digest"), X.content_digest("payload", "node:").alias("prefixed"))


@query("sca21_base64_tail", "SELECT run_id, revision, to_base64(encode(value)) AS encoded FROM items")
def _(spark, d):
    return V.items(spark, d).select("run_id", "revision", F.base64(F.encode("value", "UTF-8")).alias("encoded")).withColumn("encoded", F.regexp_replace("encoded", "\r\n", ""))


@query("sca22_effective_time", "SELECT sequence, CASE WHEN event_type = pt AND sequence >= ps THEN greatest(value, pv + (sequence - ps)) END AS effective FROM (SELECT *, lag(event_type) OVER w AS pt, lag(sequence) OVER w AS ps, lag(value) OVER w AS pv FROM ev WINDOW w AS (PARTITION BY execution_id ORDER BY sequence))")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("execution_id").orderBy("sequence")
    e = V.events(spark, d).withColumns({"pt": F.lag("event_type").over(w), "ps": F.lag("sequence").over(w), "pv": F.lag("value").over(w)})
    t = X.effective_time(F.col("value").cast("decimal(20,2)"), F.col("sequence").cast("decimal(20,2)"), F.col("event_type"), F.col("pv").cast("decimal(20,2)"), F.col("ps").cast("decimal(20,2)"), F.col("pt"))
    return e.select("sequence", t.cast("decimal(22,2)").alias("effective"))


@query("sca23_deadlines", "SELECT execution_id, CAST(min(shipped - amount) AS BIGINT) AS deadline FROM attempts GROUP BY execution_id")
def _(spark, d):
    a = V.attempts(spark, d).groupBy("execution_id").agg(F.collect_list(F.struct(F.col("shipped").alias("deadline_at"), F.col("amount").alias("reserve"))).alias("c"))
    return a.select("execution_id", X.effective_deadline(F.col("c")).alias("deadline"))


@query("sca24_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM ev GROUP BY event_type")
def _(spark, d):
    return V.events(spark, d).groupBy("event_type").agg(X.nearest_rank(F.col("value"), 50).alias("p50"), X.nearest_rank(F.col("value"), 95).alias("p95"))


@query("sca26_collections", "SELECT run_id, list_sort(list(DISTINCT item_key))[1] AS first_key, CAST(len(list(DISTINCT item_key)) AS BIGINT) AS keys, list_contains(list(item_key), 'system') AS has_system FROM items GROUP BY run_id")
def _(spark, d):
    s = V.items(spark, d).groupBy("run_id").agg(F.sort_array(F.collect_set("item_key")).alias("k"))
    return s.select("run_id", F.element_at("k", 1).alias("first_key"), F.size("k").cast("long").alias("keys"), F.array_contains("k", "system").alias("has_system"))


@query("sca27_finite", "SELECT count(*) FILTER (isfinite(x)) AS finite FROM (SELECT CASE WHEN sequence % 5 = 0 THEN CAST('inf' AS DOUBLE) WHEN sequence % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(value AS DOUBLE) END AS x FROM ev)")
def _(spark, d):
    x = F.when(F.col("sequence") % 5 == 0, F.lit(float("inf"))).when(F.col("sequence") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value").cast("double"))
    return V.events(spark, d).select(x.alias("x")).agg(F.count_if(X.finite("x")).alias("finite"))
