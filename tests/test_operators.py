"""Operators on small fixtures: zero fill, ties, nulls, unknowns, and replays against plain Python."""

import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from execlens.functions import exprs as X
from execlens.operators import aggs, checks, dedup, fold, graph, history, joins, paging, reports


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_state_counts_fill_zeros(spark):
    df = spark.createDataFrame([("F",), ("F",), ("O",), (None,), ("Z",)], "s string")
    assert rows(aggs.state_counts(df, "s", ["F", "O", "P"])) == [("F", 2), ("O", 1), ("P", 0)]


def test_claimable_is_due_queued_and_known(spark):
    df = spark.createDataFrame([(1, "queued", 5.0, "a"), (2, "queued", 50.0, "a"), (3, "leased", 5.0, "a"), (4, "queued", 5.0, "x"), (5, "queued", 10.0, "b")], "id long, state string, due double, rev string")
    assert [r.id for r in df.where(X.claimable("state", "due", "rev", F.lit(10.0), ["a", "b"])).orderBy("id").collect()] == [1, 5]


def test_backoff_overflow_and_shortcuts(spark):
    df = spark.createDataFrame([(1,), (3,), (5000,)], "a int")
    assert [r[0] for r in df.orderBy("a").select(X.backoff("a", 2, 3, 60)).collect()] == [2.0, 18.0, 60.0]
    assert [r[0] for r in df.select(X.backoff("a", 4, 1, 60)).collect()] == [4.0] * 3


def test_budget_unknown_is_not_zero(spark):
    r = spark.createDataFrame(
        [("r", "settled", 5, 7), ("r", "reserved", 4, None), ("s", "unknown", 3, None), ("s", "reserved", 2, None), ("o", "settled", 1, 90), ("x", "settled", 2, None), ("y", "reserved", 2, 1), ("z", "gone", 2, None), ("w", "reserved", -1, None), ("e", "settled", 1, 1)],
        "run string, state string, amount long, actual long",
    )
    b = spark.createDataFrame([(x, 20) for x in "rsuoxyzwe"], "run string, allowance long")
    before = spark.createDataFrame([("u", 5), ("u", 6), ("e", 15)], "run string, spent long")
    got = aggs.budget_rollup(r, b, ["run"], before)
    seen = {x.run: (x.spent, x.reserved, x.unknown, x.pending, x.available) for x in got.collect()}
    assert seen == {"r": (7, 4, 0, 1, 9), "s": (0, 5, 1, 2, None), "u": (11, 0, 0, 0, 9), "o": (90, 0, 0, 0, 0), "e": (16, 0, 0, 0, 4)} | {x: (None, None, 0, int(x in "yw"), None) for x in "xyzw"}
    label = lambda amount, limit=10_000, late=False: dict(got.select("run", aggs.budget_label(F.lit(late), F.lit(amount), limit)).collect())
    assert label(4) == {"r": "pending", "s": "unknown", "u": "available", "o": "exhausted", "e": "available"} | dict.fromkeys("xyzw", "unknown")
    assert label(5)["e"] == "exhausted" and label(4, 1)["e"] == "capacity_exhausted" and label(4, 1)["r"] == "pending"
    assert label(1, late=True) == dict.fromkeys("rsuoe", "expired") | dict.fromkeys("xyzw", "unknown")


def test_bounded_count(spark):
    assert rows(aggs.bounded_count(spark.range(3), 5)) == [(3, 3, True)]
    assert rows(aggs.bounded_count(spark.range(9), 5)) == [(None, 5, False)]


def test_logical_digest_ignores_order(spark):
    a = spark.createDataFrame([(i % 5, str(i)) for i in range(50)] + [(None, None)], "x long, y string")
    b = a.orderBy(F.rand(3)).repartition(7).select("y", "x")
    assert rows(aggs.logical_digest(a)) == rows(aggs.logical_digest(b)) != rows(aggs.logical_digest(a.where("x <> 1")))


def test_as_of_and_latest(spark):
    h = spark.createDataFrame([("a", 1, "p"), ("a", 3, "q"), ("b", 2, None), ("c", 9, "z")], "k string, rev long, v string")
    assert rows(joins.as_of(h, ["k"], "rev", F.lit(2))) == [("a", 1, "p"), ("b", 2, None)]
    assert rows(joins.latest(h, ["k"], ["rev"])) == [("a", 3, "q"), ("b", 2, None), ("c", 9, "z")]
    p = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 5), ("d", 1)], "k string, at long")
    assert rows(joins.as_of_each(h, p, ["k"], "rev", "at")) == [("a", 0, None), ("a", 1, 1), ("a", 2, 1), ("a", 5, 3), ("d", 1, None)]


def test_head_of_line_and_inconsistent(spark):
    q = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, False), (2, 4, False)], "e long, s long, done boolean")
    assert rows(joins.head_of_line(q, "e", "s", ~F.col("done")).select("e", "s")) == [(1, 2), (2, 4)]
    a = spark.createDataFrame([(1, '{"a":1,"b":2}'), (2, "{}"), (3, None)], "k long, j string")
    b = spark.createDataFrame([(1, '{ "b": 2, "a": 1 }'), (2, '{"x":1}'), (3, None)], "k long, i string")
    assert rows(joins.inconsistent(a, b, "k", X.canonical_json("j"), X.canonical_json("i"))) == [(2,)]


def test_runs_and_episodes(spark):
    s = spark.createDataFrame([(1, t, v) for t, v in enumerate([0, 0, 0, 9, 0, 0, 9, 0, 0, 0, 0])], "k long, t long, v long")
    assert [r.run for r in history.run_lengths(s, ["k"], ["t"], F.col("v") == 0).orderBy("t").collect()] == [1, 2, 3, 0, 1, 2, 0, 1, 2, 3, 4]
    assert rows(history.episodes(s, ["k"], "t", F.col("v") == 0, 3)) == [(1, 0, 3, 3), (1, 7, None, 4)]


def test_scd2_and_upsert(spark):
    h = spark.createDataFrame([("a", 0, "x"), ("a", 1, "x"), ("a", 2, None), ("a", 3, None), ("a", 4, "x")], "k string, r long, v string")
    assert rows(history.changed_versions(h, ["k"], ["r"], "v")) == [("a", 0, "x", 2), ("a", 2, None, 4), ("a", 4, "x", None)]
    t = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "k string, r long, v string")
    c = spark.createDataFrame([("a", 1, "new"), ("b", 4, "late"), ("c", 0, "new")], "k string, r long, v string")
    assert rows(history.upsert(t, c, ["k"], "r")) == [("a", 1, "new"), ("b", 5, "old"), ("c", 0, "new")]


def test_keyset_pages_cover_everything(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(20)], "a long, b long")
    seen, after = [], None
    while page := paging.keyset_page(df, ["a", "b"], after, 6).collect():
        seen += [(r.a, r.b) for r in page]
        after = [F.lit(seen[-1][0]).cast("long"), F.lit(seen[-1][1]).cast("long")]
    assert seen == sorted((i // 3, i) for i in range(20))
    page, more = paging.page_with_more(df, ["b"], 5)
    assert page.count() == 5 and more.first().has_more


def test_sets(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "k string, c string")
    b = spark.createDataFrame([("x", "2"), ("y", None), ("w", "4")], "k string, c string")
    assert rows(dedup.declaration_changes(a, b, "k", "c")) == [("w", "added"), ("x", "changed"), ("z", "removed")]
    assert rows(dedup.pending_anywhere(a.where("false"), b.where("false"))) == [(False,)] and rows(dedup.pending_anywhere(a, b)) == [(True,)]
    assert rows(dedup.insert_or_ignore(a.select("k"), spark.createDataFrame([("x", 1), ("q", 3), ("q", 2)], "k string, n long"), ["k"], ["n"])) == [("q", 2)]


def random_graph(seed, n=14, m=22):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_graphs_equal_plain_python(spark):
    for seed in (1, 2):
        edges = random_graph(seed)
        df = spark.createDataFrame(edges, "src long, dst long")
        seeds = spark.createDataFrame([(edges[0][0],)], "node long")
        assert {r.node for r in graph.closure(df, seeds).collect()} == reach(edges, edges[0][0]) | {edges[0][0]}
        scc = {}
        for x in range(14):
            group = {y for y in reach(edges, x) if x in reach(edges, y)}
            if x in reach(edges, x):
                scc[x] = min(group)
        assert {r.node: r.component for r in graph.strong_components(df).collect()} == scc
        assert graph.cyclic_nodes(df).isEmpty() == (not scc)


def test_chains_depths_and_levels(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7)], "previous long, next long")
    assert rows(graph.chain_ends(links)) == [(1, 2, 4, False), (2, 3, 4, False), (3, 4, 4, False), (7, 8, None, True), (8, 7, None, True)]
    parents = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 1)], "node long, parent long")
    assert rows(graph.depths(parents)) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 1)]
    e = spark.createDataFrame([(1, 2), (2, 4), (1, 4), (3, 4)], "src long, dst long")
    assert rows(graph.levels(e, spark.createDataFrame([(i,) for i in range(1, 6)], "node long"))) == [(1, 0), (2, 1), (3, 0), (4, 2), (5, 0)]


def test_topological_order_takes_the_least_ready(spark):
    t = spark.createDataFrame([("r", "d", ["b"]), ("r", "b", ["a"]), ("r", "a", []), ("r", "c", []), ("q", "z", [])], "run_id string, task_id string, dependencies array<string>")
    got = sorted(map(tuple, graph.topological(t).collect()))
    assert got == [("q", 0, "z"), ("r", 0, "a"), ("r", 1, "b"), ("r", 2, "c"), ("r", 3, "d")]


def test_impact_preview(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "task_id string, declaration string")
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("c", "b")], "src string, dst string")
    changed = spark.createDataFrame([("c",)], "task_id string")
    assert rows(graph.preview_impact(old, old, changed, edges)) == [("b", "downstream"), ("c", "changed"), ("d", "downstream")]


def test_integrity(spark):
    ev = spark.createDataFrame([("queued", "leased"), ("leased", "running"), ("running", "queued"), ("queued", "succeeded"), (None, "queued")], "from_state string, to_state string")
    assert rows(checks.illegal_transitions(ev)) == [("queued", "succeeded", 1)]
    r = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 7)], "k string, rev long")
    assert [(x.k, x.rev) for x in checks.revision_gaps(r, "k", "rev").collect()] == [("a", 4)]
    assert rows(checks.violations(r, {"small": F.col("rev") < 5, "fine": F.col("rev") > 0})) == [("small", 1)]
    assert checks.schema_difference(r.schema, spark.createDataFrame([], "k string, rev int, z long").schema) == ["missing z", "rev: bigint instead of int"]


def test_folds(spark):
    ev = spark.createDataFrame([("e", 2, "running", 3.0), ("e", 0, "queued", 1.0), ("e", 1, "leased", 9.0)], "execution_id string, revision long, to_state string, created_at double")
    assert rows(fold.fold_executions(ev)) == [("e", "running", 2, 3, 1.0, 9.0)]
    ex = spark.createDataFrame([("a", "dead", "x"), ("b", "dead", None), ("c", "queued", "x"), ("d", "queued", None), ("e", "dead", "x")], "execution_id string, state string, result_json string")
    ob = spark.createDataFrame([("a",), ("d",), ("z",)], "execution_id string")
    assert {i for i, _ in rows(fold.terminal_mismatch(ex, ob, ["dead"]))} == {"b", "c", "d", "e", "z"}
    lease = spark.createDataFrame([("a", "leased", 1, 5.0), ("b", "running", 3, 5.0), ("c", "running", 1, 50.0)], "id string, state string, attempt int, lease_expires_at double")
    assert rows(fold.reap(lease, F.lit(10.0), 2, 2, 60, 3).select("id", "next_state", "next_attempt_at")) == [("a", "queued", 12.0), ("b", "dead", None)]


def test_revision_impact_covers_all_ids(spark, sf_dir):
    from execlens.plans import load
    from execlens.plans import views as V
    from execlens.plans.catalog import QUERIES

    load()
    sf_dir = str(Path(sf_dir).parent / "sf0.01")  # the smallest tables have no ids of 4000 or more
    ids = {r[0] for r in V.executions(spark, sf_dir).select("execution_id").collect()}
    hit = {i for i in ids if i % 97 == 0 or i % 501 == 0 or i == 1234}
    want = set(hit)
    for i in sorted(ids - {0}):
        if i // 2 in want:
            want.add(i)
    got = {r.task_id for r in QUERIES["gra05_revision_impact"](spark, sf_dir).collect()}
    assert max(ids) >= 4000 and got >= {i for i in want if i >= 4000} and {i for i in hit if i >= 4000} <= got


def test_every_transition(spark):
    """All 81 pairs of states; the legal ones are written out."""
    states = ["queued", "leased", "running", "succeeded", "failed", "timed_out", "cancelled", "dead", "recovery_required"]
    legal = {
        "queued": {"leased", "cancelled", "dead", "recovery_required"},
        "leased": {"running", "queued", "cancelled", "dead", "recovery_required"},
        "running": set(states) - {"leased", "running"},
        "recovery_required": {"queued", "cancelled"},
    }
    ev = spark.createDataFrame([(a, b) for a in states for b in states], "from_state string, to_state string")
    assert {(a, b) for a, b, _ in rows(checks.illegal_transitions(ev))} == {(a, b) for a in states for b in states if b not in legal.get(a, ())}
    assert set(checks.TERMINAL) == set(states) - legal.keys()


def replay(spark, *ops):
    df = spark.createDataFrame([("r", i, o["kind"], json.dumps({k: v for k, v in o.items() if k != "kind"})) for i, o in enumerate(ops)], "run_id string, revision long, kind string, data string")
    r = fold.replay_operations(df.repartition(3)).first()
    return r.state, json.loads(r.document), {x.revision: x.reason for x in r.rejected}


def test_replay_of_the_ten_kinds(spark):
    op = lambda kind, **fields: {"kind": kind} | fields
    state, doc, rejected = replay(
        spark,
        op("add_task", task_id="a", command="x"), op("add_task", task_id="b", command="y"), op("set_dependencies", task_id="b", dependencies=["a"]), op("dispatch", task_id="a"),
        op("watch_task", task_id="a", watch_id="w", target="t", max_deliveries=3), op("wait", wait_id="q", payload=1), op("signal", signal_id="s", payload={"v": 2}), op("result", task_id="a", state="failed"),
        op("new_attempt", task_id="a", command="z"), op("cancel", task_id="a", reason="stop"), op("dispatch", task_id="b"), op("cancel", task_id="b", reason="late"), op("result", task_id="b", state="timed_out"),
        op("release_wait", wait_id="q"), op("finish", state="failed"),
    )
    assert (state, rejected) == ("failed", {})
    assert doc["tasks"]["a"]["attempts"] == [{"command": "x", "state": "failed"}, {"command": "z", "state": "cancelled", "reason": "stop"}]
    assert doc["tasks"]["b"] == {"dependencies": ["a"], "attempts": [{"command": "y", "state": "timed_out", "cancel_requested": "late"}]}
    assert doc["waits"] == {"q": {"state": "released", "payload": 1}} and doc["signals"] == {"s": {"v": 2}}
    assert doc["watches"] == {"w": {"task_id": "a", "attempt": 0, "target": "t", "max_deliveries": 3}}


def test_replay_guards(spark):
    op = lambda kind, **fields: {"kind": kind} | fields
    state, doc, rejected = replay(
        spark,
        op("add_task", task_id="a"), op("add_task", task_id="a"), op("add_task", task_id="b", dependencies=["a", "a"]), op("add_task", task_id="b", dependencies=["b"]), op("add_task", task_id="b", dependencies=["no"]),
        op("add_task", task_id="b", dependencies=["a"]), op("set_dependencies", task_id="a", dependencies=["b"]), op("dispatch", task_id="b"), op("dispatch", task_id="no"), op("new_attempt", task_id="a"),
        op("dispatch", task_id="a"), op("dispatch", task_id="a"), op("set_dependencies", task_id="a", dependencies=[]), op("wait", wait_id="q"), op("wait", wait_id="q"), op("release_wait", wait_id="no"), op("finish", state="done"),
        op("finish", state="failed"), op("signal", signal_id="s", payload=1), op("signal", signal_id="s", payload=1), op("settle", task_id="a"), op("signal", signal_id="x"), op("result", task_id="a", state="succeeded"), op("cancel", task_id="b", reason="r"),
        op("finish", state="cancelled"), op("release_wait", wait_id="q"), op("finish", state="cancelled"), op("signal", signal_id="y", payload=1),
    )
    assert state == "cancelled" and doc["tasks"]["b"]["attempts"][0]["state"] == "cancelled"
    assert rejected == {
        1: "task exists", 2: "duplicate or self dependency", 3: "duplicate or self dependency", 4: "unknown dependency", 6: "dependency cycle", 7: "dependencies have not settled", 8: "unknown task", 9: "current attempt is open",
        11: "not planned", 12: "dispatched before", 14: "wait exists", 15: "wait is not open", 16: "no terminal state", 17: "open tasks", 19: "signal exists", 20: "unknown kind", 21: "wrong fields", 24: "open waits", 27: "run is over",
    }


def availability(spark, **args):
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    got = reports.work_availability(
        frame([("m", "running"), ("n", "succeeded")], "run_id string, state string"),
        frame([("m", e) for e in "abcdefgh"], "run_id string, execution_id string"),
        frame([("a", "queued", "v1", 5.0, None), ("b", "queued", "v2", 5.0, None), ("c", "queued", "v1", 50.0, None), ("d", "leased", "v1", 0.0, 30.0), ("e", "running", "v1", 0.0, 9.0), ("f", "recovery_required", "v1", 0.0, None), ("g", "timed_out", "v1", 0.0, None), ("z", "queued", "v1", 0.0, None)], "execution_id string, state string, registry_revision string, next_attempt_at double, lease_expires_at double"),
        frame([("m", False), ("m", True)], "run_id string, delivered boolean"), frame([("g", "dead"), ("z", "pending")], "execution_id string, state string"),
        frame([("a", "performing"), ("b", "indeterminate"), ("c", "committed")], "execution_id string, state string"), frame([("m",)], "run_id string"), frame([("m", "open"), ("m", "released")], "run_id string, state string"),
        F.lit(10.0), **args,
    )
    return {r.run_id: r.asDict() for r in got.collect()}


def test_work_availability(spark):
    got = availability(spark, revisions=["v1"])
    m = got["m"]
    assert {k: m[k] for k in ("claimable_now", "queued_ready", "active_leases", "expired_leases", "retry_backoff", "recovery_required", "missing", "pending_commands", "pending_delivery", "unknown_effects", "tasks", "open_waits")} == {
        "claimable_now": 1, "queued_ready": 2, "active_leases": 1, "expired_leases": 1, "retry_backoff": 1, "recovery_required": 1, "missing": 1, "pending_commands": 1, "pending_delivery": 1, "unknown_effects": 2, "tasks": 1, "open_waits": 1,
    }
    assert m["pending_sync"] is None and m["next_retry"] == 50.0 and m["next_hint"] == 30.0 and not m["complete"]
    assert m["reasons"] == ["claimable_now", "binding_mismatch", "active_leases", "expired_leases_pending_reap", "retry_backoff", "pending_commands", "pending_result_sync", "pending_result_delivery", "application_wait", "recovery_required", "unknown_effects", "execution_not_observed"]
    assert got["n"]["reasons"] == ["terminal_run", "no_tasks"] and got["n"]["complete"] and got["n"]["pending_sync"] == 0
    unchecked = availability(spark)["m"]
    assert unchecked["claimable_now"] is None and unchecked["queued_ready"] == 2 and "binding_not_checked" in unchecked["reasons"]
    bound = availability(spark, revisions=["v1"], effect_scan_limit=2)
    assert bound["m"]["unknown_effects"] is None and "effect_scan_limit_exceeded" in bound["n"]["reasons"] and not bound["n"]["complete"]
    assert availability(spark, effect_scan_limit=3)["m"]["unknown_effects"] == 2 and "effects_not_checked" in availability(spark, effect_scan_limit=0)["n"]["reasons"]


def test_run_diagnostics(spark):
    tasks = spark.createDataFrame([("m", "t1", "a", []), ("m", "t2", "b", ["t1"]), ("m", "t3", "c", ["t1", "t2"]), ("m", "t4", "d", None), ("n", "t1", "x", [])], "run_id string, task_id string, execution_id string, dependencies array<string>")
    e = spark.createDataFrame([("a", "succeeded", 0.0, None), ("b", "queued", 50.0, None), ("c", "queued", 0.0, None), ("d", "leased", 0.0, 5.0)], "execution_id string, state string, next_attempt_at double, lease_expires_at double")
    waits = spark.createDataFrame([("m", "open")], "run_id string, state string")
    got = {(r.run_id, r.task_id): r for r in reports.run_diagnostics(tasks, e, waits, F.lit(10.0), task_limit=3, count_limit=3).collect()}
    assert {k: r.blocker for k, r in got.items()} == {("m", "t1"): None, ("m", "t2"): "retry_backoff", ("m", "t3"): "dependencies", ("n", "t1"): "execution_not_observed"}
    assert (got["m", "t1"].tasks, got["m", "t1"].tasks_at_least, got["m", "t1"].has_more, got["m", "t1"].open_waits, got["m", "t1"].settled) == (None, 3, True, 1, 1)
    assert (got["n", "t1"].tasks, got["n", "t1"].has_more) == (1, False) and got["m", "t3"].unmet == 1


def test_cancellation_evidence(spark):
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    # current attempts: a committed, b asked but not delivered, c never dispatched, d nobody knows, e sandboxes, f another generation's sandbox, g many effects
    tasks = [("m", t, 1, t, "running", t != "c", "stop" if t in "bc" else None) for t in "abcdefg"] + [("m", "a", 0, "old", "cancelled", True, "stop")]
    args = (
        frame([("a", True), ("a", True), ("b", True), ("b", False)], "execution_id string, delivered boolean"),
        frame([("a", 3, 1, 7, "cancelled", None), ("b", 1, 1, 7, "running", None), ("e", 1, 1, 7, "recovery_required", "cancelled"), ("f", 1, 1, 7, "leased", None), ("g", 1, 1, 7, "succeeded", None)], "execution_id string, revision long, attempt long, fence long, state string, recovery_target_state string"),
        frame([("a", "committed"), ("b", "prepared"), ("d", "committed")] + [("g", "committed")] * 101, "execution_id string, state string"),
        frame([("a", 1, "confirmed", None), ("b", 1, None, "process_cleanup"), ("d", 1, "confirmed", None), ("e", 2, "confirmed", None), ("e", 1, "pending", None), ("f", 1, "not_applicable", None), ("g", 1, "pending", "provider_cancel")], "execution_id string, receipt_id long, cleanup_state string, failed_phase string"),
        frame([("g",), ("f",)], "execution_id string"),
        frame([("e", 1, 7, True), ("e", 1, 7, False), ("f", 1, 6, True)], "execution_id string, attempt long, fence long, cleanup_confirmed boolean"),
    )
    tasks = frame(tasks, "run_id string, task_id string, attempt_index long, execution_id string, state string, dispatched boolean, cancel_reason string")
    got = {r.execution_id: r for r in reports.cancellation_evidence(tasks, *args).collect()}
    facts = {k: (r.request, r.delivery, r.authority, r.local, r.external, r.cleanup) for k, r in got.items()}
    assert facts == {
        "a": ("confirmed", "confirmed", "confirmed", "confirmed", "confirmed", "confirmed"),
        "b": ("confirmed", "pending", "pending", "failed", "unknown", "failed"),
        "c": ("confirmed", "not_applicable", "unknown", "not_applicable", "unknown", "not_applicable"),
        "d": ("unknown", "unknown", "unknown", "unknown", "unknown", "unknown"),
        "e": ("confirmed", "unknown", "confirmed", "confirmed", "not_applicable", "pending"),
        "f": ("confirmed", "unknown", "pending", "not_applicable", "not_applicable", "unknown"),
        "g": ("confirmed", "unknown", "confirmed", "confirmed", "unknown", "confirmed"),
    }
    assert {k: r.request_code for k, r in got.items()} == {
        "a": "kernel_cancel_committed", "b": "application_cancel_intent", "c": "application_cancel_intent", "d": "no_cancel_intent_observed",
        "e": "kernel_cancel_committed", "f": "runtime_request_persisted", "g": "runtime_request_persisted",
    }
    assert (got["g"].effects, got["g"].effects_truncated, got["g"].issues) == (100, True, ["cancellation_phase_failed:provider_cancel"])
    assert got["f"].issues == ["sandbox_evidence_other_generation"] and got["d"].receipts == 0 and got["a"].terminal is None
    every = {r.execution_id: r for r in reports.cancellation_evidence(tasks, *args, history=True).collect()}
    assert every.keys() == got.keys() | {"old"} and every["old"].terminal == "cancelled" and every["old"].request == "confirmed"
