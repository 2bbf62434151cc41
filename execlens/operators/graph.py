"""Graph operators by iterative joins: closures, cycles, chains, depths, readiness.

Each round is an equi join on node ids and is written to shared storage; rounds grow with the
longest path, or with its logarithm where paths are doubled.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FRONTIERS = 8


def written(df: DataFrame) -> DataFrame:
    """df on shared storage, its lineage cut."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="execlens-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): what the seeds reach over edges (src, dst), with the fewest steps; safe on cycles.

    Each round writes its frontier alone; what was seen is the union of the frontiers.
    """
    seen = frontier = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        # a plan of many frontiers is long to plan: they are written as one now and then
        seen = seen.unionByName(frontier) if depth % FRONTIERS else written(seen.unionByName(frontier))
    return seen


def reaches(edges: DataFrame, start: int, goal: int) -> bool:
    """Whether a new dependency start -> goal closes a cycle: goal reaches start."""
    seeds = edges.sparkSession.range(1).select(F.lit(goal).cast("long").alias("node"))
    return not closure(edges, seeds).where(F.col("node") == start).isEmpty()


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node): what is left after dropping, again and again, nodes without incoming or without outgoing edges."""
    e = written(edges.select("src", "dst").distinct())
    n = e.count()
    while n:
        e = written(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        m = e.count()
        if m == n:
            break
        n = m
    return e.select(F.col("src").alias("node")).distinct()


def transitive_closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of all paths, by doubling."""
    paths = written(edges.select("src", "dst").distinct())
    n = paths.count()
    while True:
        a, b = paths.alias("a"), paths.alias("b")
        paths = written(paths.unionByName(a.join(b, F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")).distinct())
        m = paths.count()
        if m == n:
            return paths
        n = m


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on a cycle: mutual reachability, named by the smallest member.  Only the cyclic core is closed."""
    core = cyclic_nodes(edges)
    inner = edges.join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi")
    p = transitive_closure(inner)
    mutual = p.join(p.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"])
    return mutual.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))


def chain_ends(links: DataFrame) -> DataFrame:
    """(start, direct, final, cyclic) of continuation links (previous, next), by pointer doubling; a cycle has no final successor."""
    jump = written(links.select(F.col("previous").alias("start"), F.col("next").alias("direct"), F.col("next").alias("at")))
    rounds = max(1, int(links.count()).bit_length() + 1)
    for _ in range(rounds):
        nxt = jump.select(F.col("start").alias("at"), F.col("at").alias("_to"))
        moved = written(jump.join(nxt, "at", "left").select("start", "direct", F.coalesce("_to", "at").alias("at"), F.col("_to").isNotNull().alias("moved")))
        still = moved.where("moved").limit(1).count()
        jump = moved.drop("moved")
        if not still:
            break
    ends = jump.join(links.select(F.col("previous").alias("at"), F.lit(True).alias("_on")), "at", "left")
    return ends.select("start", "direct", F.when(F.col("_on").isNull(), F.col("at")).alias("final"), F.col("_on").isNotNull().alias("cyclic"))


def depths(parents: DataFrame) -> DataFrame:
    """(node, depth) over (node, parent) with null parents at the roots, by doubling; nodes below a cycle are left out."""
    d = written(parents.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    for _ in range(max(1, int(d.count()).bit_length() + 1)):
        if d.where("up IS NOT NULL").isEmpty():
            break
        above = d.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        d = written(d.join(above, "up", "left").select("node", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
    return d.where("up IS NULL").select("node", "depth")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): longest path from a source of an acyclic graph; ordering by (level, node) is a topological order."""
    e = edges.select("src", "dst").distinct()
    left, level, out = written(nodes.select("node").distinct()), 0, None
    while not left.isEmpty():
        inner = e.join(left.withColumnRenamed("node", "src"), "src", "left_semi")
        free = written(left.join(inner.select(F.col("dst").alias("node")), "node", "left_anti"))
        if free.isEmpty():
            break  # a cycle is left
        now = free.withColumn("level", F.lit(level))
        out = now if out is None else out.unionByName(now)
        left, level = written(left.join(free, "node", "left_anti")), level + 1
    return out if out is not None else nodes.select("node").where("false").withColumn("level", F.lit(0))


def topological(tasks: DataFrame) -> DataFrame:
    """(run_id, position, task_id) over (run_id, task_id, dependencies): of all ready tasks the lexically least comes next.

    Exact heap order is sequential within a run, so each run is one group; a run's graph is small.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        needs = {t: {d for d in deps if d is not None} for t, deps in zip(pdf.task_id, pdf.dependencies)}
        users: dict[str, list[str]] = {}
        for t, deps in needs.items():
            for d in deps:
                users.setdefault(d, []).append(t)
        ready = [t for t, deps in needs.items() if not deps]
        heapq.heapify(ready)
        out = []
        while ready:
            t = heapq.heappop(ready)
            out.append(t)
            for u in users.get(t, ()):
                needs[u].discard(t)
                if not needs[u]:
                    heapq.heappush(ready, u)
        return pd.DataFrame({"run_id": pdf.run_id.iloc[0], "position": range(len(out)), "task_id": out})

    return tasks.groupBy("run_id").applyInPandas(order, "run_id string, position long, task_id string")


def unreachable(objects: DataFrame, references: DataFrame, roots: DataFrame) -> DataFrame:
    """Objects that no root reaches over references (src, dst)."""
    live = closure(references, roots.select("node"))
    return objects.join(live.select("node"), "node", "left_anti")


def ready(tasks: DataFrame, states: DataFrame, terminal: list[str]) -> DataFrame:
    """(task_id, ready): whether all predecessors (task_id, dependency) are terminal; one that is missing isn't."""
    j = tasks.join(states.select(F.col("task_id").alias("dependency"), "state"), "dependency", "left")
    return j.groupBy("task_id").agg(F.bool_and(F.coalesce(F.col("state").isin(terminal), F.lit(False))).alias("ready"))


def preview_impact(old: DataFrame, new: DataFrame, changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(task_id, reason) of a revision: changed, added or removed tasks and all that depend on them over edges (src, dst)."""
    from .dedup import declaration_changes

    direct = declaration_changes(old, new, "task_id", "declaration").select("task_id").unionByName(changed.select("task_id")).distinct()
    hit = closure(edges, direct.select(F.col("task_id").alias("node"))).select(F.col("node").alias("task_id"), "depth")
    return hit.select("task_id", F.when(F.col("depth") == 0, "changed").otherwise("downstream").alias("reason"))


