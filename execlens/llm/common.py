"""Helpers that the operators of this subpackage share: shared storage, grouped Arrow maps, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset, a temporary folder takes its place if driver and executors are one
    process, as in tests; on a cluster this is an error, since no other machine sees such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        got = sc._jsc.sc().getCheckpointDir()
        if got.isDefined():
            base = got.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            base = "file://" + tempfile.mkdtemp(prefix="execlens-")
            sc.setCheckpointDir(base)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base.rstrip('/')}/execlens-{uuid.uuid4().hex}"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run within have their shuffle files deleted when they end, instead of when the JVM next collects garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to shared storage and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    with dropping_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables whose rows have gone into later ones."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, about: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of rows with about, which has one row per key and in column n how many of rows hold it; total: rows at most.

    Keys of more than 1/HOT_KEYS of the total are fewer than HOT_KEYS, whatever the input's size, so
    their rows of about are broadcast; in the shuffle for all others they are spread by a salt that
    matches nothing (0 for what is joined, but no literal, which the optimizer would take out of the keys).
    """
    hot, more = F.col("n") > F.lit(total / HOT_KEYS), [c for c in about.columns if c not in on]
    some = about.where(hot).select(*on, *[F.col(c).alias(f"_h_{c}") for c in more])
    rest = about.where(~hot).select(*on, *[F.col(c).alias(f"_r_{c}") for c in more], F.least("n", F.lit(0)).cast("int").alias("_salt"))
    salted = rows.join(F.broadcast(some), on, "left").withColumn("_salt", F.when(F.col("_h_n").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20))).cast("int"))
    met = salted.join(rest, [*on, "_salt"], "left").where("_h_n IS NOT NULL OR _r_n IS NOT NULL")
    return met.select(*rows.columns, *[F.coalesce(f"_h_{c}", f"_r_{c}").alias(c) for c in more])


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, by: list[str] | None = None) -> DataFrame:
    """Apply fn to tables that each hold one or more whole groups of keys, in key order.

    Unlike a grouped map it hands over runs of groups, so that thousands of tiny groups are
    handled by one vectorised call.  A group is held in memory at once: callers bound its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            cut = 0
            last = [t.column(k)[t.num_rows - 1] for k in keys]
            # rows before the last key's first row in this batch end whole groups
            lo, hi = 0, t.num_rows - 1
            cols = [t.column(k) for k in keys]
            while lo < hi:
                mid = (lo + hi) // 2
                if all(c[mid] == v for c, v in zip(cols, last)):
                    hi = mid
                else:
                    lo = mid + 1
            cut = lo
            if cut:
                yield from fn(pa.concat_tables([*held, t.slice(0, cut)]).combine_chunks())
                held = [t.slice(cut)]
            elif held and not all(held[0].column(k)[0] == v for k, v in zip(keys, last)):
                yield from fn(pa.concat_tables(held).combine_chunks())
                held = [t]
            else:
                held.append(t)
        if held:
            yield from fn(pa.concat_tables(held).combine_chunks())

    # a set number, since the work of a group isn't in proportion to its bytes, by which small partitions would be joined
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *[F.col(k) for k in keys]).sortWithinPartitions(*keys, *(by or [])).mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list of longs: (node, component), component = smallest node.

    Alternating large-star and small-star steps (both keep connectivity and move edges to smaller
    nodes) until only stars are left; the rounds grow with the logarithm of the longest path.  Every
    step is an aggregate and a join, in which the edges of a hub stay spread over tasks; each round
    is written to shared storage.
    """
    spark = edges.sparkSession
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())

    def stars() -> tuple[int, bool]:
        """Number of edges, and whether each node is either a centre or joined to one centre only."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("child")).unionAll(e.select(F.col("v").alias("node"), F.lit(0).alias("child")))
        nodes = ends.groupBy("node").agg(F.sum("child").alias("c"), F.count("*").alias("n"))
        with dropping_shuffles(spark):
            r = nodes.agg(F.sum("c").alias("n"), F.max((F.col("c") > 1) | ((F.col("c") > 0) & (F.col("n") > F.col("c")))).alias("open")).first()
        return r["n"] or 0, not r["open"]

    while True:
        total, done = stars()
        if done:
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both, low, ["u"], 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, ["u"], total).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        before, e = e, materialize(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        release(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
