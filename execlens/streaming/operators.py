"""Structured Streaming forms of the log operators: bounded drains, deduplication, stall windows, idempotent sinks.

Each is a transformation of a stream, run with trigger(availableNow) for a bounded drain; the
checkpoint is the cursor.  Sinks are keyed by batch so that a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def log_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """A directory of Parquet files as an append-only log."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def replay_safe(stream: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """Drops replays of an event while its watermark still knows them."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, length: str, delay: str, keys: list[str]) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, length), *keys).agg(F.count("*").alias("n"))


class StallProcessor(StatefulProcessor):
    """Tumbling stall windows per policy and execution: baseline, consecutive stalls, episode.

    A window closes on the observed end of an interval; unknown samples clear the baseline and the
    count; progress ends an episode; an episode starts after so many stalled windows in a row.
    """

    def __init__(self, interval: float, consecutive: int, gap: float):
        self.interval, self.consecutive, self.gap = interval, consecutive, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stall", "started double, progress long, activity long, run int, episode double, last double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        s = self.state.get() if self.state.exists() else (None, None, None, 0, None, None)
        samples = pd.concat(list(rows)).sort_values("at")
        for at, progress, activity in samples[["at", "progress", "activity"]].itertuples(index=False):
            s = self.step(s, at, progress, activity, lambda *x: out.append((*key, *x)))
        self.state.update(s)
        yield pd.DataFrame(out, columns=["execution_id", "kind", "started_at", "ended_at", "label"])

    def step(self, s: tuple, at: float, progress: Any, activity: Any, emit: Callable) -> tuple:
        started, p0, a0, run, episode, last = s
        if pd.isna(progress) or pd.isna(activity) or (last is not None and at - last > self.gap):
            if started is not None:
                emit("window", started, at, "unknown")
            known = not (pd.isna(progress) or pd.isna(activity))
            return (at if known else None, int(progress) if known else None, int(activity) if known else None, 0, episode, at)
        if started is None:
            return (at, int(progress), int(activity), 0, episode, at)
        if progress != p0:
            emit("window", started, at, "progress")
            if episode is not None:
                emit("episode", episode, at, "progress")
            return (at, int(progress), int(activity), 0, None, at)
        if at - started < self.interval:
            return (started, p0, a0, run, episode, at)
        if activity != a0:
            emit("window", started, at, "activity")
            if episode is not None:
                emit("episode", episode, at, "activity")
            return (at, int(progress), int(activity), 0, None, at)
        emit("window", started, at, "stalled")
        run += 1
        if episode is None and run >= self.consecutive:
            episode = at  # an episode begins when it is found
            emit("episode", episode, None, "open")
        return (at, int(progress), int(activity), run, episode, at)

    def close(self) -> None:
        pass


STALL_SCHEMA = "execution_id long, kind string, started_at double, ended_at double, label string"


def stall_stream(samples: DataFrame, interval: float, consecutive: int, gap: float) -> DataFrame:
    """(execution_id, kind, started_at, ended_at, label) from samples (execution_id, at, progress, activity).  Needs the RocksDB state store."""
    return samples.groupBy("execution_id").transformWithStateInPandas(StallProcessor(interval, consecutive, gap), STALL_SCHEMA, "Append", "None")


def stall_batch(samples: DataFrame, interval: float, consecutive: int, gap: float) -> DataFrame:
    """The same over a finished log, one execution a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, out = StallProcessor(interval, consecutive, gap), []
        s = (None, None, None, 0, None, None)
        for at, progress, activity in pdf.sort_values("at")[["at", "progress", "activity"]].itertuples(index=False):
            s = p.step(s, at, progress, activity, lambda *x: out.append((int(pdf.execution_id.iloc[0]), *x)))
        return pd.DataFrame(out, columns=["execution_id", "kind", "started_at", "ended_at", "label"])

    return samples.groupBy("execution_id").applyInPandas(run, STALL_SCHEMA)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Deliver all that is available, then stop.  A failed batch is delivered again with the same id."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def keyed_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """At-least-once delivery into a table where each key counts once: a batch overwrites its own folder, and reads deduplicate."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return write


def delivered(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What a keyed sink holds, each key once."""
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/batch=*").drop("batch").dropDuplicates(keys)


def lag(high_water: DataFrame, cursors: DataFrame, key: str) -> DataFrame:
    """Subscriber lag: high water less cursor; a cursor before the expired part is stale."""
    return cursors.join(high_water, key).withColumn("lag", F.col("high_water") - F.col("cursor")).withColumn("stale", F.col("cursor") < F.col("expired_through"))
