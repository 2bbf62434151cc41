import sqlite3

from pyspark.sql import functions as F

from execlens.sources import store
from execlens.streaming import operators as S


def test_drain_is_idempotent(spark, tmp_path):
    log = f"{tmp_path}/log"
    spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(50)], "sequence long, kind string").repartition(3).write.parquet(log)
    schema = spark.read.parquet(log).schema
    for _ in range(2):  # the second drain finds nothing new
        S.drain(S.log_stream(spark, log, schema), S.keyed_sink(f"{tmp_path}/out", ["sequence"]), f"{tmp_path}/cursor")
    spark.createDataFrame([(i, "c") for i in range(45, 60)], "sequence long, kind string").write.mode("append").parquet(log)
    S.drain(S.log_stream(spark, log, schema), S.keyed_sink(f"{tmp_path}/out", ["sequence"]), f"{tmp_path}/cursor")
    assert S.delivered(spark, f"{tmp_path}/out", ["sequence"]).count() == 60


def test_replays_are_dropped(spark, tmp_path):
    log = f"{tmp_path}/log"
    spark.createDataFrame([(i % 10, i) for i in range(30)], "id long, s long").select("id", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(log)
    out = S.replay_safe(S.log_stream(spark, log, spark.read.parquet(log).schema), ["id"], "at")
    S.drain(out, S.keyed_sink(f"{tmp_path}/out", ["id", "at"]), f"{tmp_path}/cursor")
    assert S.delivered(spark, f"{tmp_path}/out", ["id", "at"]).count() == 10


SAMPLES = [(1, float(t), p, 0) for t, p in [(0, 1), (10, 1), (20, 1), (30, 1), (40, 2), (50, 2), (60, None), (70, 2), (200, 2)]]


def test_stall_windows_batch_equals_stream(spark, tmp_path):
    df = spark.createDataFrame(SAMPLES, "execution_id long, at double, progress long, activity long")
    want = sorted(map(tuple, S.stall_batch(df, 10, 3, 100).collect()), key=str)
    labels = [(k, a, b, x) for _, k, a, b, x in sorted(want, key=lambda r: (r[2], str(r[3])))]
    assert ("episode", 30.0, None, "open") in labels and ("episode", 30.0, 40.0, "progress") in labels
    assert [x for k, _, _, x in labels if k == "window"] == ["stalled", "stalled", "stalled", "progress", "stalled", "unknown", "unknown"]
    df.coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = S.stall_stream(S.log_stream(spark, f"{tmp_path}/log", df.schema), 10, 3, 100)
    S.drain(stream, S.keyed_sink(f"{tmp_path}/out", ["execution_id", "kind", "started_at", "label"]), f"{tmp_path}/cursor")
    got = S.delivered(spark, f"{tmp_path}/out", ["execution_id", "kind", "started_at", "label"])
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_sqlite_store(spark, tmp_path):
    path = f"{tmp_path}/s.db"
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (id TEXT, n INTEGER, x REAL)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?)", [(f"r{i}", i, i / 2) for i in range(25)] + [(None, None, None)])
    df = store.read_sqlite(spark, path, "t", "id string, n long, x double", partitions=4)
    assert df.count() == 26 and df.agg(F.sum("n")).first()[0] == 300 and df.rdd.getNumPartitions() == 4


def test_snapshot(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    store.snapshot({"a": a, "b": a.where("k = 1")}, f"{tmp_path}/snap")
    assert sorted(map(tuple, store.verify_snapshot(spark, f"{tmp_path}/snap").collect())) == [("a", True), ("b", True)]
    a.where("k = 2").write.mode("overwrite").parquet(f"{tmp_path}/snap/b.parquet")
    assert ("b", False) in set(map(tuple, store.verify_snapshot(spark, f"{tmp_path}/snap").collect()))
