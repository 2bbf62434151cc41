"""Record stores: Parquet table directories, immutable snapshots, and live SQLite files."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.aggs import logical_digest
from ..operators.checks import schema_difference


def read_table(spark: SparkSession, path: str, name: str, declared: StructType | None = None) -> DataFrame:
    """A table of a store directory; a declared schema must match exactly."""
    df = spark.read.parquet(f"{path}/{name}.parquet")
    if declared is not None and (found := schema_difference(df.schema, declared)):
        raise ValueError(f"{name}: " + "; ".join(found))
    return df


def export_table(df: DataFrame, path: str) -> None:
    """Consistent export that never overwrites."""
    df.write.mode("errorifexists").parquet(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write tables and a manifest of their logical digests; the manifest comes last, so that a snapshot without one is incomplete."""
    out = None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}.parquet")
        one = logical_digest(df.sparkSession.read.parquet(f"{path}/{name}.parquet")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    out.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return out


def verify_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(name, matches) for every table of the manifest."""
    listed = [json.loads(r.value) for r in spark.read.text(f"{path}/manifest").collect()]  # a row per table
    out = None
    for m in listed:
        one = logical_digest(spark.read.parquet(f"{path}/{m['name']}.parquet")).select(F.lit(m["name"]).alias("name"), (F.col("digest") == m["digest"]).alias("matches"))
        out = one if out is None else out.unionByName(one)
    return out


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class StoreReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", "1"))
        self.names = schema.names

    def partitions(self) -> list[_Range]:
        import sqlite3

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        import sqlite3

        columns = ", ".join(f'"{n}"' for n in self.names)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            c.execute("PRAGMA query_only = ON")
            yield from c.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))


class EventStore(DataSource):
    """format("eventstore"): a table of a SQLite file, read-only, split by row id.  The file must be on a path that executors share."""

    @classmethod
    def name(cls) -> str:
        return "eventstore"

    def schema(self) -> str:
        raise ValueError("declare a schema: stores are never inferred")

    def reader(self, schema: StructType) -> StoreReader:
        return StoreReader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: StructType | str, partitions: int = 1) -> DataFrame:
    spark.dataSource.register(EventStore)
    return spark.read.format("eventstore").schema(schema).option("table", table).option("partitions", str(partitions)).load(path)
