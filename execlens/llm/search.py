"""Exact top-k inner product search with a pivot table.

Pivots are points along the main directions of a bounded sample, all at one distance R from the
origin.  The table holds every vector's distances to them, computed once.  The distances of two
vectors to all pivots bound their distance from below: that to pivot p gives the coordinate
c_p = (|x|^2 + R^2 - d_p^2) / 2R along its direction, and |x - y|^2 >= |c(x) - c(y)|^2 + (r(x) - r(y))^2
with r^2 = |x|^2 - |c|^2, the greatest lower bound that the table implies (each single pivot's is
weaker).  So x.y <= c(x).c(y) + r(x) r(y).

Candidates lie in cells, by their nearest pivot, which are cut into blocks; each lies in one block.
A query first visits its own block, which gives it a k-th score to beat, and then only blocks
of cells whose ranges of distances leave room for more.  In a block candidates are scored in the
order of their bound until none can beat the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_groups, materialize

#: The pivots' directions come from at most so many rows, those of the smallest hash.
SAMPLE = 4096
SHARE, MOST_PIVOTS = 0.75, 192
BLOCK, STEP, QUERIES = 16384, 256, 64
_TABLE = "vec_id long, dim int, cell int, d array<double>, v array<double>"


def quantize(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<double> of whole numbers): floor(scale * x).  Vectors that are null, or hold null or non-finite components, and rows without id are left out."""
    x = F.col("v")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    d = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(ok)
    return d.withColumn("v", F.transform("v", lambda e: F.floor(F.lit(float(scale)) * e).cast("double")))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(c.flatten(), dtype=np.float64).reshape(len(c), -1)


class Pivots:
    """Directions (orthonormal rows) and the distance from the origin at which the pivots lie along them."""

    def __init__(self, dim: int, sample: np.ndarray):
        count = min(MOST_PIVOTS, int(np.ceil(SHARE * dim)))
        values, vectors = np.linalg.eigh(sample.T @ sample if len(sample) else np.eye(dim))
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :count].T)
        self.radius = float(np.sqrt((sample * sample).sum(1).mean())) if len(sample) and sample.any() else 1.0

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + self.radius**2 - 2 * self.radius * (x @ self.axes.T), 0))

    def coordinates(self, square: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """c and r of vectors, from their squared lengths and their distances to the pivots."""
        c = (square[:, None] + self.radius**2 - d * d) / (2 * self.radius)
        return c, np.sqrt(np.maximum(square - (c * c).sum(1), 0))


def dots(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers with q, exactly."""
    if len(c) and np.abs(c).max() * np.abs(q).max() * len(q) >= 2**53:
        return c.astype(np.int64) @ q.astype(np.int64)
    return (c @ q).astype(np.int64)


def block_top_k(pivots: Pivots, qi: np.ndarray, q: np.ndarray, dq: np.ndarray, beat: np.ndarray, ci: np.ndarray, c: np.ndarray, dc: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query its k best candidates of the block that reach the score to beat, exactly: (query id, ids, scores, candidates scored)."""
    sq, sc = (q * q).sum(1), (c * c).sum(1)
    (aq, rq), (ac, rc) = pivots.coordinates(sq, dq), pivots.coordinates(sc, dc)
    for at in range(0, len(q), QUERIES):
        part = slice(at, at + QUERIES)
        # the slack covers the rounding of distances; scores themselves are whole numbers and exact
        bounds = aq[part] @ ac.T + rq[part][:, None] * rc + 1e-6 * (sq[part][:, None] + sc + pivots.radius**2) + 1
        for i, bound in zip(range(at, at + len(bounds)), bounds):
            open_ = np.flatnonzero((bound >= beat[i]) & (ci != qi[i]))
            open_ = open_[np.argsort(-bound[open_], kind="stable")]
            ids, scores, seen = np.empty(0, np.int64), np.empty(0, np.int64), 0
            while seen < len(open_) and (len(ids) < k or bound[open_[seen]] >= scores[-1]):
                some = open_[seen : seen + STEP]
                seen += len(some)
                ids, scores = np.concatenate([ids, ci[some]]), np.concatenate([scores, dots(c[some], q[i])])
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
            yield int(qi[i]), ids, scores, seen


def _visit(visits: DataFrame, pivots: dict[int, Pivots], k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best of each visit.  visits: the table's columns, sub, kind (0 candidate, 1 query) and beat.

    A block's candidates are held; queries pass by a batch at a time, however many they are.
    """
    keys = ["dim", "cell", "sub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        block: tuple | None = None
        ready: tuple | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            at = [t.column(c).to_numpy() for c in (*keys, "kind")]
            cuts = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in at], axis=0)])) if t.num_rows else []
            for x, y in zip(cuts, [*cuts[1:], t.num_rows]):
                *own, kind = (int(c[x]) for c in at)
                if tuple(own) != block:
                    block, held, ready = tuple(own), [], None
                some = t.slice(x, y - x)
                if kind == 0:
                    held.append(some)
                    continue
                if not held or not own[0]:
                    continue
                p = pivots.get(own[0]) or Pivots(own[0], np.empty((0, own[0])))
                if ready is None:
                    all_ = pa.concat_tables(held).combine_chunks()
                    ready = all_.column("vec_id").to_numpy(), _matrix(all_.column("v")), _matrix(all_.column("d"))
                got = list(block_top_k(p, some.column("vec_id").to_numpy(), _matrix(some.column("v")), _matrix(some.column("d")), some.column("beat").to_numpy(), *ready, k))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]).astype(np.int64)), pa.array(np.concatenate([g[1] for g in got])), pa.array(np.concatenate([g[2] for g in got]))], ["query_id", "vec_id", "score"])

    parts = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return visits.repartition(parts, *keys).sortWithinPartitions(*keys, "kind", "vec_id").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products per query.

    vectors and queries are (vec_id, v) from quantize; a query's own id is no candidate.  Ties go to
    the smaller id; fewer than k candidates give fewer rows; vectors of another dimension than the
    query's don't meet it; equal rows count once; empty vectors meet nothing; an empty table gives no rows.
    A sample of SAMPLE rows and ranges per cell (at most MOST_PIVOTS a dimension) reach the driver.
    """
    v = materialize(vectors.dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v")))
    sample: dict[int, list] = {}
    for r in v.where("dim > 0").orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", "v").limit(SAMPLE).select("dim", "v").collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    pivots = {dim: Pivots(dim, np.array(x)) for dim, x in sample.items()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims[dims > 0]).tolist():
                some = b.filter(pa.array(dims == dim))
                p = pivots.get(dim) or Pivots(dim, np.empty((0, dim)))
                d = p.distances(_matrix(some.column("v")))
                lists = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), d.ravel())
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("dim"), pa.array(d.argmin(1).astype(np.int32)), lists, some.column("v")], ["vec_id", "dim", "cell", "d", "v"])

    table = materialize(v.mapInArrow(measure, _TABLE))
    ranges = _ranges(table)
    sizes = ranges.select("dim", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("subs"))
    place = F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int")
    found = table.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("sub", place).drop("subs")
    # candidates come by block, whose rows differ little in number
    candidates = found.withColumn("kind", F.lit(0)).withColumn("beat", F.lit(0).cast("long"))
    asked = materialize(table.join(queries.select("vec_id").distinct(), "vec_id"))
    lowest = F.lit(-(2**63)).cast("long")
    own = asked.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("sub", place).drop("subs").withColumn("kind", F.lit(1)).withColumn("beat", lowest)
    first = materialize(_visit(candidates.unionByName(own.select(candidates.columns)), pivots, k))
    beat = first.groupBy("query_id").agg(F.min("score").alias("beat"), F.count("*").alias("found"))
    beat = beat.select(F.col("query_id").alias("vec_id"), F.when(F.col("found") >= k, F.col("beat")).otherwise(lowest).alias("beat"))
    cells = {(r["dim"], r["cell"]): (r["subs"], np.array(r["lo"]), np.array(r["hi"]), r["most"]) for r in ranges.withColumn("subs", F.ceil(F.col("n") / BLOCK)).collect()}

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block that a query has to visit, but its own."""
        for b in batches:
            for i, (dim, cell, d, x, score, sub) in enumerate(zip(*[b.column(c).to_pylist() for c in ("dim", "cell", "d", "v", "beat", "sub")])):
                d, square = np.array(d), float(np.dot(x, x))
                to = []
                for (other, c), (subs, lo, hi, most) in cells.items():
                    if other != dim:
                        continue
                    apart = float(np.maximum(np.maximum(lo - d, d - hi), 0).max())
                    if (square + most - apart * apart) / 2 + 1e-6 * (square + most) + 1 >= score:
                        to += [(c, s) for s in range(subs) if (c, s) != (cell, sub)]
                if to:
                    one = b.slice(i, 1).take(pa.array([0] * len(to)))
                    arrays = {n: one.column(n) for n in one.schema.names} | {"cell": pa.array([c for c, _ in to], pa.int32()), "sub": pa.array([s for _, s in to], pa.int32())}
                    yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    again = asked.join(beat, "vec_id", "left").withColumn("beat", F.coalesce("beat", lowest)).join(F.broadcast(sizes), ["dim", "cell"]).withColumn("sub", place)
    again = again.select("vec_id", "dim", "cell", "d", "v", "beat", "sub").mapInArrow(targets, _TABLE + ", beat long, sub int").withColumn("kind", F.lit(1))
    second = _visit(candidates.unionByName(again.select(candidates.columns)), pivots, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionAll(second).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ranges(table: DataFrame) -> DataFrame:
    """(dim, cell, n, lo, hi, most): rows, ranges of distances to each pivot, and greatest squared length; a row per cell."""
    schema = "dim int, cell int, n long, lo array<double>, hi array<double>, most double"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            rows = []
            for dim in np.unique(dims).tolist():
                some = b.filter(pa.array(dims == dim))
                d, x, cell = _matrix(some.column("d")), _matrix(some.column("v")), some.column("cell").to_numpy()
                square = (x * x).sum(1)
                for c in np.unique(cell).tolist():
                    own = cell == c
                    rows.append({"dim": dim, "cell": c, "n": int(own.sum()), "lo": d[own].min(0).tolist(), "hi": d[own].max(0).tolist(), "most": float(square[own].max())})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("most", pa.float64())]))

    def total(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple, dict] = {}
        for r in t.to_pylist():
            got = rows.setdefault((r["dim"], r["cell"]), r)
            if got is not r:
                got["n"] += r["n"]
                got["lo"], got["hi"], got["most"] = list(map(min, got["lo"], r["lo"])), list(map(max, got["hi"], r["hi"])), max(got["most"], r["most"])
        yield pa.RecordBatch.from_pylist(list(rows.values()), t.schema)

    return materialize(map_groups(table.mapInArrow(partial, schema), ["dim", "cell"], total, schema))
