"""Embedding near-duplicates by cross-polytope hashing.

Vectors are rotated by fast Hadamard transforms with random signs; a hash is the axis (with sign)
nearest to the rotated vector, and a bucket key joins several hashes with the label.  Each vector
also goes to the buckets of its next best axes (multiprobe), where it meets those that live there.
Buckets hold sketches (a byte a component, and how far the sketch is off), which drop the pairs that
can't reach the threshold.  What is left forms clusters, whose members meet once more with their
vectors, block by block, where every pair is verified by its exact cosine.  Equal vectors of a
label are one class with a count, which is hashed and compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, deal, group_starts, index_pairs, join_labels
from .common import components, join_hot, map_groups, materialize, release
from .textops import mix64

TABLES, FUNCTIONS, PROBES, ROUNDS = 8, 2, 2, 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        a, b = y[:, :, 0].copy(), y[:, :, 1].copy()
        y[:, :, 0], y[:, :, 1] = a + b, a - b
        h *= 2
    return x


def hashes(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best axis, second best axis and the gap between them for each row."""
    n = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        y = hadamard(y * rng.choice([-1.0, 1.0], n)) / np.sqrt(n)
    both = np.concatenate([y, -y], 1)
    best = both.argmax(1)
    at = np.arange(len(x))
    top = both[at, best]
    both[at, best] = -np.inf
    second = both.argmax(1)
    return best, second, top - both[at, second]


def bucket_keys(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each row its keys: TABLES x (1 + PROBES).  Probes change the hash whose second axis is nearest, then the other."""
    keys = np.empty((len(x), TABLES, 1 + PROBES), np.uint64)
    for t in range(TABLES):
        h = [hashes(x, 1000 * t + f + 7) for f in range(FUNCTIONS)]
        order = np.argsort(np.stack([gap for _, _, gap in h]), axis=0)
        for p in range(1 + PROBES):
            k = mix64(mix64(label.astype(np.int64).view(np.uint64)) + np.uint64(t))
            for f in range(FUNCTIONS):
                axis = np.where(order[p - 1] == f, h[f][1], h[f][0]) if p else h[f][0]
                k = mix64(k ^ (axis.astype(np.uint64) + np.uint64(1 + (f << 20))))
            keys[:, t, p] = k
    return keys.reshape(len(x), -1)


def _rows(column) -> np.ndarray:
    """Vectors as rows.  Groups of several lengths may come together; zeros at the end change no cosine, and a group has one length."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = np.asarray(c.flatten(), np.float64), c.offsets.to_numpy()
    size = np.diff(at)
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(c), -1)
    out = np.zeros((len(c), int(size.max(initial=0))))
    out[np.repeat(np.arange(len(c)), size), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosine_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, for pairs of equal non-null label whose cosine is at least the threshold.

    Vectors that are null, zero, or hold null or non-finite components, and rows of null label link
    with nothing; vectors of unequal length don't meet; rows without an id are left out; rows of one
    id count as one vector (of unequal ones the least counts); an empty table gives no rows.
    """
    x = F.col("v")
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("long").alias("label")).where("vec_id IS NOT NULL")
    able = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(x, lambda e: e != 0)
    # ids with several rows, which narrow rows tell, keep their least one
    again = raw.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    least = raw.join(again, "vec_id").groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", "r.v", "r.label")
    rows = raw.join(again, "vec_id", "left_anti").unionByName(least).withColumn("able", able)
    # two hashes tell equal vectors of a label
    rows = materialize(rows.withColumn("a", F.xxhash64("label", "v")).withColumn("b", F.xxhash64(F.lit(29), "v", "label")))
    narrow = rows.where("able").select("vec_id", "a", "b")
    classes = narrow.groupBy("a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    good = materialize(classes.select("rep", F.col("n").alias("copies")).join(rows.where("able").select(F.col("vec_id").alias("rep"), "v", "label"), "rep"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column("v").offsets.to_numpy())
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                some = b.take(pa.array(at))
                # vectors of another length have other buckets
                k = bucket_keys(_unit(_rows(some.column("v"))), some.column("label").to_numpy().view(np.uint64) ^ mix64(np.full(len(at), d, np.uint64)))
                home = np.tile(np.arange(k.shape[1]) % (1 + PROBES) == 0, len(k))
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(np.repeat(some.column("rep").to_numpy(), k.shape[1])), pa.array(home)], ["key", "rep", "home"])

    keys = materialize(good.mapInArrow(keyed, "key long, rep long, home boolean"))
    # a bucket where nobody lives brings only visitors together
    full = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("lived_in")).where("n > 1 AND lived_in").drop("lived_in")
    met = join_hot(keys.select("key", "rep"), full, ["key"], keys.count())

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(_rows(b.column("v")))
            size = np.diff(b.column("v").offsets.to_numpy())
            step = np.abs(u).max(1) / 127
            s = np.rint(u / step[:, None]).astype(np.int8)
            off = np.sqrt(((u - s * step[:, None]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("label"), pa.array([x[:n].tobytes() for x, n in zip(s, size)], pa.binary()), pa.array(step), pa.array(off)], ["rep", "label", "s", "step", "off"])

    sketches = good.select("rep", "label", "v").mapInArrow(sketched, "rep long, label long, s binary, step double, off double")
    dealt = deal(met.join(sketches, "rep"), F.ceil(F.col("n") / BLOCK), "rep").select("key", "lo", "hi", "own", "rep", "label", "s", "step", "off")

    def near(t: pa.Table) -> Iterator[pa.RecordBatch]:
        lo, hi, own, ids, of, step, off = (t.column(c).to_numpy() for c in ("lo", "hi", "own", "rep", "label", "step", "off"))
        raw = t.column("s").to_pylist()
        size = np.array([len(x) for x in raw])
        u = np.zeros((len(raw), int(size.max())), np.float32)
        u[np.repeat(np.arange(len(raw)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join(raw), np.int8)
        label = np.arange(len(ids))
        for i, j in index_pairs(group_starts(t.column("key").to_numpy(), lo, hi), lo, hi, own):
            ok = (of[i] == of[j]) & (size[i] == size[j])
            i, j = i[ok], j[ok]
            # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|, and rounding
            least = threshold - off[i] - (1 + off[i]) * off[j] - 1e-4
            ok = np.einsum("ij,ij->i", u[i], u[j]) * step[i] * step[j] >= least
            label = join_labels(label, i[ok], j[ok])
        at = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]])], ["a", "b"])

    def verify(t: pa.Table) -> Iterator[pa.RecordBatch]:
        lo, hi, own, ids, of, copies = (t.column(c).to_numpy() for c in ("lo", "hi", "own", "rep", "label", "copies"))
        size = np.diff(t.column("v").combine_chunks().offsets.to_numpy())
        u = _unit(_rows(t.column("v")))
        label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for i, j in index_pairs(group_starts(t.column("component").to_numpy(), lo, hi), lo, hi, own):
            ok = (of[i] == of[j]) & (size[i] == size[j])
            i, j = i[ok], j[ok]
            ok = np.einsum("ij,ij->i", u[i], u[j]) >= threshold
            i, j = i[ok], j[ok]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label = join_labels(label, i, j)
        at = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(ids[label[at]])], ["rep", "links", "other"])

    clusters = materialize(components(map_groups(dealt, ["key", "lo", "hi"], near, "a long, b long")).select(F.col("node").alias("rep"), "component"))
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    within = deal(clusters.join(sizes, "component").join(good, "rep"), F.col("k"), "rep").select("component", "lo", "hi", "own", "rep", "copies", "label", "v")
    found = materialize(map_groups(within, ["component", "lo", "hi"], verify, "rep long, links long, other long"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    about = classes.join(groups, "rep", "left").join(counts, "rep", "left")
    about = materialize(about.select("a", "b", "n", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    release(keys, good, clusters, found)
    linked = join_hot(narrow, about, ["a", "b"], narrow.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
