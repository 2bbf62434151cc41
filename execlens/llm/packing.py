"""Best-fit packing of documents into sequences of bounded length.

The plan is made on the histogram of piece lengths, whose size is bounded by the capacity, and not
on the pieces: lengths above a third of the capacity are matched greedily, at most two a sequence
(the longest with the longest that fits), smaller ones then fill the best-fitting gaps.  Each piece
finds its place in the plan by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .textops import text_chunks
from .tokens import encoder

EOS = 2
CELL = 1 << 16


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences that hold counts[length] pieces of each length: (lengths, how many such sequences)."""
    left = {n: c for n, c in counts.items() if c}
    third = capacity // 3
    large = sorted(n for n in left if n > third)
    gaps: dict[int, list[list]] = defaultdict(list)  # gap: [lengths, how many]
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        if gap:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append([lengths, n])
        else:
            done.append((lengths, n))

    open_gaps: list[int] = []
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1
        if i < 0:
            put((a,), left.pop(a))
            large.pop()
            continue
        b = large[i]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if not n:  # one piece of this length is left, and itself is its best partner
            other = large[i - 1] if i else None
            if other is None:
                put((a,), left.pop(a))
                large.pop()
                continue
            b, n = other, 1
        put((a, b), n)
        for x in (a, b):
            left[x] -= n
        for x in {a, b}:
            if not left[x]:
                del left[x]
                large.remove(x)
    for s in sorted((n for n in left if n <= third), reverse=True):
        c = left[s]
        while c:
            i = bisect_left(open_gaps, s)
            if i == len(open_gaps):  # no gap is wide enough: new sequences
                fit = capacity // s
                n, rest = divmod(c, fit)
                if n:
                    put((s,) * fit, n)
                if rest:
                    put((s,) * rest, 1)
                break
            gap = open_gaps[i]
            lengths, n = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(i)
            fit = gap // s
            full, rest = divmod(c, fit)
            if full >= n:
                put(lengths + (s,) * fit, n)
                c -= n * fit
            else:
                if full:
                    put(lengths + (s,) * fit, full)
                if rest:
                    put(lengths + (s,) * rest, 1)
                keep = n - full - (1 if rest else 0)
                if keep:
                    put(lengths, keep)
                c = 0
    done += [(tuple(lengths), n) for group in gaps.values() for lengths, n in group]
    return done


def layout(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length the slots in order of rank, as rows (first rank, first sequence, slots' offset, sequences).

    Ranks first .. first + sequences - 1 lie in that many consecutive sequences at one offset.
    """
    used: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    sequence = 0
    for lengths, n in patterns:
        at = 0
        for x in lengths:
            rows[x].append((used[x], sequence, at, n))
            used[x] += n
            at += x
        sequence += n
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole, or capacity-long pieces after a first that may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, length, capacity))]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([EOS], "<u4")
        for batch in batches:
            for part, texts in text_chunks(batch):
                rows = []
                for doc, text in zip(batch.column("doc_id")[part.start : part.stop].to_pylist(), texts):
                    ids = np.concatenate([enc.ids(text.decode("utf-8", "replace")), end])
                    for i, (a, n) in enumerate(cut(len(ids), capacity)):
                        raw = ids[a : a + n].tobytes()
                        rows.append((doc, i, a, n, zlib.crc32(raw), raw))
                cols = list(zip(*rows))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(cols[5], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    A null or empty text is its end id alone; a null id stays null; equal rows are packed as often
    as they occur; an empty table gives no rows.  Only counts per length (capacity numbers) are
    gathered.  Full pieces are sequences of their own and need no place among others; the rank of any
    other is its place among the pieces of its length in its cell, by a hash of the id, and cells are
    as many as the pieces of a length need at CELL a cell.
    """
    p = materialize(pieces(docs, id_col, text_col, capacity, tokenizer, with_ids))
    counts = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = counts.pop(capacity, 0)
    patterns = pack_histogram(counts, capacity)
    slots, used = layout(patterns), sum(n for _, n in patterns)
    cells = F.create_map(*[F.lit(x) for n, c in ({0: 1} | counts).items() for x in (int(n), -(-c // CELL))])
    some = p.where(F.col("length") < capacity).withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), cells[F.col("length").cast("int")]).cast("int"))
    of_cell = some.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_cell.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece"))).join(starts, ["length", "cell"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("first")).drop("cell", "first")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                t = slots[int(n)]
                i = np.searchsorted(t[:, 0], rank[at], "right") - 1
                seq[at], off[at] = t[i, 1] + rank[at] - t[i, 0], t[i, 2]
            keep = [x for x in b.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in keep], pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    names = [c for c in ranked.columns if c != "rank"]
    types = dict(ranked.dtypes)
    placed = ranked.mapInArrow(place, ", ".join(f"{c} {types[c]}" for c in names) + ", sequence_id long, offset long")
    if not full:
        return placed
    # any numbers do that no other sequence has: those of rows are unique in a written table
    alone = p.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() + used).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(alone)
