"""N-gram Jaccard join with Bayesian candidate pruning.

Texts of one shingle set form a class.  MinHash banding gives buckets of classes; within buckets the
MinHash values of two classes are compared a few at a time, and a pair is dropped once the
posterior probability that its Jaccard similarity reaches the threshold falls below a tolerance.
What is left forms candidate clusters; each cluster's members meet once more with their shingle
sets, block by block, and every pair that isn't pruned is verified exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, lgamma, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, deal, group_starts, index_pairs, join_labels
from .common import components, join_hot, map_groups, materialize, release
from .textops import Words, mix64, text_chunks

SHINGLE, THRESHOLD = 5, 0.8
STEP, TOLERANCE = 16, 1e-6
BLOCK_SHINGLES = 1 << 20
MAX_HASHES = 256
_rng = np.random.default_rng(41)
_MUL = (_rng.integers(0, 1 << 31, MAX_HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, MAX_HASHES, dtype=np.uint32)


class Bands(NamedTuple):
    """A banding: a pair of similarity s meets in a band with probability 1 - (1 - s ** rows) ** bands."""

    bands: int
    rows: int

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands


def tuned_bands(threshold: float, recall: float, rows: int) -> Bands:
    """The fewest bands of so many rows that find a pair at the threshold with at least the probability recall."""
    return Bands(ceil(log(1 - recall) / log(1 - threshold**rows)), rows)


#: Missed at the threshold: 3e-5.
DOCUMENTS = Bands(20, 4)


def minhashes(sets: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values (one row per set) of shingle sets that lie end to end; no set is empty."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), hashes), np.uint32)
    for k in range(hashes):
        y = x * _MUL[k]
        y += _ADD[k]
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def posterior(matches: int, n: int, threshold: float) -> float:
    """P(J >= threshold) after matches of n MinHash values, from a uniform prior: a beta tail, as a binomial sum."""
    log = lambda k: lgamma(n + 2) - lgamma(k + 1) - lgamma(n + 2 - k) + k * np.log(threshold) + (n + 1 - k) * np.log1p(-threshold)
    return float(np.exp([log(k) for k in range(matches + 1)]).sum())


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = DOCUMENTS.hashes) -> dict[int, int]:
    """After each step's number of values, the fewest matches that keep a pair."""
    steps = [*range(STEP, hashes, STEP), hashes]
    return {n: next(m for m in range(n + 1) if posterior(m, n, threshold) >= tolerance) for n in steps}


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Which pairs outlast the comparison of their MinHash values, a step at a time."""
    alive, at = np.arange(len(i)), 0
    m = np.zeros(len(i), np.int16)
    for upto, least in need.items():
        m[alive] += (sig[i[alive], at:upto] == sig[j[alive], at:upto]).sum(1).astype(np.int16)
        alive, at = alive[m[alive] >= least], upto
    out = np.zeros(len(i), bool)
    out[alive] = True
    return out


Parts = Callable[[pa.RecordBatch], Iterator[tuple[list[pa.Array], list[bytes]]]]


def whole_texts(batch: pa.RecordBatch) -> Iterator[tuple[list[pa.Array], list[bytes]]]:
    """Ids and texts of (doc_id, text), a few at a time."""
    for part, texts in text_chunks(batch):
        yield [batch.column("doc_id").slice(part.start, part.stop - part.start)], texts


def signatures(docs: DataFrame, ids: dict[str, str], plan: Bands, parts: Parts) -> DataFrame:
    """(ids, lo, hi, size, sig) of each text: two hashes of its shingle set, its size and MinHash values; size 0 where it has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in parts(batch):
                sets = list(Words(texts).sets(SHINGLE))
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                lo, hi, sig = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), np.zeros((len(sets), plan.hashes), np.uint32)
                if len(full):
                    flat = np.concatenate(sets)
                    starts = (np.cumsum(size) - size)[full]
                    lo[full], hi[full] = np.add.reduceat(mix64(flat), starts), np.bitwise_xor.reduceat(_second(flat), starts)
                    sig[full] = minhashes(flat, starts, plan.hashes)
                yield pa.RecordBatch.from_arrays([*own, pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), pa.array(size), _binary(sig)], [*ids, "lo", "hi", "size", "sig"])

    return docs.mapInArrow(run, _schema(ids) + ", lo long, hi long, size long, sig binary")


def _schema(ids: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in ids.items())


def _texts(docs: DataFrame, ids: dict[str, str], parts: Parts) -> DataFrame:
    """(ids, text)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in parts(batch):
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.binary())], [*ids, "text"])

    return docs.select(*ids, "text") if parts is whole_texts else docs.mapInArrow(run, _schema(ids) + ", text binary")


def _second(shingles: np.ndarray) -> np.ndarray:
    return mix64(shingles * np.uint64(0x9FB21C651E98DF25))


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, (len(raw) + 1) * width, width, dtype=np.int32)), pa.py_buffer(raw)]) if width * len(raw) < 1 << 31 else pa.array([r.tobytes() for r in raw], pa.binary())


def _fixed(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def band_keys(sig: np.ndarray, plan: Bands) -> np.ndarray:
    """One 64-bit key per set and band."""
    out = np.empty((len(sig), plan.bands), np.uint64)
    for b in range(plan.bands):
        k = np.full(len(sig), b + 1, np.uint64)
        for r in range(plan.rows):
            k = mix64(k * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, b * plan.rows + r].astype(np.uint64))
        out[:, b] = k
    return out


def candidate_edges(classes: DataFrame, need: dict[int, int], plan: Bands) -> DataFrame:
    """(a, b): edges that connect what banding and pruning leave together; no more than a row per member and task."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = band_keys(_fixed(b.column("sig"), np.uint32, plan.hashes), plan)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(np.repeat(b.column("rep").to_numpy(), plan.bands))], ["key", "rep"])

    rows = classes.select("rep", "sig").mapInArrow(bands, "key long, rep long")
    full = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(full, "key").join(classes.select("rep", "sig"), "rep")
    dealt = deal(met, F.ceil(F.col("n") / BLOCK), "rep").select("key", "lo", "hi", "own", "rep", "sig")

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        lo, hi, own, rep = (t.column(c).to_numpy() for c in ("lo", "hi", "own", "rep"))
        sig = _fixed(t.column("sig"), np.uint32, plan.hashes)
        label = np.arange(len(rep))
        for i, j in index_pairs(group_starts(t.column("key").to_numpy(), lo, hi), lo, hi, own):
            ok = prune(sig, i, j, need)
            label = join_labels(label, i[ok], j[ok])
        at = np.flatnonzero(label != np.arange(len(rep)))
        yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[label[at]])], ["a", "b"])

    return map_groups(dealt, ["key", "lo", "hi"], compare, "a long, b long").where("a <> b")


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of intersections of sorted sets.  Many pairs of few sets are counted as a product of 0/1 matrices, over shared shingles only."""
    if len(i) < 4 * len(sets):
        return np.array([np.isin(sets[a], sets[b], assume_unique=True, kind="sort").sum() if len(sets[a]) <= len(sets[b]) else np.isin(sets[b], sets[a], assume_unique=True, kind="sort").sum() for a, b in zip(i.tolist(), j.tolist())], np.int64)
    used = np.unique(np.concatenate([i, j]))
    flat = np.concatenate([sets[x] for x in used])
    row = np.repeat(np.arange(len(used)), [len(sets[x]) for x in used])
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    keep = n[col] > 1
    col, row = col[keep], row[keep]
    _, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    both = np.zeros((len(used), len(used)), np.float32)
    step = max(256, (1 << 22) // max(len(used), 1))
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        x, y = np.searchsorted(col, [a, a + step])
        m = np.zeros((len(used), step), np.float32)
        m[row[x:y], col[x:y] - a] = 1
        both += m @ m.T
    place = np.zeros(int(used.max()) + 1, np.int64)
    place[used] = np.arange(len(used))
    return both[place[i], place[j]].astype(np.int64)


def similar_groups(docs: DataFrame, ids: dict[str, str], threshold: float = THRESHOLD, plan: Bands = DOCUMENTS, parts: Parts = whole_texts) -> DataFrame:
    """(ids, least: struct of ids, n_links) per text: the least ids that links reach, and the other texts linked directly.

    docs is (doc_id, text) without null ids; parts gives the texts to compare and their ids, whose types
    are named in ids and which needn't be unique.  Texts are linked when the Jaccard similarity of their
    shingle sets is at least the threshold.
    """
    need = needed(threshold, hashes=plan.hashes)
    sets = ["lo", "hi", "size"]
    # a number of its own for every row: tables once written keep it
    sigs = materialize(signatures(docs, ids, plan, parts).withColumn("node", F.monotonically_increasing_id()))
    with_words = sigs.where("size > 0")
    classes = materialize(with_words.groupBy(*sets).agg(F.min("node").alias("rep"), F.min(F.struct(*ids)).alias("own"), F.count("*").alias("n"), F.first("sig").alias("sig")))
    clusters = components(candidate_edges(classes, need, plan)).select(F.col("node").alias("rep"), "component")
    members = materialize(clusters.join(classes, "rep"))
    weight = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("k"))
    # one row per class with its text, even if its ids occur in several rows
    named = members.select(*[F.col(f"own.{c}").alias(c) for c in ids], *[F.col(c).alias(f"_{c}") for c in sets], "component", "rep", F.col("n").alias("copies"), "sig")
    texts = _texts(docs, ids, parts).join(named, [*ids])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in text_chunks(batch):
                rest = batch.slice(part.start, part.stop - part.start)
                own = list(Words(some).sets(SHINGLE))
                lo, hi = (rest.column(c).to_numpy().view(np.uint64) for c in ("_lo", "_hi"))
                same = [len(s) == n and mix64(s).sum() == a and np.bitwise_xor.reduce(_second(s)) == b for s, n, a, b in zip(own, rest.column("_size").to_pylist(), lo, hi)]
                out = rest.select(["component", "rep", "copies", "sig"]).append_column("shingles", pa.array([s.tobytes() for s in own], pa.binary()))
                yield out.filter(pa.array(same))

    made = texts.select("text", *[f"_{c}" for c in sets], "component", "rep", "copies", "sig").mapInArrow(shingled, "component long, rep long, copies long, sig binary, shingles binary")
    dealt = deal(made.join(weight, "component"), F.col("k"), "rep").select("component", "lo", "hi", "own", "rep", "copies", "sig", "shingles")

    def verify(t: pa.Table) -> Iterator[pa.RecordBatch]:
        # a class comes twice where a row is repeated with its id
        first = np.unique(np.stack([t.column(c).to_numpy() for c in ("component", "lo", "hi", "rep")]), axis=1, return_index=True)[1]
        if len(first) < t.num_rows:
            t = t.take(pa.array(np.sort(first)))
        lo, hi, own, rep, copies = (t.column(c).to_numpy() for c in ("lo", "hi", "own", "rep", "copies"))
        sig = _fixed(t.column("sig"), np.uint32, plan.hashes)
        starts = group_starts(t.column("component").to_numpy(), lo, hi)
        raw = t.column("shingles").combine_chunks()
        own_sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]
        size = np.array([len(s) for s in own_sets], np.int64)
        label, links = np.arange(len(rep)), np.zeros(len(rep), np.int64)
        for i, j in index_pairs(starts, lo, hi, own):
            ok = prune(sig, i, j, need) & (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]))
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            both = _overlaps(own_sets, i, j)
            ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[ok], j[ok]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label = join_labels(label, i, j)
        at = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(links[at]), pa.array(rep[label[at]])], ["rep", "links", "other"])

    found = materialize(map_groups(dealt, ["component", "lo", "hi"], verify, "rep long, links long, other long"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # only classes in a group have more to say than their own rows
    linked = materialize(groups.join(links, "rep").join(members.select("rep", "own"), "rep"))
    least = linked.groupBy("group").agg(F.min("own").alias("least"), F.count("*").alias("n"))
    of_group = join_hot(linked.select("rep", "links", "group"), least, ["group"], linked.count()).select("rep", "links", "least")
    about = materialize(classes.select(*sets, "rep", "n", "own").join(of_group, "rep", "left").select(*sets, "n", F.coalesce("least", "own").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    release(classes, members, found, linked)
    plain = with_words.select(*ids, *sets)
    out = join_hot(plain, about, sets, sigs.count()).select(*ids, "least", "n_links")
    return out.unionByName(sigs.where("size = 0").select(*ids, F.struct(*ids).alias("least"), F.lit(0).cast("long").alias("n_links")))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, class_id (smallest id reachable over links), n_links (other rows linked directly), kept (doc_id = class_id).

    Two rows are linked when the sets of their five-word shingles have a Jaccard similarity of at least the
    threshold; words are what lies between white space.  A text of fewer than five words has one
    shingle, all its words.  Null, empty and blank texts link with nothing; rows without an id are
    left out; repeated rows count as copies; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    got = similar_groups(source, {"doc_id": "long"}, threshold)
    return got.select("doc_id", F.col("least.doc_id").alias("class_id"), "n_links").withColumn("kept", F.col("doc_id") == F.col("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those whose text is linked to one of a smaller id; of rows with equal id and text one stays, rows without an id all do.

    Null, empty and blank texts link with nothing, so all of them stay, once for each id; an empty table gives no rows.
    """
    gone = jaccard_links(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    with_id = docs.where(F.col(id_col).isNotNull()).join(gone, id_col, "left_anti")
    # where ids are repeated, which narrow rows tell, the texts of those ids meet once more
    again = docs.groupBy(F.col(id_col)).agg(F.count("*").alias("_n")).where(F.col(id_col).isNotNull() & (F.col("_n") > 1)).select(id_col)
    once = with_id.join(again, id_col, "left_anti").select(*docs.columns)
    twice = with_id.join(again, id_col).withColumn("_text", F.xxhash64(text_col)).dropDuplicates([id_col, "_text"]).select(*docs.columns)
    return once.unionByName(twice).unionByName(docs.where(F.col(id_col).isNull()))
