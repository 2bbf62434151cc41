"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

Features are hashed unigrams and bigrams of words and of word shapes (character classes at both
ends, length, whether the word repeats the one before), as shares of the text's words.  Training
goes once over a bounded sample of labelled rows, one row after another, in a single task; scoring
is a sparse dot product per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Words, mix64, text_chunks

BITS = 18
SCALE = 24.0
#: Shares are taken of so many words more than there are: a few words say little, and the bias decides.
PRIOR_WORDS = 16
#: Labelled rows used for fitting, at most: those of the smallest hash of the id.
TRAIN_ROWS = 16_000
ALPHA, BETA, L1, L2 = 0.4, 1.0, 0.002, 0.5
CUTOFF = 0.7

# lower case, upper case, digits and bytes beyond ASCII are a class each, other bytes their own
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (four a word) of all words, and each word's place in it: row i are those of word i."""
    h, n = w.h, len(w.h)
    out = np.zeros((n, 4), np.int64)
    if not n:
        return out, w.at
    a, b = w.buf[w.starts], w.buf[w.ends - 1]
    a2, b2 = w.buf[np.minimum(w.starts + 1, w.ends - 1)], w.buf[np.maximum(w.ends - 2, w.starts)]
    size = np.minimum(np.log2(w.ends - w.starts).astype(np.uint64), np.uint64(4))
    before = np.zeros(n, np.uint64)
    before[1:] = h[:-1]
    first = np.zeros(n, bool)
    first[w.at[:-1][w.at[:-1] < n]] = True
    before[first] = 1
    shape = (((_CLASS[a] << np.uint64(8) | _CLASS[a2]) << np.uint64(8) | _CLASS[b2]) << np.uint64(8) | _CLASS[b]) << np.uint64(8) | size << np.uint64(1) | (h == before).astype(np.uint64)
    shape = mix64(shape + np.uint64(77))
    shape_before = np.zeros(n, np.uint64)
    shape_before[1:] = shape[:-1]
    shape_before[first] = 1
    rot = np.uint64(31)
    for k, x in enumerate((shape, shape ^ (shape_before << rot | shape_before >> np.uint64(33)), h, h ^ (before << rot | before >> np.uint64(33)))):
        out[:, k] = (mix64(x + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
    return out, w.at


def _sparse(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, c = np.unique(f.ravel(), return_counts=True)
    return u, (c * (SCALE / (len(f) + PRIOR_WORDS))).astype(np.float64)


def ftrl(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], offset: float = 0.0) -> np.ndarray:
    """Weights (the last one is the bias) after one pass of FTRL-proximal over (features, values, label).  The bias starts from offset, the log odds of the sample."""
    dim = 1 << BITS
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)
    solve = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for u, x, y in rows:
        u, x = np.append(u, dim), np.append(x, 1.0)
        w = solve(z[u], n[u])
        p = 1 / (1 + np.exp(-np.clip(w @ x + offset, -35, 35)))
        g = (p - y) * x
        z[u] += g - (np.sqrt(n[u] + g * g) - np.sqrt(n[u])) / ALPHA * w
        n[u] += g * g
    w = solve(z, n)
    w[dim] += offset
    return w.astype(np.float32)


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from at most `rows` labelled rows outside the held-out fold.  Rows of null id or label are left out; without any, all weights are 0."""
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("y"))
    # the sample has at most `rows` rows of two numbers, so it may be broadcast
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    seen = some.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("good")).first()
    offset = float(np.log((seen["good"] + 1) / (seen["n"] - seen["good"] + 1)))
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                f, at = features(Words(texts))
                made = [_sparse(f[a:b]) for a, b in zip(at[:-1], at[1:])]
                rest = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([rest.column("_id").cast(pa.int64()), rest.column("y"), pa.array([u.astype(np.int32).tobytes() for u, _ in made], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in made], pa.binary())], ["_id", "y", "u", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
            for b in batches:
                for u, x, y in zip(b.column("u"), b.column("x"), b.column("y").to_pylist()):
                    yield np.frombuffer(u.as_buffer(), np.int32).astype(np.int64), np.frombuffer(x.as_buffer(), np.float32).astype(np.float64), y

        yield pa.RecordBatch.from_arrays([pa.array([ftrl(rows_of(), offset).tobytes()], pa.binary())], ["w"])

    # one after another is how the method learns: one task, over a sample whose size is bounded
    made = picked.mapInArrow(vectors, "_id long, y int, u binary, x binary").repartition(1).sortWithinPartitions(F.xxhash64("_id", F.lit(3)), "_id", "y")
    got = made.mapInArrow(train, "w binary").collect()
    return np.frombuffer(bytes(got[0]["w"]), np.float32).copy() if got else np.zeros((1 << BITS) + 1, np.float32)


def scores(docs: DataFrame, weights: np.ndarray, text_col: str = "text", as_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1.  Null and empty texts have no features and get the bias's score."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    named = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)])
    text = f"_c{names.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            got = []
            for _, texts in text_chunks(batch, text):
                f, at = features(Words(texts))
                per_word = w[f].sum(1, dtype=np.float64)
                size = np.diff(at)
                # each text's words are summed by themselves, so that neighbours in a batch change no bit
                total, full = np.zeros(len(size)), size > 0
                if full.any():
                    total[full] = np.add.reduceat(per_word, at[:-1][full])
                got.append(total * SCALE / (size + PRIOR_WORDS) + w[-1])
            s = np.concatenate(got) if got else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], [*batch.schema.names, "_score"])

    types = dict(named.dtypes)
    out = named.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in named.columns) + ", _score double")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], F.col("_score").alias(as_col))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; the label, and all columns but the text, stay out of the score.

    Null, empty and blank texts get the bias's score; rows of null id are scored and in no fold; repeated
    rows are scored alike; without labelled rows all weights are 0; an empty table gives no rows.
    """
    w = fit(docs, labels, id_col, text_col)
    out = scores(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), w)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= CUTOFF, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier doesn't reject: those whose score (see classify) is at least CUTOFF."""
    names = docs.columns
    return scores(docs, fit(docs, labels, id_col, text_col), text_col, "_quality").where(F.col("_quality") >= CUTOFF).select(*names)
