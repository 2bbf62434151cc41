"""Removal of passages that repeat across documents: paragraph MinHash banding, and repeated windows of words.

Paragraphs are the lines of a text that hold at least MIN_WORDS words.  Their five-word shingle sets
meet by MinHash bands whose number is tuned to a recall at the threshold; colliding paragraphs are
verified by exact Jaccard similarity, verified links are joined to components, and all paragraphs of
a component but those of its earliest document are removed.

A repeated passage may also begin and end anywhere within lines.  So every run of MIN_WORDS words (a
window) that an earlier document holds is removed, too.  A window is filed under its key, the
smallest hash of the runs of KEY_WORDS words in it, which all its holders share wherever it stands;
neighbouring windows of one key make up a span.  Equal spans are told by one hash, so that only
spans that share a key without being equal, at the ends of passages, list their windows one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_hot, materialize, release
from .neardup import THRESHOLD, similar_groups, tuned_bands
from .textops import Words, mix64, text_chunks, word_bounds

MIN_WORDS, KEY_WORDS = 50, 24
#: Bands for lines: found at the threshold with at least this probability.
RECALL = 0.99
PARAGRAPHS = tuned_bands(THRESHOLD, RECALL, rows=4)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """64-bit hashes of any runs of words of a batch, each from two sums."""

    def __init__(self, h: np.ndarray):
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix64(h) * powers(np.uint64(_BASE), len(h))[: len(h)], out=self.sums[1:])
        self.back = powers(_INVERSE, len(h) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.back[start])


def spans_of(r: Rolling, a: int, b: int) -> tuple[np.ndarray, ...]:
    """Spans of the text of words a to b: key, span hash, first and last window start (counted from a), windows a turn.

    Neighbouring spans that are equal, as in texts that repeat a phrase, are one row of several turns.
    """
    n = b - a - MIN_WORDS + 1
    if n < 1:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    at = np.arange(a, b - KEY_WORDS + 1)
    k = r.of(at, at + KEY_WORDS)
    place = np.lib.stride_tricks.sliding_window_view(k, MIN_WORDS - KEY_WORDS + 1).argmin(1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], n) - 1
    key = k[place[first]]
    turn = last - first + 1
    span = mix64(r.of(a + first, a + last + MIN_WORDS) ^ mix64(((place[first] - first) << 16 | turn).astype(np.uint64)))
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (span[1:] != span[:-1])]))
    return key[new].view(np.int64), span[new].view(np.int64), first[new], last[np.append(new[1:], len(first)) - 1], turn[new]


def spans(docs: DataFrame) -> DataFrame:
    """(key, span, doc_id, first, last, turn) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                w = Words(texts)
                r = Rolling(w.h)
                got = [spans_of(r, a, b) for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist())]
                key, span, first, last, turn = (np.concatenate(x) for x in zip(*got))
                ids = batch.column("doc_id").slice(part.start, part.stop - part.start).to_numpy()
                doc = np.repeat(ids, [len(g[0]) for g in got])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(span), pa.array(doc), *[pa.array(x.astype(np.int32)) for x in (first, last, turn)]], ["key", "span", "doc_id", "first", "last", "turn"])

    return docs.mapInArrow(run, "key long, span long, doc_id long, first int, last int, turn int")


def windows(listed: DataFrame) -> DataFrame:
    """(h, doc_id, start): a hash of every window from first to last of the spans in column at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                w = Words(texts)
                r = Rolling(w.h)
                at = batch.column("at").slice(part.start, part.stop - part.start)
                each = at.flatten()
                first, last = (np.asarray(each.field(c), np.int64) for c in ("first", "last"))
                text = np.repeat(np.arange(len(texts)), np.diff(np.asarray(at.offsets)))
                size = last - first + 1
                start = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                text = np.repeat(text, size)
                # where an id has several texts, a shorter one has no such place
                ok = start + MIN_WORDS <= (w.at[1:] - w.at[:-1])[text]
                start, text = start[ok], text[ok]
                ids = batch.column("doc_id").slice(part.start, part.stop - part.start).to_numpy()
                a = w.at[:-1][text] + start
                yield pa.RecordBatch.from_arrays([pa.array(r.of(a, a + MIN_WORDS).view(np.int64)), pa.array(ids[text]), pa.array(start.astype(np.int32))], ["h", "doc_id", "start"])

    return listed.select("doc_id", "text", "at").mapInArrow(run, "h long, doc_id long, start int")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, first): places of words that lie in windows which document first, an earlier one, holds.

    Exact but for collisions of 64-bit hashes; each window names its earliest holder.
    """
    rows = materialize(spans(docs))
    # each distinct span once, with its earliest holder and how many rows hold it
    classes = materialize(rows.groupBy("key", "span").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("latest"), F.count("*").alias("n")))
    keys = classes.groupBy("key").agg(F.min("holder").alias("x"), F.max("latest").alias("y"), F.count("*").alias("n")).where("x <> y")
    known = materialize(join_hot(classes.withColumnRenamed("n", "rows"), keys.select("key", "n"), ["key"], classes.count()).select("key", "span", "holder", F.col("rows").alias("n"), (F.col("n") > 1).alias("parts")))
    release(classes)
    met = materialize(join_hot(rows, known, ["key", "span"], rows.count()).where("doc_id > holder OR parts").select("doc_id", "first", "last", "holder", "parts"))
    release(rows, known)
    whole = met.where("doc_id > holder").select("doc_id", F.col("first").alias("start"), (F.col("last") + MIN_WORDS).alias("stop"), F.col("holder").alias("first"))
    # the earliest holder of each span stands for it where its windows are looked up one by one
    listed = met.where("doc_id = holder AND parts").groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("at"))
    each = materialize(windows(docs.join(listed, "doc_id")))
    holders = each.groupBy("h").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("y"), F.count("*").alias("n")).where("holder <> y")
    later = join_hot(each, holders.select("h", "holder", "n"), ["h"], each.count()).where("doc_id > holder").select("doc_id", "start", (F.col("start") + MIN_WORDS).alias("stop"), F.col("holder").alias("first"))
    return whole.unionAll(later)


def lines(batch: pa.RecordBatch) -> Iterator[tuple[list[pa.Array], list[bytes]]]:
    """Ids (those of LINE) and texts of the lines of at least MIN_WORDS words, a few documents at a time."""
    for part, texts in text_chunks(batch):
        ids, found = [], []
        for doc, text in zip(batch.column("doc_id")[part.start : part.stop].to_pylist(), texts):
            at = 0
            for k, some in enumerate(text.split(b"\n")):
                n = len(some.split())
                if n >= MIN_WORDS:
                    ids.append((doc, k, at, at + n))
                    found.append(some)
                at += n
        if found:
            yield [pa.array(c, t) for c, t in zip(zip(*ids), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], found


#: A line's ids; start and stop count words of the document.
LINE = {"doc_id": "long", "line": "int", "start": "int", "stop": "int"}


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, first): lines whose component reaches an earlier document, the earliest of which is first."""
    got = similar_groups(docs, LINE, THRESHOLD, PARAGRAPHS, lines)
    return got.where("least.doc_id < doc_id").select("doc_id", "start", "stop", F.col("least.doc_id").alias("first"))


def merge_spans(found: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, stop, first documents) of what is to be cut: what overlaps or touches, and nothing between."""
    out: list[tuple[int, int, set[int]]] = []
    for a, b, d in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b), out[-1][2] | {d}
        else:
            out.append((a, b, {d}))
    return [(a, b, sorted(d)) for a, b, d in out]


def cut_words(text: bytes, spans: list[tuple[int, int, list[int]]], starts: np.ndarray, ends: np.ndarray) -> bytes:
    """text without the words of the spans, and without the white space after them."""
    out, at = [], 0
    for a, b, _ in spans:
        out.append(text[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(text)
    out.append(text[at:])
    made = b"".join(out)
    return made.rstrip(b" \t\n\v\f\r") if spans and spans[-1][1] >= len(starts) else made


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col without its repeated passages, and n_removed (passages), removed_words, firsts (documents that keep them), class_id (smallest id that removals join, the own id for all others).

    Removed are windows of MIN_WORDS words that an earlier document (smaller id) holds, and lines of at least MIN_WORDS
    words in a component of similar lines that reaches an earlier document; no word outside them.  A document that
    copies an earlier one of at least MIN_WORDS words becomes empty.  The earliest document keeps a passage, even
    where it holds it twice; texts of fewer than MIN_WORDS words are never touched; null texts stay null; rows
    without an id keep their text; repeated rows of one id are cut alike; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull())
    found = materialize(repeated_windows(source).unionAll(repeated_paragraphs(source)))
    edges = found.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    classes = components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("class_id"))
    # places and classes are narrow; the texts meet them once
    at = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "first")).alias("at"))
    about = materialize(classes.join(at, "doc_id", "left"))
    release(found)
    named = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    i_id, i_text = docs.columns.index(id_col), docs.columns.index(text_col)
    j = named.join(about, F.col(f"_c{i_id}") == F.col("doc_id"), "left").drop("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(f"_c{i_text}")
            texts, count, words, firsts = col.to_pylist(), [], [], []
            for k, at in enumerate(batch.column("at")):
                kept: list[tuple[int, int, list[int]]] = []
                if at.is_valid and texts[k] is not None:
                    raw = texts[k].encode()
                    starts, ends = word_bounds(np.frombuffer(raw, np.uint8))
                    places = zip(*(at.values.field(c).to_pylist() for c in ("start", "stop", "first")))
                    kept = merge_spans([(a, min(b, len(starts)), d) for a, b, d in places if a < len(starts)])
                    texts[k] = cut_words(raw, kept, starts, ends).decode("utf-8", "replace")
                count.append(len(kept))
                words.append(sum(b - a for a, b, _ in kept))
                firsts.append(sorted({d for _, _, ds in kept for d in ds}))
            arrays = [batch.column(c) for c in batch.schema.names if c != "at"]
            arrays[i_text] = pa.array(texts, col.type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(count, pa.int32()), pa.array(words, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], [*[c for c in batch.schema.names if c != "at"], "_n", "_w", "_f"])

    types = dict(named.dtypes)
    out = j.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in named.columns) + ", class_id long, _n int, _w long, _f array<long>")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("_n").alias("n_removed"), F.col("_w").alias("removed_words"), F.col("_f").alias("firsts"), F.coalesce("class_id", F.col(f"_c{i_id}")).cast("long").alias("class_id"))
