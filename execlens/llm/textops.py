"""Vectorised word and shingle hashing over batches of texts (numpy on UTF-8 bytes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: blank and \\t \\n \\v \\f \\r (fixed values).
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
STEP_BYTES = 1 << 19
_B = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixing bijection of 64-bit words (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _B, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = ~IS_SPACE[buf]
    d = np.diff(word)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, a few MB of bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    lens = ends - starts
    power = _powers(int(lens.max()))
    at = 0
    total = np.cumsum(lens)
    while at < len(starts):
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + STEP_BYTES, "right")))
        n = lens[at:stop]
        offs = np.concatenate([[0], np.cumsum(n)[:-1]])
        pos = np.arange(int(n.sum())) - np.repeat(offs, n)
        b = buf[np.repeat(starts[at:stop], n) + pos].astype(np.uint64)
        b += np.uint64(1)
        b *= power[pos]
        out[at:stop] = np.add.reduceat(b, offs)
        at = stop
    return mix64(out ^ (lens.astype(np.uint64) << np.uint64(56)))


class Words:
    """Word hashes of several texts, end to end: those of text i are h[at[i]:at[i + 1]]."""

    def __init__(self, texts: list[bytes]):
        joined = b" ".join(texts)
        self.buf = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(sizes + 1)])[: len(texts) + 1]
        self.starts, self.ends = word_bounds(self.buf)
        self.h = word_hashes(self.buf, self.starts, self.ends)
        self.at = np.searchsorted(self.starts, self.text_at)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each place on; the last k - 1 places are padded and not for use."""
        h = self.h
        if not len(h):
            return h
        out = np.zeros(len(h), np.uint64)
        for j in range(k):
            out[: len(h) - j] += h[j:] * np.uint64((2 * j + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1 | 1)
        return mix64(out)

    def sets(self, k: int) -> Iterator[np.ndarray]:
        """Per text its distinct k-word shingles, sorted.  A text of fewer words has one shingle of them all, one without words none."""
        s = self.shingles(k)
        for a, b in zip(self.at[:-1], self.at[1:]):
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                w = self.h[a:b]
                yield mix64(np.array([np.bitwise_xor.reduce(mix64(w + np.arange(1, len(w) + 1, dtype=np.uint64)))], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def text_chunks(batch: pa.RecordBatch, column: str = "text", size: int = STEP_BYTES) -> Iterator[tuple[slice, list[bytes]]]:
    """Slices of a batch whose texts hold about size bytes (null: empty), so that very long texts stand alone."""
    col = batch.column(column)
    texts = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    at, held, n = 0, [], 0
    for i in range(len(texts)):
        t = texts[i].as_py() or b""
        if held and n + len(t) > size:
            yield slice(at, i), held
            at, held, n = i, [], 0
        held.append(t)
        n += len(t)
    if held:
        yield slice(at, len(texts)), held
