"""Pairs within groups of any size: groups are cut into blocks, and each pair of blocks is one task.

A member of a group of k blocks is sent k times, so rows grow with the members and the number of
blocks and never with the pairs, which exist only as arrays inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
PAIRS = 1 << 17


def deal(df: DataFrame, blocks: Column, member: str) -> DataFrame:
    """df with columns lo, hi, own: a row for each pair of blocks that its member takes part in."""
    own = F.pmod(F.xxhash64(F.col(member), F.lit(11)), F.col("_k")).cast("int")
    d = df.withColumn("_k", F.greatest(blocks.cast("int"), F.lit(1))).withColumn("own", own)
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return d.withColumn("lo", F.least("own", "_other")).withColumn("hi", F.greatest("own", "_other")).drop("_k", "_other")


@cache
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin in sorted columns, and the number of rows at the end."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def index_pairs(starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs to compare, about PAIRS at a time: all of a block with itself, or across two blocks."""
    left, right, held = [], [], 0
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a < 2:
            continue
        if lo[a] == hi[a]:
            if b - a <= 64:
                i, j = _triangle(b - a)
                left.append(i + a)
                right.append(j + a)
                held += len(i)
            else:
                for r in range(a, b - 1):
                    left.append(np.full(b - r - 1, r))
                    right.append(np.arange(r + 1, b))
                    held += b - r - 1
                    if held >= PAIRS:
                        yield np.concatenate(left), np.concatenate(right)
                        left, right, held = [], [], 0
        else:
            x, y = a + np.flatnonzero(own[a:b] == lo[a]), a + np.flatnonzero(own[a:b] == hi[a])
            for r in x.tolist():
                left.append(np.full(len(y), r))
                right.append(y)
                held += len(y)
                if held >= PAIRS:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, held = [], [], 0
        if held >= PAIRS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (row numbers) after joining the rows of each pair: equal within what is connected."""
    while True:
        m = np.minimum(label[i], label[j])
        was = label.copy()
        np.minimum.at(label, label[i], m)
        np.minimum.at(label, label[j], m)
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        if (label == was).all():
            return label
