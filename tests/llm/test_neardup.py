import random
import re

import numpy as np

from execlens.llm import neardup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall((text or "").encode())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, threshold=0.8):
    rows = [(i, shingle_set(t)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            both = len(x & y)
            if x and y and both >= threshold * (len(x) + len(y) - both):
                links[a] += 1
                links[b] += 1
                p, q = find(rows[a][0]), find(rows[b][0])
                parent[max(p, q)] = min(p, q)
    return sorted((i, find(i), n) for (i, _), n in zip(rows, links))


def corpus(seed=1, groups=14):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    rows, i = [], 0
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 12, 60, 200, 700]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            t = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, " ".join(t), "s"))
            i += 1
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, docs):
    rows = corpus() + [(900, "", "s"), (901, "", "s"), (902, None, "s"), (903, " \n ", "s"), (904, "one two", "s"), (905, "one\ttwo", "s"), (906, "one two", "s"), (None, "one two", "s"), (907, "rep eat ed row s and", "s"), (907, "rep eat ed row s and", "s")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in neardup.jaccard_links(docs(rows, extra=True)).collect())
    assert got == brute(rows)


def test_large_groups_are_cut_into_blocks(spark, docs, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(80)) + f" x{i}", "s") for i in range(90)] + [(200 + i, "copy of one text that many share", "s") for i in range(50)]
    monkeypatch.setattr(neardup, "BLOCK", 16)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in neardup.jaccard_links(docs(rows)).collect())
    assert got == [(i, 0, 89) for i in range(90)] + [(200 + i, 200, 49) for i in range(50)]


def test_one_of_each(spark, docs):
    rows = corpus(5, 6) + [(None, "lone row", "s"), (None, "lone row", "s"), (800, "again a b c d e f", "s"), (800, "again a b c d e f", "s")]
    kept = neardup.one_of_each(docs(rows)).collect()
    want = {i for i, c, _ in brute(rows) if i == c}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want) and sum(r.doc_id is None for r in kept) == 2
    assert neardup.one_of_each(docs([])).collect() == [] and neardup.jaccard_links(docs([])).collect() == []


def test_bounds_of_pruning():
    need = neardup.needed()
    assert list(need) == [16, 32, 48, 64, 80] and all(need[a] < need[b] for a, b in zip(need, list(need)[1:]))
    assert all(neardup.posterior(m, n, 0.8) >= neardup.TOLERANCE > neardup.posterior(m - 1, n, 0.8) for n, m in need.items())
    sets = [np.arange(k, k + 50, dtype=np.uint64) for k in range(12)]
    i, j = np.triu_indices(12, 1)
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j)]
    assert neardup._overlaps(sets, i, j).tolist() == want
    assert neardup._overlaps(sets, i[:3], j[:3]).tolist() == want[:3]
