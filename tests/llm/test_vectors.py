import numpy as np

from execlens.llm import embeddings, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(n=600, dim=24, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.2 * rng.standard_normal((n, dim))
    return [(i, [float(v) for v in np.float32(r)], int(i % 2)) for i, r in enumerate(x)]


ODD = [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] + [1.0] * 23, 1), (9004, [float("inf")] + [1.0] * 23, 1), (9005, [None] + [1.0] * 23, 1), (9006, [1.0] * 24, None), (9007, [], 1), (9008, [1.0] * 7, 1), (9009, [2.0] * 7, 1)]


def brute(rows, threshold=0.93):
    good = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    links, parent = {i: set() for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, v, y) in enumerate(good):
        for j, w, z in good[:a]:
            if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links[i].add(j)
                links[j].add(i)
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in links.items()}


def test_links_against_brute_force(spark):
    rows = clustered() + ODD
    df = spark.createDataFrame(rows + rows[:3], SCHEMA).selectExpr("*", "1 AS key", "2 AS v", "3 AS links", "4 AS component_id")
    got = {r.vec_id: r for r in embeddings.cosine_links(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n for n, _ in want.values()) > 0
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.99 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embeddings.cosine_links(df.where("false")).collect() == []


def test_labels_never_mix(spark):
    """Labels whose low bits agree, and copies of one vector under several labels."""
    v = [1.0] * 24
    rows = [(1, v, 0), (2, v, 2**36), (3, v, -1), (4, v, 2**44), (5, v, 0), (6, [2.0] * 24, 0), (7, [-0.0] + v[1:], 2**36), (8, [0.0] + v[1:], 2**36)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert got == {1: (2, 1), 5: (2, 1), 6: (2, 1), 2: (2, 2), 7: (2, 2), 8: (2, 2), 3: (0, 3), 4: (0, 4)}


def test_rows_of_one_id_with_other_vectors_count_once(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (4, None, 1), (4, [1.0, 0.0], None)]
    runs = [sorted(map(tuple, embeddings.cosine_links(spark.createDataFrame(r, "vec_id long, embedding array<double>, label int")).collect())) for r in (rows, rows[::-1])]
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == [1, 2, 3, 4]


def test_hot_cluster_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = np.ones(24) + 0.01 * rng.standard_normal((100, 24))
    got = embeddings.cosine_links(spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(99, 0)}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((5, 64))
    assert np.allclose((embeddings.hadamard(x) ** 2).sum(1), 64 * (x * x).sum(1))


def exact(rows, queries, k):
    good = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v, _ in rows if v and all(e is not None and np.isfinite(e) for e in v)]
    out = []
    for i, v in good:
        if i in queries:
            s = sorted((-int(v @ w), j) for j, w in good if j != i and len(w) == len(v))
            out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s[:k])]
    return sorted(out)


def test_top_k_is_exact(spark, monkeypatch):
    rows = clustered(500) + ODD + [(700, [1.0] * 24, 0), (701, [1.0] * 24, 0), (702, [1.0] * 24, 0)]
    monkeypatch.setattr(search, "BLOCK", 100)
    v = search.quantize(spark.createDataFrame(rows + rows[:4], SCHEMA), "vec_id", "embedding")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_k(v, v.where("vec_id % 100 = 0 OR vec_id > 9000"), 10).collect())
    assert got == exact(rows, {i for i, _, _ in rows if i % 100 == 0 or i > 9000}, 10)
    assert search.top_k(v.where("false"), v, 10).collect() == []
    assert len(search.top_k(v.where("vec_id in (1, 2)"), v.where("vec_id = 1"), 10).collect()) == 1


def test_pivots_eliminate_and_scores_stay_exact():
    rng = np.random.default_rng(8)
    for dim, most in ((2, 0.1), (64, 0.6)):
        c = np.floor(1024 * rng.standard_normal((6000, dim)))
        ids, p = np.arange(6000), search.Pivots(dim, c[:1000])
        d, scored = p.distances(c), 0
        for q, found, scores, seen in search.block_top_k(p, ids[:20], c[:20], d[:20], np.full(20, -(2**63)), ids, c, d, 10):
            s = (c @ c[q]).astype(int)
            s[q] = -(2**62)
            best = np.lexsort((ids, -s))[:10]
            assert found.tolist() == best.tolist() and scores.tolist() == s[best].tolist()
            scored += seen
        assert scored < most * 20 * 6000


def test_products_beyond_double_precision():
    c = np.array([[2.0**30 + 1, 1.0], [2.0**30 + 3, 5.0]])
    assert search.dots(c, np.array([2.0**30 + 1, 7.0])).tolist() == [int(a) * (2**30 + 1) + int(b) * 7 for a, b in c]
