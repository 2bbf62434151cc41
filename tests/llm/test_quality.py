import random
import zlib

import numpy as np

from execlens.llm import quality
from execlens.llm.textops import Words


def rows(n=600, seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        bad = rng.random() < 0.3 and len(w) > 8
        if bad:
            w = rng.choice([lambda: [x.upper() + "!!" for x in w], lambda: [x + "$$$" for x in w], lambda: [w[0]] * len(w), lambda: " | ".join(w).split(" ")])()
        docs.append((i, " ".join(w), "s"))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_held_out_accuracy(spark, docs):
    d, y = rows()
    labels = spark.createDataFrame(y + [(1, None), (None, 1), (5, 7)], "doc_id long, quality int")
    table = docs(d + [(7001, None, "s"), (7002, "", "s"), (None, "a b", "s"), (3, d[3][1], "s")], extra=True)
    got = quality.classify(table, labels).collect()
    assert len(got) == len(d) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = dict(y)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert [tuple(r) for r in sorted(got, key=str)] == [tuple(r) for r in sorted(quality.classify(table, labels).collect(), key=str)]
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1 - v if zlib.crc32(str(i).encode()) % 4 == 2 else v) for i, v in y], "doc_id long, quality int")
    assert {r.doc_id: r.score for r in quality.classify(docs(d), flipped).collect()} == {r.doc_id: r.score for r in quality.classify(docs(d), labels).collect()}
    kept = quality.accepted(docs(d), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted and r.doc_id in truth}


def test_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs([(1, "a b c", "s")]), none).collect()
    assert [r.score for r in got] == [0.5]
    assert quality.classify(docs([]), none).collect() == []


def test_features_do_not_cross_texts():
    a, b = b"alpha beta gamma", b"delta delta"
    both, at = quality.features(Words([a, b, b""]))
    one, _ = quality.features(Words([b]))
    assert at.tolist() == [0, 3, 5, 5] and (both[3:5] == one).all()


def test_weights_equal_a_plain_loop():
    """FTRL-proximal written out with dictionaries gives the same weights."""
    rng = np.random.default_rng(5)
    rows = [(np.unique(rng.integers(0, 50, 8)), int(rng.integers(0, 2))) for _ in range(200)]
    rows = [(u, rng.random(len(u)), y) for u, y in rows]
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        return -(z[k] - np.sign(z[k]) * quality.L1) / ((quality.BETA + n[k] ** 0.5) / quality.ALPHA + quality.L2)

    for u, x, y in rows:
        features = [*zip(u.tolist(), x.tolist()), ("bias", 1.0)]
        w = {k: weight(k) for k, _ in features}
        p = 1 / (1 + np.exp(-(sum(w[k] * v for k, v in features) + 0.3)))
        for k, v in features:
            g = (p - y) * v
            z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / quality.ALPHA * w[k]
            n[k] = n.get(k, 0.0) + g * g
    got = quality.ftrl(iter(rows), 0.3)
    assert all(abs(got[k] - weight(k)) < 1e-5 for k in range(50)) and abs(got[-1] - weight("bias") - 0.3) < 1e-5


def test_a_score_is_its_texts_alone(spark, docs):
    texts = ["One plain sentence of some words.", "", None, "word " * 100_000, "$$$ %%%"]
    w = np.random.default_rng(1).standard_normal((1 << quality.BITS) + 1).astype(np.float32)
    together = {r.doc_id: r.score for r in quality.scores(docs([(i, t, "s") for i, t in enumerate(texts)]).coalesce(1), w).collect()}
    apart = {r.doc_id: r.score for i, t in enumerate(texts) for r in quality.scores(docs([(i, t, "s")]), w).collect()}
    assert together == apart and together[1] == together[2]
