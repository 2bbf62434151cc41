import random

from execlens.llm import mixing


def water_fill(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        stop = {s for s in open_ if cap * sizes[s] <= left * weight[s] / w}
        if not stop:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: cap * sizes[s] for s in stop}
        open_ -= stop
    return target


def test_targets_and_draws(spark, docs):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        s = rng.choice(["a", "a", "a", "b", "é", "z", None, "Z"])
        rows.append((i, "w " * rng.randint(0, 60 if s != "z" else 2), s))
    df = docs(rows, extra=True)
    got = mixing.mix(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = water_fill(sizes)
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.05 * t + 60
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    assert sum(r.copies for r in got) == mixing.mixed_rows(df).count() and mixing.mixed_rows(df).columns == df.columns


def test_odd_rows(spark, docs):
    got = mixing.mix(docs([(1, None, "a"), (None, "x y", "a"), (2, "", None), (3, "  q\x0bz", "b"), (3, "  q\x0bz", "b")])).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 3), (3, 3)]
    assert mixing.mix(docs([])).collect() == [] and mixing.mixed_rows(docs([])).collect() == []
    assert all(r.taken == 0 for r in mixing.mix(docs([(1, "", "a"), (2, None, None)])).collect())


def test_many_sources_and_a_hot_one(spark, docs, monkeypatch):
    rows = [(i, "a b c", "hot" if i % 2 else f"s{i % 40}") for i in range(400)]
    want = sorted(map(tuple, mixing.mix(docs(rows)).collect()))
    taken = sorted(map(tuple, mixing.mixed_rows(docs(rows, extra=True)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(tuple, mixing.mix(docs(rows)).collect())) == want and sorted(map(tuple, mixing.mixed_rows(docs(rows, extra=True)).collect())) == taken
    assert len(taken) == sum(r[5] for r in want)
