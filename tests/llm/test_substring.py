import random

import numpy as np

from execlens.llm import substring
from execlens.llm.neardup import Bands, minhashes, tuned_bands


def grams(texts, k):
    seen = {}
    for i, t in texts:
        w = (t or "").split()
        for j in range(len(w) - k + 1):
            seen.setdefault(tuple(w[j : j + k]), set()).add(i)
    return {g: s for g, s in seen.items() if len(s) > 1}


def words(rng, n):
    return [f"v{rng.randrange(10**12)}" for _ in range(n)]


def test_passages_go_and_clean_texts_stay(spark, docs):
    rng = random.Random(7)
    passages = [words(rng, n) for n in (51, 68, 140)]
    rows, clean = [], set()
    for i in range(60):
        w = words(rng, rng.choice([10, 40, 120, 400]))
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w = w[:at] + passages[i % 9 // 3] + w[at:]
        else:
            clean.add(i)
            w += ["short", "common", "line", "of", "ten", "words", "that", "all", "texts", "share"]
        rows.append((i, " ".join(w).replace(" v1", "\nv1"), "s"))
    got = substring.remove_repeats(docs(rows, extra=True)).collect()
    before = {i: t for i, t, _ in rows}
    after = {r.doc_id: r.text for r in got}
    assert grams(before.items(), 51) and not grams(after.items(), 51)
    for i in clean:
        assert after[i] == before[i]
    for p in passages:
        assert sum(" ".join(p) in " ".join(t.split()) for t in after.values()) == 1
    # what is left of a document is exactly its own words
    for r in got:
        if r.n_removed:
            own = before[r.doc_id].split()
            p = next(p for p in passages if p[30] in own)
            assert r.text.split() == [w for w in own if w not in set(p)] and r.removed_words == len(p)
    classes = {r.doc_id: r.class_id for r in got}
    groups = {tuple(sorted(k for k, v in classes.items() if v == c)) for c in set(classes.values())}
    assert groups == {tuple(range(s, 60, 9)) for s in (0, 3, 6)} | {(i,) for i in clean}


def test_near_copies_of_a_paragraph(spark, docs):
    rng = random.Random(9)
    p = words(rng, 120)
    q = p[:60] + ["changed"] + p[61:]
    got = {r.doc_id: r for r in substring.remove_repeats(docs([(1, " ".join(p), "s"), (2, " ".join(words(rng, 30) + q), "s")])).collect()}
    assert got[1].n_removed == 0 and len(got[2].text.split()) <= 31 and got[2].firsts == [1]


def test_odd_rows(spark, docs):
    rng = random.Random(11)
    p, repeated = words(rng, 80), ["la"] * 300
    text = " ".join(p)
    rows = [(3, text, "s"), (3, text, "s"), (8, text, "s"), (9, None, "s"), (10, "", "s"), (None, text, "s"), (11, " ".join(repeated), "s"), (12, "few words", "s"), (13, "few words", "s"), (14, text + "\n\n" + text, "s")]
    got = substring.remove_repeats(docs(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by == {3: [text, text], 8: [""], 9: [None], 10: [""], None: [text], 11: [" ".join(repeated)], 12: ["few words"], 13: ["few words"], 14: [""]}
    assert substring.remove_repeats(docs([])).collect() == []


def test_many_holders_of_one_passage(spark, docs):
    rng = random.Random(13)
    p = words(rng, 60)
    rows = [(i, " ".join(words(rng, 20) + p + words(rng, 20)), "s") for i in range(200)]
    got = substring.remove_repeats(docs(rows)).collect()
    assert sum(r.n_removed for r in got) == 199 and all(len(r.text.split()) == 40 for r in got if r.doc_id)


def test_a_phrase_repeated_within_and_across_documents(spark, docs):
    rng = random.Random(17)
    phrase = ["is", "onhe", "and"]
    rows = [(i, " ".join(words(rng, 30) + phrase * n + words(rng, 30)), "s") for i, n in enumerate((100, 40, 300))]
    got = {r.doc_id: r for r in substring.remove_repeats(docs(rows)).collect()}
    assert got[0].text == rows[0][1]
    for i in (1, 2):
        assert got[i].n_removed == 1 and 60 <= len(got[i].text.split()) <= 62 and got[i].firsts == [0]


def test_an_earlier_document_holds_part_of_a_passage(spark, docs):
    rng = random.Random(19)
    rows, want = [], {}
    for k in range(40):
        p = words(rng, rng.choice([51, 55, 60, 75]))
        a = rng.randrange(0, len(p) - 46)
        part = p[a : a + rng.randrange(26, 47)]
        first = words(rng, 30) + part + words(rng, 30)
        if k % 4 == 0:  # the first document itself holds the part and then the whole
            first += p + words(rng, 30)
        own = [words(rng, 30) for _ in range(4)]
        rows += [(10 * k + 1, " ".join(first), "s"), (10 * k + 5, " ".join(own[0] + p + own[1]), "s"), (10 * k + 9, " ".join(own[2] + p + own[3]), "s")]
        want[10 * k + 9] = (own[2] + own[3], [10 * k + (1 if k % 4 == 0 else 5)])
        want[10 * k + 5] = (own[0] + own[1], [10 * k + 1]) if k % 4 == 0 else (own[0] + p + own[1], [])
    got = {r.doc_id: r for r in substring.remove_repeats(docs(rows)).collect()}
    assert {i: (got[i].text.split(), got[i].firsts) for i in want} == want
    assert all(got[i].text == t for i, t, _ in rows if i % 10 == 1)


def test_shares_of_different_documents_next_to_each_other(spark, docs):
    rng = random.Random(23)
    a, b, c, d = (words(rng, n) for n in (60, 70, 30, 30))
    own = [words(rng, 40) for _ in range(10)]
    rows = [
        (3, own[0] + a + own[1]), (7, own[2] + b + own[3]), (9, own[4] + a + b + own[5]),  # a passage each of two documents
        (13, own[6] + c + own[7]), (17, own[8] + d + own[9]), (19, own[0][:20] + c + d + own[1][:20]),  # two short shares
        (21, c + own[2][:30] + d), (29, own[3][:20] + c + d + own[4][:20]),  # 19 and 29 share c + d; nobody shares c + d with 21
    ]
    got = {r.doc_id: r for r in substring.remove_repeats(docs([(i, " ".join(w), "s") for i, w in rows])).collect()}
    assert got[9].text.split() == own[4] + own[5] and got[9].firsts == [3, 7] and got[9].removed_words == 130
    assert got[3].class_id == got[7].class_id == got[9].class_id == 3
    assert got[19].text.split() == dict(rows)[19] and got[21].n_removed == 0
    assert got[29].text.split() == own[3][:20] + own[4][:20] and got[29].firsts == [19]


def brute(rows):
    """Words left of each text: windows of 50 words that an earlier text holds go, and lines joined to an earlier text's by similarity."""
    rows = sorted(rows)
    gone = {i: set() for i, _ in rows}
    holder = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 49):
            if holder.setdefault(tuple(w[j : j + 50]), i) < i:
                gone[i].update(range(j, j + 50))
    lines = []
    for i, t in rows:
        at = 0
        for x in t.split("\n"):
            w = x.split()
            if len(w) >= 50:
                lines.append((i, at, len(w), {tuple(w[j : j + 5]) for j in range(len(w) - 4)}))
            at += len(w)
    group = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            x, y = lines[a][3], lines[b][3]
            if len(x & y) >= 0.8 * len(x | y) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    for a, (i, at, n, _) in enumerate(lines):
        if lines[group[a]][0] < i:
            gone[i].update(range(at, at + n))
    return {i: [w for j, w in enumerate(t.split()) if j not in gone[i]] for i, t in rows}


def test_equals_brute_force(spark, docs):
    rng = random.Random(29)
    vocabulary = [f"w{i}" if i % 7 else f"w{i}ß" for i in range(300)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [some(n) for n in (49, 50, 51, 70, 120, 200)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(shared)[:]
            kind = rng.randrange(4)
            if kind == 1:
                for _ in range(rng.randrange(1, 4)):
                    p[rng.randrange(len(p))] = rng.choice(vocabulary)
            elif kind == 2:
                p = p[rng.randrange(20) :][: rng.randrange(20, 200)]
            elif kind == 3:
                p = some(rng.choice([3, 30, 90]))
            parts.append(" ".join(p) + rng.choice([" ", "\n", " \n\n"]))
        rows.append((i, "".join(parts)))
    rows += [(100, "a b " * 90), (101, "x y " + "a b " * 70), (102, "a " * 200), (103, "b " + "a " * 120 + "c")]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in substring.remove_repeats(docs([(i, t, "s") for i, t in rows], extra=True)).collect()}
    want = brute(rows)
    assert {i: r.text.split() for i, r in got.items()} == want
    assert all(got[i].removed_words == len(t.split()) - len(want[i]) for i, t in rows)
    assert sum(r.n_removed > 0 for r in got.values()) > 40


def test_two_short_shares_around_own_words_stay(spark, docs):
    rng = random.Random(31)
    a, b, own = words(rng, 34), words(rng, 34), words(rng, 4)
    rows = [(1, " ".join(words(rng, 20) + a + words(rng, 20)), "s"), (2, " ".join(b + words(rng, 30)), "s"), (3, " ".join(a + own + b), "s")]
    got = {r.doc_id: r for r in substring.remove_repeats(docs(rows)).collect()}
    assert all(got[i].text == t and not got[i].n_removed and got[i].class_id == i for i, t, _ in rows)


def test_a_very_long_text(spark, docs):
    rng = random.Random(37)
    passage, long = words(rng, 51), words(rng, 120_000)
    rows = [(1, " ".join(long[:60_000] + passage + long[60_000:]), "s"), (2, " ".join(["new"] + passage + ["end"]), "s"), (3, " ".join(long[50_000:50_060]), "s")]
    got = {r.doc_id: r.text for r in substring.remove_repeats(docs(rows)).collect()}
    assert got == {1: rows[0][1], 2: "new end", 3: ""}


def test_recall_of_the_bands():
    plan = substring.PARAGRAPHS
    assert plan == tuned_bands(0.8, 0.99, 4) and plan.recall(0.8) >= 0.99 > Bands(plan.bands - 1, 4).recall(0.8)
    rng = np.random.default_rng(3)
    hit = 0
    for _ in range(400):  # pairs of similarity 0.8: 80 shared of 100
        x = rng.integers(0, 1 << 64, 100, dtype=np.uint64)
        both = np.concatenate([x[:90], x[:80], x[90:]])
        sig = minhashes(both, np.array([0, 90]), plan.hashes).reshape(2, plan.bands, plan.rows)
        hit += (sig[0] == sig[1]).all(1).any()
    assert hit >= 0.97 * 400
