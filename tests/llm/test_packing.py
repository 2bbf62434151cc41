import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from execlens.llm import packing
from execlens.llm.tokens import BlankSplit, tokenizer_path
from tokenizers import Tokenizer


def reference_ids(texts):
    t = Tokenizer.from_file(tokenizer_path())
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "  a  b \n \n c", "<|endoftext|> x", "hello <|endoftext|> world", "a  <|endoftext|><|endoftext|>\n<|endoftext", "　 a 　 b", "a\t b \t c ", " lead", "a b\x85 c \x1c d", "ééé  ", "it's we'll 12 345 ... !?", "a" * 5000, "x \n y", "é   z"]


def test_ids_equal_the_tokenizers():
    enc = BlankSplit(tokenizer_path())
    for text, want in zip(ODD, reference_ids(ODD)):
        assert enc.ids(text).tolist() == want, repr(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'é1.,! 　<|>", max_size=30), min_size=1, max_size=4))
def test_ids_equal_the_tokenizers_on_random_texts(texts):
    enc = BlankSplit(tokenizer_path())
    assert [enc.ids(t).tolist() for t in texts] == reference_ids(texts)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=12))
def test_histogram_packing_is_whole_and_near_the_bound(counts):
    patterns = packing.pack_histogram(counts, 60)
    seen = {}
    for lengths, n in patterns:
        assert n > 0 and sum(lengths) <= 60
        assert sum(x > 20 for x in lengths) <= 2
        for x in lengths:
            seen[x] = seen.get(x, 0) + n
    assert seen == counts
    bins = sum(n for _, n in patterns)
    total = sum(k * v for k, v in counts.items())
    assert bins <= 1.5 * max(-(-total // 60), sum(v for k, v in counts.items() if k > 30)) + 1


def plain_best_fit(lengths, capacity):
    """Bins, piece by piece: above a third the largest with the largest that fits; then each smaller one into the tightest gap."""
    large = sorted(x for x in lengths if x > capacity // 3)
    bins = []
    while large:
        a = large.pop()
        fit = [i for i, x in enumerate(large) if a + x <= capacity]
        bins.append([a, *([large.pop(fit[-1])] if fit else [])])
    for x in sorted((x for x in lengths if x <= capacity // 3), reverse=True):
        room = [b for b in bins if sum(b) + x <= capacity]
        if room:
            max(room, key=sum).append(x)
        else:
            bins.append([x])
    return bins


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 59), st.integers(1, 12), max_size=14))
def test_as_many_sequences_as_piece_by_piece(counts):
    made = sum(n for _, n in packing.pack_histogram(counts, 60))
    assert made == len(plain_best_fit([x for x, n in counts.items() for _ in range(n)], 60))


def test_cells_of_a_common_length(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 8)
    texts = ["a b c"] * 70 + ["a " * 7] * 5 + ["a b c d e f g"] * 20
    check(spark, docs([(i, t, "s") for i, t in enumerate(texts)]), texts, 8)


def check(spark, df, texts, capacity):
    rows = packing.pack(df, capacity=capacity, with_ids=True).collect()
    want = sorted([*ids, 2] for ids in reference_ids(texts))
    by_doc = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 <= capacity and zlib.crc32(r.ids) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append(r)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    return rows, by_doc, want


def test_whole_documents(spark, docs):
    texts = [*ODD, "word " * 900, "b c"]
    df = docs([(i, t, "s") for i, t in enumerate(texts)], extra=True)
    rows, by_doc, want = check(spark, df, texts, 64)
    got = []
    for parts in by_doc.values():
        parts.sort(key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts])
        assert [r.start for r in parts] == np.concatenate([[0], np.cumsum([r.length for r in parts])[:-1]]).tolist()
        assert len(parts) == 1 or all(r.length == 64 for r in parts[1:])
        got.append(ids.tolist())
    assert sorted(got) == want


def test_nulls_repeats_and_empty(spark, docs):
    df = docs([(1, None, None), (None, "a b", None), (2, "same", "s"), (2, "same", "s")])
    rows = packing.pack(df, capacity=16).collect()
    assert len(rows) == 4 and {r.length for r in rows if r.doc_id == 1} == {1}
    assert packing.pack(docs([]), capacity=16).collect() == []
