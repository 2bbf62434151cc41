import re

import corpus_pipeline as c
from test_neardup import brute
from execlens.llm.common import materialize, table


def test_stages(spark, sf_dir):
    start = table(spark, sf_dir, "documents")
    docs, seen = start, {}
    for name, stage in c.STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == start.columns and docs.dtypes == start.dtypes
    texts = {r.doc_id: r.text for r in start.collect()}
    quality = {r.doc_id for r in seen["quality"].collect()}
    junk = re.compile(r"(?:\S+(?:!!|\$\$\$|%%%|###|&&&|\*\*\*)\s+){12}|(\S+ )\1{12}")
    assert quality and not any(junk.search(texts[i]) for i in quality)
    near = {r.doc_id for r in seen["near_duplicates"].collect()}
    assert near <= quality and len({texts[i] for i in near}) == len(near)
    rows = [(i, texts[i], None) for i in quality]
    assert near == {i for i, c, _ in brute(rows) if i == c}
    cut = {r.doc_id: r for r in seen["repeated_passages"].collect()}
    assert cut.keys() == near and all(r.n_chars == len(r.text) for r in cut.values() if r.text != texts[r.doc_id])
    grams = {}
    for i, r in cut.items():
        w = r.text.split()
        for j in range(len(w) - 50):
            grams.setdefault(tuple(w[j : j + 51]), set()).add(i)
    assert not any(len(s) > 1 for s in grams.values())
    mixed = [r.doc_id for r in seen["mixing"].collect()]
    assert set(mixed) <= near and max(map(mixed.count, set(mixed))) <= 3
    packed = seen["packing"].collect()
    assert sorted({r.doc_id for r in packed}) == sorted(set(mixed)) and len([r for r in packed if r.piece == 0]) == len(mixed)
    assert c.ORACLE_SQL is None


def test_run_gives_the_last_stage(spark, sf_dir):
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(c.run(spark, sf_dir).columns)


def test_stages_on_odd_rows(spark, tmp_path):
    good = " ".join(f"Word{i} and the story goes on, told by number {i * 7 % 13}." for i in range(40))
    docs = [(1, good, "en", "a", 5), (1, good, "en", "a", 5), (2, good, "en", None, 5), (3, None, None, "b", None), (4, "", "en", "b", 0), (5, " \n", "en", "b", 2), (None, good, "en", "a", 1), (6, "$$$ %%% !!! " * 60, "en", "a", 9), (7, good[:300] + " " + good, "en", "c", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows, name in ((docs, "odd"), ([], "empty")):
        sf = f"{tmp_path}/{name}"
        df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS key", "2 AS score", "3 AS n", "4 AS copies")
        df.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1), (6, 0), (None, 1), (7, None)] if rows else [], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
        start = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, f in c.STAGES[:-1]:
            made = f(spark, start, sf)
            assert made.dtypes == start.dtypes, stage
            got = [r.doc_id for r in made.collect()]
            if stage == "near_duplicates" and rows:
                assert sorted(i for i in got if i) == sorted({i for i, c, _ in brute([r[:3] for r in docs]) if i == c}) == [1, 3, 4, 5, 6] and None in got
            elif stage == "repeated_passages" and rows:
                assert sorted(i or 0 for i in got) == sorted(i or 0 for i, *_ in docs) and {r.doc_id: r.text for r in made.where("doc_id IN (2, 3, 7)").collect()} == {2: "", 3: None, 7: ""}
            assert rows or got == []
        assert (c.run(spark, sf).count() > 0) == bool(rows)
