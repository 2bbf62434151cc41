from execlens.llm.queries import QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


def test_contract_columns(spark, sf_dir):
    want = {
        "op1_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op2_mixing": ["doc_id", "size", "source_size", "target", "taken"],
        "op3_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op5_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        "op6_topk": ["query_id", "rank", "vec_id", "score"],
        "op7_html": ["page_id", "url", "text", "n_chars"],
        "op8_quality": ["doc_id", "held_out", "score", "predicted"],
        "op9_embeddings": ["vec_id", "n_links", "component_id", "kept"],
    }
    ints = {"piece", "rank", "predicted"}
    for name, columns in want.items():
        df = QUERIES[name](spark, sf_dir)
        types = dict(df.dtypes)
        assert set(columns) <= types.keys(), name
        for c in columns:
            assert types[c] != "int" or c in ints, (name, c)
        assert df.count() > 0
