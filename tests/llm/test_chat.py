import hashlib
import json

from execlens.llm import chat

ROWS = "conv_id long, turn long, role string, text string"


def test_round_trip_of_odd_texts(spark):
    texts = ["", None, "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x|> <|", "line\nfeed", "a\\|b<|", "é😀"]
    roles = ["user", "assistant", "assistant", None, "a\nb~1", "<|im_start|>", "assistant", "assistant"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(roles, texts))] + [(None, 0, "user", "q"), (2, None, "assistant", "x"), (2, None, "assistant", "x")]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS p", "2 AS _n", "3 AS formatted")
    f = chat.format_turns(df, "conv_id", "turn", "role", "text")
    got = {r.conv_id: r for r in chat.chat_digests(f, "conv_id").collect()}
    full = {r.conv_id: r for r in f.collect()}
    turns = [(r or "", t or "") for r, t in zip(roles, texts)]
    loss = "".join(t for r, t in turns if r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss)
    assert got[1].n_turns == 8 and got[2].n_turns == 2 and got[None].n_turns == 1 and got[1].formatted_chars == len(full[1].formatted)
    text = full[1].formatted
    assert [text[s.start : s.end].replace("<\\|", "<|") for s in full[1].loss_spans][1] == texts[2]
    assert chat.chat_digests(chat.format_turns(df.where("false"), "conv_id", "turn", "role", "text"), "conv_id").collect() == []


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]},
        {"response": "y", "prompt": "x"}, {"completion": "y", "prompt": "x"}, {"question": "x", "answer": "y"},
        {"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "input": "n", "output": "o"}, {"instruction": "i", "output": "o"},
        {"system": "s", "instruction": "i", "output": "o"},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "z"}]},
        {"turns": [{"role": "user", "text": "t"}]}, {"foo": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "nope"), (92, "")], "i long, j string")
    got = {r.i: r for r in chat.canonical_turns(df, "j").collect()}
    flat = {i: [tuple(t) for t in r.turns] if r.turns is not None else None for i, r in got.items()}
    assert flat[0] == [("user", "a"), ("assistant", "b")] and flat[1] == flat[2] == flat[3] == [("user", "x"), ("assistant", "y")]
    assert flat[4] == flat[6] == [("user", "i"), ("assistant", "o")] and flat[5] == [("user", "i\nn"), ("assistant", "o")]
    assert flat[7] == [("system", "s"), ("user", "i"), ("assistant", "o")] and flat[8] == [("user", "q"), ("assistant", "z")] and flat[9] == [("user", "t")]
    assert [got[i].layout for i in (10, 90, 91, 92)] == [None] * 4 and got[0].fingerprint != got[1].fingerprint


def test_further_fields_hide_no_layout(spark):
    records = [
        {"id": 7, "messages": [{"role": "user", "content": "a", "name": "n"}], "source": {"url": "u"}},
        {"messages": []}, {"messages": [], "id": 1}, {"prompt": "x", "response": "y", "system": "s", "meta": [1]},
        {"instruction": "i", "input": "n", "output": "o", "system": "s"}, {"prompt": None, "response": "y"}, [1], "text",
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i long, j string")
    got = {r.i: [tuple(t) for t in r.turns] if r.turns is not None else None for r in chat.canonical_turns(df, "j").collect()}
    assert got[0] == [("user", "a")] and got[1] == got[2] == [] and got[3] == [("system", "s"), ("user", "x"), ("assistant", "y")]
    assert got[4] == [("system", "s"), ("user", "i\nn"), ("assistant", "o")] and got[5] == [("user", None), ("assistant", "y")] and got[6] is got[7] is None


def test_the_layout_decides_what_is_read(spark):
    """The same conversation in several layouts gives the same digests; the fingerprint alone tells them apart."""
    want = None
    said = [("user", "hello <|im_end|>"), ("assistant", "yes"), ("user", "and"), ("assistant", None)]
    same = lambda c: {"conv_id": 5, "extra": "e"} | c
    tables = [
        spark.createDataFrame([(5, i, t, r, "e") for i, (r, t) in enumerate(said)], "conv_id long, turn int, text string, role string, extra string"),
        spark.createDataFrame([("e", 5, i, t, r) for i, (r, t) in enumerate(said)], "extra string, conversation_id long, message_id long, content string, role string"),
        spark.createDataFrame([(5, i, r, t) for i, (r, t) in enumerate(said)], "conversation_id long, message_id long, `from` string, value string"),
        spark.createDataFrame([(5, [{"role": r, "content": t} for r, t in said], 1)], "conv_id long, messages array<struct<content:string,role:string>>, n int"),
        spark.createDataFrame([(5, i, said[2 * i][1], said[2 * i + 1][1]) for i in (0, 1)], "conv_id long, turn int, response_to string, response string").withColumnRenamed("response_to", "prompt"),
        spark.createDataFrame([(5, json.dumps(same({"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in said]})))], "conv_id long, record string"),
        spark.createDataFrame([(5, 1, json.dumps({"question": "and", "answer": None})), (5, 0, json.dumps(same({"instruction": said[0][1], "output": "yes"}))), (5, 2, '{"foo": 1}'), (5, 3, None)], "conv_id long, turn int, record string"),
    ]
    for t in tables:
        f = chat.format_turns(chat.turn_rows(t), "conv_id", "turn", "role", "text", "turn_part")
        got = chat.chat_digests(f, "conv_id").collect()
        want = want or got
        assert got == want and len(got) == 1 and got[0].n_turns == 4 and got[0].loss_chars == 3


def test_turn_tables(spark):
    df = spark.createDataFrame([], "text string, role string, turn long, conv_id long, extra int")
    assert chat.layout_of(df.schema).name == "turn_row" and chat.turn_rows(df).collect() == []
