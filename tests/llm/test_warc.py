import base64
import gzip
import hashlib

from execlens.llm import warc

PAGES = "page_id long, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(5, "http://a/", "x"), (3, "http://b/", "x"), (9, None, "x"), (4, "u\r\nInjected: 1", None), (7, "c", ""), (8, "d", "é" * 9000), (None, "e", "x"), (3, "http://b/", "x")]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).withColumnRenamed("page_id", "page_id")).where("status = 'ok'").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.record_id, []).append(r)
    assert [r.record_type for r in by["3"]] == ["response"] * 2 and {r.refers_to for r in by["3"]} == {None}
    assert {(by[k][0].record_type, by[k][0].refers_to) for k in ("5", "9")} == {("revisit", "3")}
    assert by["7"][0].refers_to == "4" and by["7"][0].full_length == 0 and by["7"][0].payload_digest == sha("")
    assert by["5"][0].full_length == 1 and by["5"][0].payload_digest == sha("x")
    assert by["8"][0].payload_digest == sha("é" * 9000) and by["8"][0].full_length == 18000 and bytes(by["8"][0].payload).decode() == "é" * 9000
    assert by["null"][0].record_type == "response"
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def record(i, body=b"hello"):
    return warc.record_bytes(str(i), "response", f"http://h/{i}", body)


def whole(data, found):
    at = 0
    for r in found:
        assert r["start"] == at
        at = r["stop"]
    assert at == len(data)


def salvage(data):
    return [r for r in warc.salvage(data)]


def test_salvages_damaged_members():
    members = [warc.member(record(i, bytes([65 + i]) * 500)) for i in range(5)]
    hurt = bytearray(members[2])
    hurt[len(hurt) // 2] ^= 0xFF
    data = members[0] + members[1] + bytes(hurt) + b"garbage" + members[3] + members[4][:-6]
    got = salvage(data)
    assert [r.get("record_id") for r in got if r["status"] == "ok"] == ["0", "1", "3"]
    gaps = [(r["start"], r["stop"]) for r in got if r["status"] == "quarantined"]
    first = len(members[0]) + len(members[1])
    assert gaps == [(first, first + len(hurt) + 7), (len(data) - len(members[4]) + 6, len(data))]
    whole(data, got)


def test_salvages_plain_files_and_wrong_lengths():
    bad = record(1).replace(b"Content-Length: 5", b"Content-Length: 50")
    wrong = record(2).replace(b"hello", b"jello")
    data = b"junk" + record(0) + bad + wrong + record(3)
    got = salvage(data)
    assert [r["record_id"] for r in got if r["status"] == "ok"] == ["0", "3"]
    assert {r["reason"] for r in got if r["status"] == "quarantined"} >= {"no member and no version line"}
    whole(data, got)


def test_other_writers_members_and_empty_input():
    data = gzip.compress(record(1)) + warc.EMPTY_MEMBER + gzip.compress(record(2))
    assert [r["record_id"] for r in salvage(data) if r["status"] == "ok"] == ["1", "2"]
    assert salvage(b"") == []
    assert [r["status"] for r in salvage(b"\x1f\x8b\x08nonsense")] == ["quarantined"]


def test_archives_roll_over_and_extra_columns_clash(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 70}</p>" * 30) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).selectExpr("*", "1 AS sha", "2 AS first", "3 AS n", "4 AS digest", "5 AS payload")
    got = warc.round_trip(df, archive_bytes=2000).collect()
    assert len({r.file for r in got}) > 2 and {r.status for r in got} == {"ok"}
    assert sorted((int(r.record_id), r.record_type, r.refers_to) for r in got) == [(i, "response" if i < 70 else "revisit", None if i < 70 else str(i - 70)) for i in range(100)]
    assert {int(r.record_id): bytes(r.payload).decode() for r in got if r.record_type == "response"} == {i: h for i, _, h in rows[:70]}


def test_a_very_long_payload(spark):
    html = "é<p>" * 1_000_000
    got = warc.round_trip(spark.createDataFrame([(1, "u", html), (2, "u", "")], "page_id long, url string, html string"), payloads=False).collect()
    assert sorted((r.record_id, r.full_length, r.payload) for r in got) == [("1", 5_000_000, None), ("2", 0, None)]
