"""WARC archives: a writer of one gzip member per record, and a reader that salvages damaged files.

The reader checks every record (gzip CRC, version line, Content-Length, payload digest).  After a
failed check it looks for the next gzip member or, in plain files, the next version line, goes on
from there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member: Spark's text writer puts it after each archive as a line end.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" + "0300" + "00" * 8)
ARCHIVE_BYTES = 8 << 20
VERSION_LINE, LENGTH_LINE = re.compile(rb"WARC/1\.[01]\r\n"), re.compile(rb"^content-length:[ \t]*(\d+)", re.I | re.M)
RECORDS = "file string, start long, stop long, status string, reason string, record_id string, record_type string, refers_to string, target_uri string, payload_digest string, full_length long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: str, kind: str, uri: str, payload: bytes, refers_to: str | None = None, full_digest: str | None = None) -> bytes:
    """One WARC 1.1 record.  A revisit has an empty block; its headers keep the full payload's digest and size."""
    block = payload if kind != "revisit" else b""
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_header(uri)}", f"WARC-Payload-Digest: sha1:{full_digest or digest(payload)}",
        f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header(value: str) -> str:
    """Line ends would end a header early."""
    return re.sub(r"[\r\n]+", " ", value or "")


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _packer(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for i, kind, uri, payload, to, full in zip(*[b.column(c).to_pylist() for c in ("id", "kind", "uri", "payload", "refers_to", "digest")]):
                out.append(member(record_bytes(i, kind, uri, payload, to, full)))
                size += len(out[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])

    return run


def plan_records(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Rows to write: (id, kind, uri, payload, refers_to, digest).

    Of rows with equal payloads of at least min_bytes, those with the smallest id are responses and
    the others revisit it.  A null payload is empty; a row whose id is null is always a response.
    The digest of the smallest id is found by partial minima, so many equal payloads meet only as
    one row a task; the join back has one row per digest on that side and is split when skewed.
    """
    p = pages.select(F.col(id_col).alias("n"), F.col(uri_col).alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("sha", F.sha1("payload"))
    firsts = p.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("n").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    j = p.join(firsts, "sha", "left")
    later = F.col("n").isNotNull() & F.coalesce(F.col("n") > F.col("first"), F.lit(False))
    return j.select(
        F.coalesce(F.col("n").cast("string"), F.lit("null")).alias("id"),
        F.when(later, "revisit").otherwise("response").alias("kind"),
        F.coalesce(F.col("uri"), F.lit("")).alias("uri"),
        "payload",
        F.when(later, F.col("first").cast("string")).alias("refers_to"),
        base32(F.unhex("sha")).alias("digest"),
    )


def base32(raw) -> object:
    """Bare base32 of 20 bytes: eight groups of 5 bytes' 40 bits, 5 bits a letter."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for g in range(4):
        v = F.conv(F.hex(F.substring(raw, 5 * g + 1, 5)), 16, 10).cast("long")
        parts += [F.substr(letters, F.shiftright(v, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*parts)


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write archives of about archive_bytes under path, through Spark's own file system layer.

    Each row is one archive; the text writer puts it into a file of its own, followed by an empty
    gzip member, which readers of concatenated members pass over.
    """
    made = records.mapInArrow(_packer(archive_bytes), "archive binary").select(F.col("archive").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin1")).mode("overwrite").text(path)


def _parse(raw: bytes) -> tuple[dict | None, str]:
    """The record in raw, and why there is none."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not VERSION_LINE.match(raw) or not sep:
        return None, "no version line or no end of headers"
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    try:
        n = int(h["content-length"])
    except (KeyError, ValueError):
        return None, "no content length"
    if n < 0 or rest[n:] != b"\r\n\r\n":
        return None, "content length does not meet the record's end"
    block, kind = rest[:n], h.get("warc-type", "")
    want = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit" and want and digest(block) != want:
        return None, "payload digest differs"
    name = lambda k: m[1] if (m := re.fullmatch(r"<urn:page:(.*)>", h.get(k, ""))) else None
    return {"record_id": name("warc-record-id"), "record_type": kind, "refers_to": name("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "payload_digest": want or digest(block), "full_length": int(h["x-payload-length"]) if h.get("x-payload-length", "").isdigit() else n, "payload": block}, ""


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """The member at a place, where it ends, and what is wrong with it.  Fed in pieces, so that what follows isn't copied."""
    z, out, pos, step = zlib.decompressobj(31), [], at, 1 << 14
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(data[pos : pos + step]))
            pos += step
    except zlib.error as e:
        return b"", None, str(e)
    if not z.eof:
        return b"", None, "member ends early"
    return b"".join(out), min(pos, len(data)) - len(z.unused_data), ""


def salvage(data: bytes) -> Iterator[dict]:
    """Records and quarantined gaps of one archive, in order: each byte belongs to one of them."""
    at, bad, why = 0, None, ""

    def gap(stop: int) -> Iterator[dict]:
        if bad is not None and stop > bad:
            yield {"start": bad, "stop": stop, "status": "quarantined", "reason": why}

    while at < len(data):
        if data.startswith(MAGIC, at):
            raw, end, error = _inflate(data, at)
            if not error and not raw:  # an empty member holds no record
                yield from gap(at)
                bad, at = None, end
                continue
        elif VERSION_LINE.match(data, at):
            m = LENGTH_LINE.search(data, at, h) if (h := data.find(b"\r\n\r\n", at)) >= 0 else None
            end = h + 4 + int(m[1]) + 4 if m else None
            raw, error = (data[at:end], "") if m and end <= len(data) else (b"", "plain record ends early")
        else:
            end, raw, error = None, b"", "no member and no version line"
        record, error = _parse(raw) if not error else (None, error)
        if record:
            yield from gap(at)
            yield {"start": at, "stop": end, "status": "ok", "reason": None} | record
            bad, at = None, end
            continue
        if bad is None:
            bad, why = at, error
        line = VERSION_LINE.search(data, at + 1)
        after = [x for x in (data.find(MAGIC, at + 1), line.start() if line else -1) if x > 0]
        at = min(after) if after else len(data)
    yield from gap(len(data))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps (status) of all archives under path; empty when there is none."""
    names = ["start", "stop", "status", "reason", "record_id", "record_type", "refers_to", "target_uri", "payload_digest", "full_length", "payload"]
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), *[(n, pa.string()) for n in names[2:9]], ("full_length", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, rows = b.column("path")[i].as_py(), []
                for r in salvage(b.column("content")[i].as_py()):
                    rows.append({"file": file} | {n: r.get(n) for n in names} | ({} if payloads else {"payload": None}))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0, payloads: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row, read the archives back, and return what the records say (with payloads null unless wanted).

    A null payload is empty and a null address blank; a row of null id is a response of record id "null";
    of rows with equal id and payload each is a response; an empty table gives no rows.
    """
    spark, path = pages.sparkSession, shared_dir(pages.sparkSession)
    write_archives(plan_records(pages, id_col, uri_col, payload_col, min_bytes), path, archive_bytes)
    return read_archives(spark, path, payloads)
