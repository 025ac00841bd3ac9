"""WARC archives: a writer through Spark's text sink and a splittable reader.

Writer: one gzip member for each record.  Spark's text sink gives the commit protocol (retried tasks leave no halves) and
reaches every Hadoop file system; it must write a separator between rows, so the separator is an empty gzip member, which
readers of concatenated gzip skip.

Reader: a task takes a byte range of a file, scans for the gzip magic, validates each candidate by decoding it until its
first record header shows, and owns the members that start inside its range, wherever they end.  Candidates inside
compressed data fail to decode, or decode to something that is no WARC header, and the scan goes on a byte later.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, hadoop_path, materialize, text_batches

MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member: header, an empty final deflate block, CRC 0, length 0.
EMPTY_MEMBER = MAGIC + bytes(6) + b"\x03\x03\x00" + bytes(8)
DATE = "2024-01-01T00:00:00Z"
STEP = 1 << 14  # bytes given to the decoder at a time
READ = 1 << 20  # bytes read from the file at a time
RECORDS = "file string, member_offset long, record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, payload binary"


def mark_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, refers_to``: of equal payloads the smallest page_id is the response, the others refer to it.

    A null html is an empty payload.  Rows that share the smallest id are all responses; a null id refers to the smallest id
    if there is one.  Digests are counted map-side first, so a payload held by a third of all pages is one row for each task;
    the join back is an ordinary left join, whose hot keys Spark splits at run time.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("__d", F.unhex(F.sha1("payload")))
    firsts = rows.groupBy("__d").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    firsts = materialize(firsts, "firsts")  # both sides of the join are then plain exchanges, which Spark can split
    rows = rows.join(firsts, "__d", "left")
    return rows.select("page_id", "url", "payload", F.expr("case when not page_id <=> __first then __first end").alias("refers_to"))


def _line(x: object) -> bytes:
    return str(x).encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A")


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 4) -> bytes:
    """A gzip member with one response record, or a revisit record that has the HTTP headers but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id), b"WARC-Date: " + DATE.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _line(url))
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head += [b"WARC-Payload-Digest: sha1:" + digest, b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    out = zlib.compressobj(level, zlib.DEFLATED, 31)
    return out.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array([encode_record(*x) for x in zip(*(c.to_pylist() for c in b.columns))], pa.binary())], ["member"])


def write_warc(marked: DataFrame, path: str) -> None:
    """Archive the rows of :func:`mark_revisits` under ``path``."""
    text_batches(marked.sparkSession)
    members = marked.select("page_id", "url", "payload", "refers_to").mapInArrow(_encode, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


class _Source:
    """Bytes of a file from a moving position; holds about one read at a time."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.buf = f, size, 0, b""

    def get(self, pos: int, n: int) -> memoryview:
        """Up to n bytes from pos; fewer only at the end of the file."""
        if not self.at <= pos <= pos + n <= self.at + len(self.buf):
            self.f.seek(pos)
            self.at, self.buf = pos, self.f.read(min(max(n, READ), max(0, self.size - pos)))
        return memoryview(self.buf)[pos - self.at : pos - self.at + n]

    def find(self, pos: int, end: int) -> int:
        """First place in [pos, end) where the gzip magic starts, or -1."""
        while pos < end:
            got = bytes(self.get(pos, min(READ, self.size - pos)))
            if (i := got.find(MAGIC)) >= 0:
                return pos + i if pos + i < end else -1
            if pos + len(got) >= self.size:
                return -1
            pos += len(got) - len(MAGIC) + 1
        return -1


def _member(src: _Source, pos: int) -> tuple[bytes, int] | None:
    """The decoded member at pos and the place after it; None if none is there."""
    d, out, known, start = zlib.decompressobj(31), [], b"", pos
    try:
        while not d.eof:
            got = src.get(pos, STEP)
            if not len(got):
                return None
            out.append(d.decompress(got))
            pos += len(got)
            if len(known) < 7:
                known += out[-1][:7]
                if not b"WARC/1.".startswith(known[:7]) and not known.startswith(b"WARC/1."):
                    return None
    except zlib.error:
        return None
    whole = b"".join(out)
    return (whole, pos - len(d.unused_data)) if pos - len(d.unused_data) > start else None


def _records(whole: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of the records of a decoded member."""
    at = 0
    while (at := whole.find(b"WARC/1.", at)) >= 0:
        end = whole.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = dict((k.strip().lower().decode("utf-8", "replace"), v.strip().decode("utf-8", "replace")) for k, _, v in (x.partition(b":") for x in whole[at:end].split(b"\r\n")[1:]))
        n = int(head.get("content-length") or 0)
        yield head, whole[end + 4 : end + 4 + n]
        at = end + 4 + n


def _parse(head: dict[str, str], block: bytes, payload: bool) -> tuple:
    kind, ok, body, n = head.get("warc-type"), None, block, len(block)
    if "application/http" in head.get("content-type", ""):
        http, _, body = block.partition(b"\r\n\r\n")
        n = len(body)
        if kind == "revisit":
            n = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), 0)
    digest = head.get("warc-payload-digest", "").rpartition(":")[2] or None
    if kind != "revisit" and digest:
        ok = base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
    bare = lambda k: (v := head.get(k)) and v.strip("<>")
    return bare("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-date"), bare("warc-refers-to"), digest, n, ok, body if payload and kind != "revisit" else None


def scan_range(f, size: int, start: int, end: int, payload: bool = True) -> Iterator[tuple]:
    """Records of the members that start in [start, end) of the open binary file ``f`` of ``size`` bytes."""
    src, pos = _Source(f, size), start
    while (pos := src.find(pos, end)) >= 0:
        if (got := _member(src, pos)) is None:
            pos += 1
            continue
        for head, block in _records(got[0]):
            yield (pos, *_parse(head, block, payload))
        pos = got[1]


def _scan(schema: pa.Schema, payload: bool):
    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def opened(path: str):
        import pyarrow.fs as pafs

        fs, p = pafs.FileSystem.from_uri(path)
        return fs.open_input_file(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for b in batches:
            for x in b.to_pylist():
                rows, held = [], 0
                f = io.BytesIO(x["content"]) if x.get("content") is not None else opened(x["file"])
                with f:
                    for r in scan_range(f, x["size"], x["start"], x["end"], payload):
                        rows.append((x["file"], *r))
                        held += len(r[-1] or b"") + 200
                        if held > 1 << 24:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    return run


def read_warc(spark: SparkSession, path: str, split_bytes: int = 32 << 20, payload: bool = True) -> DataFrame:
    """Records of all files under ``path`` (hidden files left out), read in ranges of ``split_bytes``.

    payload_bytes is the length of the payload, for revisits that of the payload they stand for (from the HTTP header they
    keep); ``digest_ok`` tells if a payload has the digest of its record, null where it has none.  The payload column is null
    for revisits and with ``payload=False``.  Stores that only Spark reaches are read a file at a time.
    """
    fs, p = hadoop_path(spark, path)
    files, it = [], fs.listFiles(p, True)
    while it.hasNext():
        s = it.next()
        if not s.getPath().getName().startswith(("_", ".")) and s.getLen():
            files.append((s.getPath().toString(), s.getLen()))
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]]) for c in RECORDS.split(", ")])
    if files and files[0][0].split(":")[0] not in ("file", "hdfs", "s3", "gs"):
        whole = spark.read.format("binaryFile").load([f for f, _ in files]).select(F.col("path").alias("file"), F.col("length").alias("size"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), "content")
        return whole.mapInArrow(_scan(schema, payload), RECORDS)
    ranges = [(f, n, a, min(n, a + split_bytes)) for f, n in files for a in range(0, n, split_bytes)]
    if not ranges:
        return spark.createDataFrame([], RECORDS)
    todo = spark.createDataFrame(ranges, "file string, size long, start long, end long").repartition(len(ranges))
    return todo.mapInArrow(_scan(schema, payload), RECORDS)


def archive_round_trip(pages: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and return the records read back, without payloads."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(mark_revisits(pages), path)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return read_warc(spark, path, split_bytes, payload=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
