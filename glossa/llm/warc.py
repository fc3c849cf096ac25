"""WARC archives: written by Spark's text writer, read record by record, assembled into captures.

Writing: each page gives a request, a response (or revisit) and a metadata record; request and metadata name the
response in WARC-Concurrent-To. A text row is a record without its final CRLF CRLF, which is the writer's line
separator, so files are gzip-compressed WARC 1.1 on any file system that Spark writes to. A file gets about
``FILE_BYTES`` of payload, and never more than ``LARGEST_FILE`` or one page. Pages with equal payloads (by SHA-1) of at least ``min_bytes`` bytes are written once, under
the largest page id; the others are revisits that refer to it and hold HTTP headers only.

Reading: each file is one task row; records are cut by Content-Length from the decompressed stream, payload digests are
taken from the payload itself and must equal the header's. Assembly: requests and metadata, grouped by the response
that they name, are hash-joined to responses: one nested row per capture. Payloads needn't go through that shuffle.
Pages of a frequent payload are joined where they are, and responses, which refer to nothing, take no part in the join
of revisits.

Defined cases: null html is the empty payload; null urls and ids are left out of the headers and come back as null (a
null id is smaller than any); line breaks in urls are percent-encoded; fully repeated rows share record ids and come
back as often as they were written; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.plans.materialize import materialize
from glossa.plans.skew import join_hot

FILE_BYTES, LARGEST_FILE, DATE, READ = 64 << 20, 1 << 30, "2024-01-01T00:00:00Z", 1 << 20
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary: five hexadecimal digits are four of base32."""
    digits = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.lpad(F.conv(F.substring(F.sha1(payload), i * 5 + 1, F.lit(5)), 16, 32), 4, "0"),
    )
    return F.translate(F.array_join(digits, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str | Column, record_id: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record; fields whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">"))]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cuts))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write all rows of (page_id, url, html) as archives below ``path``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    known = materialize(rows.select("page_id", "url", "digest", "size"), "warc-digests")
    n, total, largest = known.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    per_file = 3 * max(1, min(int(file_bytes / max(1, total / max(1, n))), LARGEST_FILE // max(1, largest)))
    shared = known.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
    rows = join_hot(rows, materialize(shared, "warc-shared"), ["digest"])
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id"))
    again = (F.col("size") >= min_bytes) & ~is_first
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    own, first = ("page_id", "url", "digest"), (F.col("first.page_id"), F.col("first.url"), F.col("digest"))
    response = _urn("response", *map(F.col, own))
    date, digest = F.lit(DATE), F.concat(F.lit("sha1:"), F.col("digest"))
    link = F.concat(F.lit("<"), response, F.lit(">"))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("size").cast("string"), F.lit(CRLF * 2),
    )
    host = F.coalesce(F.regexp_extract(uri, "^[^:]*://([^/?#]*)", 1), F.lit(""))
    records = F.array(
        _record(
            "request", _urn("request", *map(F.col, own)),
            [("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Concurrent-To", link), ("Content-Type", F.lit("application/http;msgtype=request"))],
            F.concat(F.lit("GET "), F.coalesce(uri, F.lit("*")), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)),
        ),
        _record(
            F.when(again, "revisit").otherwise("response"), response,
            [
                ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", digest),
                ("WARC-Profile", F.when(again, PROFILE)),
                ("WARC-Refers-To", F.when(again, F.concat(F.lit("<"), _urn("response", *first), F.lit(">")))),
                ("Content-Type", F.lit("application/http;msgtype=response")),
            ],
            F.when(again, head).otherwise(F.concat(head, F.col("html"))),
        ),
        _record(
            "metadata", _urn("metadata", *map(F.col, own)),
            [("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Concurrent-To", link), ("Content-Type", F.lit("application/warc-fields"))],
            F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
        ),
    )
    out = rows.select(F.explode(records).alias("value"))
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _stream(content: bytes) -> Iterator[bytes]:
    """Decompressed pieces of a file of one or more gzip members, or of a plain one."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at, view = 0, memoryview(content)
    while at < len(content):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(content):
            piece = view[at : at + READ]
            at += len(piece)
            while piece and not member.eof:  # no more than 8 * READ bytes at once, however well they were compressed
                yield member.decompress(piece, 8 * READ)
                piece = member.unconsumed_tail
        at -= len(member.unused_data)


def records(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(fields by lower-case name, block) of each record of one archive."""
    source, buffer = _stream(content), bytearray()

    def fill(n: int) -> bool:
        while len(buffer) < n:
            piece = next(source, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while fill(1):
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not fill(len(buffer) + 1):
                raise ValueError("archive ends inside a header")
        first, *lines = buffer[:end].decode("utf-8").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record where one must start: {first[:60]!r}")
        fields: dict[str, list[str]] = {}
        for line in lines:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(fields["content-length"][0])
        if not fill(end + 8 + size):
            raise ValueError("archive ends inside a record")
        block = bytes(buffer[end + 4 : end + 4 + size])
        if buffer[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its Content-Length says")
        del buffer[: end + 8 + size]
        yield fields, block


_KINDS = {
    "record_id": pa.string(), "type": pa.string(), "target_uri": pa.string(), "date": pa.string(), "concurrent_to": pa.list_(pa.string()),
    "refers_to": pa.string(), "content_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "fields": pa.string(), "payload": pa.binary(),
}
RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "content_type string, payload_digest string, payload_bytes long, fields string, payload binary"
)


def _row(f: dict[str, list[str]], block: bytes, with_payload: bool) -> tuple:
    def one(name: str) -> str | None:
        return f[name][0].strip("<>") if name in f else None

    kind, digest, size, payload = one("warc-type"), None, None, None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        said = (one("warc-payload-digest") or "").removeprefix("sha1:")
        if kind == "response":
            digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
            if said and said != digest:
                raise ValueError(f"payload of {one('warc-record-id')} doesn't have its digest")
        else:
            lengths = [x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            digest, size = said or None, int(lengths[0]) if lengths else None
    text = block.decode("utf-8", "replace") if kind in ("request", "metadata") else None
    links = [x.strip("<>") for x in f.get("warc-concurrent-to", [])]
    return (
        one("warc-record-id"), kind, one("warc-target-uri"), one("warc-date"), links, one("warc-refers-to"), one("content-type"),
        digest, size, text, payload if with_payload else None,
    )


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in records(content.as_py()):
                    rows.append(_row(fields, block, with_payload))
                    size += len(block) if with_payload else 0
                    if len(rows) == 4096 or size > READ * 8:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS.values(), strict=True)], list(_KINDS))


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: response (a response or revisit), its request, its metadata records.

    Records with equal ids are copies of each other; a capture comes as often as its response does.
    """
    main = found.where(F.col("type").isin("response", "revisit"))
    main = main.groupBy("record_id").agg(F.max(F.struct(*[c for c in main.columns if c != "concurrent_to"])).alias("response"), F.count("*").alias("n"))

    def linked(kind: str) -> DataFrame:
        one = found.where(F.col("type") == kind).select(
            F.explode("concurrent_to").alias("record_id"),
            F.struct(F.col("record_id").alias("record_id"), "target_uri", "date", "content_type", "fields").alias(kind),
        )
        return one.distinct()

    request = linked("request").groupBy("record_id").agg(F.min("request").alias("request"))
    metadata = linked("metadata").groupBy("record_id").agg(F.array_sort(F.collect_list("metadata")).alias("metadata"))
    got = main.join(request, "record_id", "left").join(metadata, "record_id", "left")
    return got.select("response", "request", "metadata", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")


def page_records(captures: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (a page id) of assembled captures."""
    captures = materialize(captures.withColumn("response", F.col("response").dropFields("payload")), "warc-captures")
    said = F.regexp_extract(F.col("metadata")[0]["fields"], r"(?m)^page_id: (-?\d+)\r?$", 1)
    rows = captures.select(
        F.when(said != "", said.cast("long")).alias("page_id"),
        F.col("response.record_id").alias("record_id"), F.col("response.target_uri").alias("url"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"),
    )
    ids = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("to")).agg(F.max("page_id").alias("refers_to"))
    out = ["page_id", "url", "payload_bytes", "payload_digest", "record_type"]
    revisits = rows.where("record_type = 'revisit'")
    counts = materialize(revisits.groupBy("to").agg(F.count("*").alias("n")).join(ids, "to", "left"), "warc-referred")
    first = rows.where("record_type = 'response'").select(*out, F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(join_hot(revisits, counts, ["to"]).select(*out, "refers_to"))
