import base64
import gzip
import hashlib
import random

import pytest

from glossa.llm import warc as W
from glossa.plans.materialize import scratch_path


def b32(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        top = max((p for p in same if p is not None), default=None)
        again = len(payload) >= least and page != top
        out.append((page, len(payload), b32(html), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


ODD = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n\r\n\r\n"


def pages():
    rng = random.Random(1)
    bodies = ["", None, "é😀 text", ODD, "x" * 400_000, "same"]
    rows = [(i, f"http://h{i % 3}.example/{i}", rng.choice(bodies)) for i in range(80)]
    rows += [(200, None, "no url"), (201, "http://a/\r\nX-Evil: 1", "line"), (202, "u", "twice"), (202, "u", "twice"), (203, "w", "twice")]
    return rows + [(1, "http://other", "same id, other text"), (None, "http://null", "only here")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as size", "3 as first", "4 as n")
    path = scratch_path(spark, "test-warc")
    W.write_archives(df, path, min_bytes=least, file_bytes=50_000)
    got = W.page_records(W.assemble(W.read_records(spark, path))).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == expected(rows, least)
    kept = W.read_records(spark, path, with_payload=True).where("type = 'response'").collect()
    assert {bytes(r.payload) for r in kept} == {(h or "").encode() for *_, h in rows}
    one = W.assemble(W.read_records(spark, path)).where("response.target_uri = 'http://h0.example/3'").first()
    assert one.request.fields.startswith("GET http://h0.example/3 HTTP/1.1\r\nHost: h0.example\r\n") and len(one.metadata) == 1


def test_parser_reads_members_and_plain_files():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    for content in (record * 3, gzip.compress(record * 3), gzip.compress(record) * 3):
        assert [b for _, b in W.records(content)] == [b"ab\r\n"] * 3
    with pytest.raises(ValueError):
        list(W.records(record[:-3]))
    with pytest.raises(ValueError):
        list(W.records(record.replace(b": 4", b": 3")))


def test_empty(spark):
    path = scratch_path(spark, "test-warc")
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.page_records(W.assemble(W.read_records(spark, path))).count() == 0
