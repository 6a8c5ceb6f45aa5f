"""WARC: round trips, framing and assembly, against plain Python."""

import gzip
import hashlib
import random

import pytest

from rowforge.llm import warc
from rowforge.llm.warc import archive_pages, assemble, read_records, write_archives


def plain(rows):
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if page_id is not None:
            first[data] = min(page_id, first.get(data, page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and first.get(data) is not None and page_id != first[data]
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


def pages_of(spark, rows):
    made = spark.createDataFrame([(*r, 1, "x", {"a": "b"}) for r in rows], "page_id long, url string, html string, payload_bytes int, type string, more map<string,string>")
    return made.repartition(5)


def test_archive_pages_against_plain_python(spark):
    rng = random.Random(2)
    odd = ["", None, "x" * 99, "x" * 100, "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3, "\r", "é" * 50, "é" * 49, "a\r\n" * 60, "\r\r\n\n\r" * 40, "WARC/1.1" * 20, "long " * 200_000]
    rows = [(k, f"http://h{k}.example/a b\r\nX: {k}?q#f", rng.choice(odd)) for k in range(120)]
    rows += [(200 + k, None, "".join(rng.choice("\r\n a<é") for _ in range(rng.randrange(300)))) for k in range(60)]
    rows += [(500 + k, "http://copies.example", "copied page " * 20) for k in range(300)]
    rows += [(None, "u", "copied page " * 20), (None, None, "only null ids " * 20), (None, None, "only null ids " * 20), (900, "u", "same row " * 20), (900, "u", "same row " * 20), (900, "v", "same row " * 20), (901, "u", "same row " * 20), (7, "u", ""), (7, "u", "")]
    got = archive_pages(pages_of(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    assert archive_pages(pages_of(spark, rows).limit(0)).count() == 0


def test_payloads_and_records_come_back(spark, tmp_path):
    rows = [(k, f"https://a.example/{k}", f"<p>page {k % 7}\r\n</p>" * (10 if k % 2 else 1)) for k in range(40)]
    write_archives(pages_of(spark, rows), str(tmp_path / "a"), date="2024-05-01T00:00:00Z")
    records = read_records(spark, str(tmp_path / "a"))
    captures = assemble(records).collect()
    assert len(captures) == 40 and records.count() == 120
    by_page = {int(c.metadata[0].fields[0].value): c for c in captures}
    for k, url, html in rows:
        c = by_page[k]
        assert len(c.requests) == len(c.metadata) == 1 and c.capture.date == "2024-05-01T00:00:00Z" and c.capture.target_uri == url
        assert c.requests[0].http_line == f"GET /{k} HTTP/1.1"
        assert bytes(c.capture.payload).decode() == ("" if c.capture.type == "revisit" else html) and c.capture.http_length == len(html)
    for archive in list((tmp_path / "a").glob("part*")):
        (tmp_path / "a" / f"copy-{archive.name}").write_bytes(archive.read_bytes())
    twice = assemble(read_records(spark, str(tmp_path / "a"))).collect()
    assert len(twice) == 80 and all(len(c.requests) == 1 for c in twice)


def raw(kind, record_id, block, *more):
    head = [b"WARC/1.0", b"warc-type: " + kind, b"WARC-Record-ID: " + record_id, *more, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """A member for each record, folded headers, binary payloads, links in every direction."""
    http = b"Content-Type: application/http"
    to = lambda x: b"WARC-Concurrent-To: " + x
    records = [
        raw(b"warcinfo", b"<i>", b"software: other\r\n", b"Content-Type: application/warc-fields"),
        raw(b"request", b"<q1>", b"GET /1 HTTP/1.1\r\n\r\n", http, b"X-Long: a", b"\tfolded"),
        raw(b"response", b"<r1>", b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe\x00\r\n\r\nx", http, to(b"<q1>"), to(b"<m1>")),
        raw(b"metadata", b"<m1>", b"fetch: 3\r\n", b"Content-Type: application/warc-fields"),
        raw(b"metadata", b"<m3>", b"more: 4\r\n", b"Content-Type: application/warc-fields", to(b"<q1>")),
        raw(b"resource", b"<r2>", b"plain"),
        raw(b"response", b"<r4>", b"", http),
        raw(b"request", b"<q4>", b"GET /4 HTTP/1.1\r\n\r\n", http, to(b"<r4>")),
        raw(b"metadata", b"<m4>", b"", b"Content-Type: application/warc-fields", to(b"<q4>")),
        raw(b"request", b"<q9>", b"", http, to(b"<nowhere>")),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    read = read_records(spark, str(tmp_path))
    assert [r.record_id for r in read.orderBy("number").collect()] == ["<i>", "<q1>", "<r1>", "<m1>", "<m3>", "<r2>", "<r4>", "<q4>", "<m4>", "<q9>"]
    found = {c.capture.record_id: c for c in assemble(read).collect()}
    assert set(found) == {"<r1>", "<r2>", "<r4>"}
    assert bytes(found["<r1>"].capture.payload) == b"\xff\xfe\x00\r\n\r\nx"
    assert [q.record_id for q in found["<r1>"].requests] == ["<q1>"] and [m.record_id for m in found["<r1>"].metadata] == ["<m1>", "<m3>"]
    assert not found["<r2>"].requests and bytes(found["<r2>"].capture.payload) == b"plain"
    assert [q.record_id for q in found["<r4>"].requests] == ["<q4>"] and [m.record_id for m in found["<r4>"].metadata] == ["<m4>"]


def test_broken_archives_are_errors(spark, tmp_path):
    good = raw(b"response", b"<r>", b"abc")
    for k, broken in enumerate([good[:-9], good.replace(b"Length: 3", b"Length: 2"), good.replace(b"Content-Length: 3\r\n", b""), b"no archive\r\n"]):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.warc.gz").write_bytes(gzip.compress(broken))
        (tmp_path / str(k) / "b.warc.gz").write_bytes(gzip.compress(good))
        with pytest.raises(Exception, match="BrokenArchive"):
            read_records(spark, str(tmp_path / str(k))).collect()
    assert warc.REVISIT_BYTES == 100
