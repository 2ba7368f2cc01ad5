import gzip
import hashlib
import io

import pytest

from meterstone.llm import warc
from meterstone.session import new_scratch

ROWS = [
    (5, "http://a/x y\n", "<p>" + "long page " * 30), (3, "http://b", "<p>" + "long page " * 30), (9, None, "short"), (8, "u", "short"),
    (7, "http://c", None), (6, "http://d", ""), (4, "http://e", "WARC/1.0\r\n\r\n\r\nfiledesc:// 12\n" * 20), (1, "http://f", "é" * 60),
    (2, "http://g", "é" * 60), (2, "http://g", "é" * 60), (None, "http://h", "é" * 60), (10, "http://i", "x" * 300000), (11, "http://j", "y" * 99), (12, "http://j", "y" * 99),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def test_pages_come_back_from_the_archives(spark):
    got = warc.archived(frame(spark).repartition(3)).collect()
    assert len(got) == len(ROWS)
    payloads = [(i, (h or "").encode()) for i, _, h in ROWS]
    ids = {}
    for i, p in payloads:
        ids.setdefault(hashlib.sha256(p).hexdigest(), []).append((i is None, i or 0))
    sizes = {hashlib.sha256(p).hexdigest(): len(p) for _, p in payloads}
    responses = {}
    for r in got:
        assert r.payload_bytes == sizes[r.payload_digest] and (r.page_id is None, r.page_id or 0) in ids[r.payload_digest]
        if r.record_type == "response":
            responses.setdefault(r.payload_digest, []).append(r.page_id)
            assert r.refers_to is None
        else:
            assert sizes[r.payload_digest] >= 100 and r.refers_to == min(ids[r.payload_digest])[1]
    for digest, pages in responses.items():
        assert len(pages) == (1 if sizes[digest] >= 100 else len(ids[digest]))
    assert warc.archived(frame(spark, [])).count() == 0


def test_both_versions_are_written_and_read(spark):
    path = new_scratch(spark, "arc")
    warc.write_arc(frame(spark).repartition(2), path)
    kinds = set()
    for r in spark.read.format("binaryFile").load(path).collect():
        records = list(warc.arc_records(io.BytesIO(gzip.decompress(bytes(r.content))), r.path))
        assert records[0][2]["URL"].startswith("filedesc://")
        kinds.add(len(records[0][2]))
        raw = gzip.decompress(bytes(r.content))
        for at, _, fields, body in records:
            assert raw[at:].startswith(fields["URL"].encode()) and len(body) == int(fields["Archive-length"])
            assert fields.get("Offset", str(at)) == str(at)
    assert kinds == {5, 10}


def test_arc_headers_by_version_and_declared_length():
    block = b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhttp://next 1.1.1.1 20010101000000 text/html 5\nxx"
    raw = b"filedesc://f.arc 0.0.0.0 20010203040506 text/plain %d\n%s\n" % (len(block), block)
    raw += b"http://a b/c 1.2.3.4 20010203040506 text/html %d\n%s\n" % (len(body), body)
    records = list(warc.arc_records(io.BytesIO(raw), "f"))
    assert records[1][2]["URL"] == "http://a b/c" and records[1][3] == body and records[1][1] == "f.arc"
    with pytest.raises(ValueError, match="cut short"):
        list(warc.arc_records(io.BytesIO(raw[:-20]), "f"))
    with pytest.raises(ValueError, match="unknown version"):
        list(warc.arc_records(io.BytesIO(raw.replace(b"1 0 Org", b"7 0 Org")), "f"))
    with pytest.raises(ValueError, match="no filedesc"):
        list(warc.arc_records(io.BytesIO(b"http://a 1.1.1.1 2001 t 3\nabc\n"), "f"))


def test_converted_fields(spark):
    arc, out = new_scratch(spark, "arc"), new_scratch(spark, "warc")
    warc.write_arc(frame(spark).coalesce(1), arc)
    warc.to_warc(spark, arc, out)
    rows = warc.read_warc(spark, out).collect()
    assert sorted({r.record_type for r in rows}) == ["response", "revisit", "warcinfo"]
    assert len({r.record_id for r in rows}) == len(rows)
    page = next(r for r in rows if r.page_id == 10)
    assert page.date == "2020-01-01T00:00:10Z" and page.uri == "http://i"
    assert next(r for r in rows if r.page_id == 5).uri == "http://a/x%20y%0A"
