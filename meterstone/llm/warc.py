"""Legacy ARC archives, their conversion to WARC, and reading WARC back.

An ARC file opens with a ``filedesc`` record whose second line names the fields of all header lines that follow: five in
version 1, ten in version 2. Headers are split by that list from the right, so an address with spaces survives; the
declared length alone says where a record ends. The converter gives every record an identifier derived from file name
and offset, an ISO timestamp, a type and a payload digest; equal payloads become revisits of one response.

Files are written by Spark's text writer, one record per row and the record's own terminator between rows, and read whole
per file: a file comes from one input partition and must stay below the 2 GB that a row can hold. Inside a task a file is
a stream of records. Payloads never meet by digest: digests are compared first, and only the verdicts join the payloads.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.llm.tables import text_of
from meterstone.session import new_scratch, through_table

# The header fields by ARC version, and the profile of a revisit.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 100
#: Records of one Arrow batch.
BATCH = 256
#: Speed over size: archives made here are read once.
_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def _write(records: DataFrame, path: str, separator: str) -> None:
    records.select(F.col("value").cast("string").alias("value")).write.options(**_GZIP).option("lineSep", separator).text(path)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) == BATCH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in kept], schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in kept], schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _stream(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


# ARC


def write_arc(pages: DataFrame, path: str) -> None:
    """Write ``pages(page_id, url, html)`` as ARC files, version 1 and 2 by turns of the input partitions.

    A null html is an empty payload, a null address a dash; white space in an address is percent-encoded. The capture date
    counts seconds from 2020 by page_id, the page's id is kept as a response header (none where it is null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"pages-{part:06d}.arc"
        offset = 0

        def record(address: str, date: str, kind: str, body: bytes, code: int) -> bytes:
            nonlocal offset
            fields = [address, "0.0.0.0", date, kind]
            if version == 2:
                fields += [str(code), hashlib.md5(body).hexdigest(), "-", str(offset), name]
            out = " ".join([*fields, str(len(body))]).encode() + b"\n" + body
            offset += len(out) + 1
            return out

        def records() -> Iterator[tuple[bytes]]:
            block = f"{version} 0 meterstone\n{ARC_FIELDS[version]}\n".encode()
            yield (record(f"filedesc://{name}", "20200101000000", "text/plain", block, 200),)
            for batch in batches:
                for k in range(batch.num_rows):
                    page, url, date, html = (batch.column(c)[k].as_py() for c in ("page_id", "url", "date", "html"))
                    payload = html.encode()
                    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
                    head += [] if page is None else [f"X-Page-Id: {page}"]
                    address = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"
                    yield (record(address, date, "text/html", "\r\n".join([*head, "", ""]).encode() + payload, 200),)

        return _batched(records(), pa.schema([("value", pa.binary())]))

    page = F.col("page_id").cast("long")
    date = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce(page, F.lit(0)), F.lit(10**9))), "yyyyMMddHHmmss")
    rows = pages.select(page.alias("page_id"), "url", date.alias("date"), text_of("html").alias("html"))
    _write(rows.mapInArrow(run, "value binary"), path, "\n")


def arc_records(stream, name: str) -> Iterator[tuple[int, str, dict[str, str], bytes]]:
    """(offset, file name of the filedesc, header fields, body) of an ARC stream, the filedesc record first."""
    offset, fields, own = 0, None, name
    while line := stream.readline():
        at = offset
        offset += len(line)
        if not line.strip():
            continue
        length = line.rsplit(b" ", 1)[-1].strip()
        if not length.isdigit():
            raise ValueError(f"{name}: no declared length at byte {at}")
        body = stream.read(int(length))
        if len(body) < int(length):
            raise ValueError(f"{name}: the record at byte {at} is cut short")
        offset += len(body)
        if fields is None:
            if not line.startswith(b"filedesc://"):
                raise ValueError(f"{name}: no filedesc record")
            block = body.decode().split("\n")
            if block[0].split(" ")[0] not in map(str, ARC_FIELDS):
                raise ValueError(f"{name}: unknown version {block[0]!r}")
            fields = block[1].split(" ")
            own = line.split(b" ", 1)[0].removeprefix(b"filedesc://").decode()
        values = line.rstrip(b"\r\n").decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"{name}: {len(values)} of {len(fields)} header fields at byte {at}")
        yield at, own, dict(zip(fields, values, strict=True)), body


def _http(body: bytes) -> tuple[bytes, bytes, dict[str, str]] | None:
    """Head (with its blank line), payload and headers of an HTTP response."""
    if not body.startswith(b"HTTP/"):
        return None
    head, found, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return head + found, payload, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


_CONVERTED = "record_id string, kind string, page_id long, uri string, date string, ip string, digest string, payload_bytes long, head binary, payload binary"


def convert(files: DataFrame, payloads: bool) -> DataFrame:
    """The records of ARC ``files(path, content)`` with synthesised WARC fields; head and payload only if asked for."""
    names = [c.strip().split(" ")[0] for c in _CONVERTED.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[c.strip().split(" ")[1]]) for n, c in zip(names, _CONVERTED.split(","), strict=True)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                path = batch.column("path")[k].as_py()
                for offset, name, fields, body in arc_records(_stream(batch.column("content")[k].as_py()), path):
                    date = fields["Archive-date"].ljust(14, "0")
                    iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
                    seed = f"{name}|{offset}|{fields['URL']}|{date}".encode()
                    record = str(uuid.UUID(bytes=hashlib.sha256(seed).digest()[:16], version=5))
                    if fields["URL"].startswith("filedesc://"):
                        kind, head, payload, page = "warcinfo", b"", b"software: meterstone\r\nformat: WARC File Format 1.0\r\n", None
                    elif http := _http(body):
                        kind, (head, payload, headers) = "response", http
                        page = int(headers["x-page-id"]) if "x-page-id" in headers else None
                    else:
                        kind, head, payload, page = "resource", b"", body, None
                    digest = hashlib.sha256(payload).hexdigest()
                    shown = (head, payload) if payloads else (None, None)
                    yield record, kind, page, fields["URL"], iso, fields["IP-address"], digest, len(payload), *shown

    return files.mapInArrow(lambda batches: _batched(rows(batches), schema), _CONVERTED)


# WARC


def revisits(heads: DataFrame) -> DataFrame:
    """(record_id, refers_to) of the responses whose payload an earlier page already has.

    The smallest page_id of equal payloads stays a response; of repeated ids the smallest record_id, null ids come last.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    able = heads.filter((F.col("kind") == "response") & (F.col("payload_bytes") >= REVISIT_BYTES))
    first = able.groupBy("digest").agg(F.min(order)["record_id"].alias("refers_to"), F.count("digest").alias("n")).filter("n > 1")
    return able.join(first, "digest").filter(F.col("record_id") != F.col("refers_to")).select("record_id", "refers_to")


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat(F.lit("WARC/1.0\r\n"), *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise("") for k, v in pairs], F.lit("\r\n"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write the rows of ``convert`` with payloads and ``refers_to`` (null: not a revisit) as WARC files."""
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    info, http = F.col("kind") == "warcinfo", F.col("kind") == "response"
    content = F.when(info, "application/warc-fields").when(http, "application/http; msgtype=response")
    head = _lines(
        ("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("kind"))),
        ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), "record_id", F.lit(">"))),
        ("WARC-Date", F.col("date")),
        ("WARC-Target-URI", F.when(~info, F.col("uri"))),
        ("WARC-IP-Address", F.when(http, F.col("ip"))),
        ("WARC-Payload-Digest", F.when(~info, F.concat(F.lit("sha256:"), "digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:uuid:"), "refers_to", F.lit(">")))),
        ("Content-Type", content),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    _write(records.select(F.concat(head.cast("binary"), block).alias("value")), path, "\r\n\r\n")


def warc_records(stream, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record where one should begin")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError(f"{name}: record {headers.get('warc-record-id')} is cut short")
        yield headers, block


_READ = "record_id string, record_type string, refers_to string, page_id long, payload_bytes long, payload_digest string, uri string, date string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Record heads of WARC files; the digest of a response is computed from its payload and must equal the header's."""
    names = [c.strip().split(" ")[0] for c in _READ.split(",")]
    schema = pa.schema([(n, pa.int64() if " long" in c else pa.string()) for n, c in zip(names, _READ.split(","), strict=True)])

    def bare(identifier: str | None) -> str | None:
        return None if identifier is None else identifier.removeprefix("<urn:uuid:").removesuffix(">")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column("path")[k].as_py()
                for headers, block in warc_records(_stream(batch.column("content")[k].as_py()), name):
                    kind, stated = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha256:")
                    _, payload, http = _http(block) or (b"", block, {})
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if kind == "revisit":
                        size, digest = int(http["content-length"]), stated
                    elif stated and digest != stated:
                        raise ValueError(f"{name}: the payload of {headers['warc-record-id']} has another digest")
                    page = int(http["x-page-id"]) if "x-page-id" in http else None
                    yield bare(headers["warc-record-id"]), kind, bare(headers.get("warc-refers-to")), page, size, digest, headers.get("warc-target-uri"), headers["warc-date"]

    return _files(spark, path).mapInArrow(lambda batches: _batched(rows(batches), schema), _READ)


def to_warc(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Convert all ARC files of a folder; one pass for digests, one for records."""
    heads = through_table(convert(_files(spark, arc_path), payloads=False).select("record_id", "kind", "page_id", "digest", "payload_bytes"), "heads")
    later = through_table(revisits(heads), "revisits")
    write_warc(convert(_files(spark, arc_path), payloads=True).join(later, "record_id", "left"), warc_path)


def archived(pages: DataFrame) -> DataFrame:
    """Pages through ARC and WARC and back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    One row per row of ``pages(page_id, url, html)``. Payloads of ``REVISIT_BYTES`` or more that equal another's are revisits
    of the smallest page_id, shorter ones are all responses. A null page_id yields a null, an empty table no rows; further
    columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = new_scratch(spark, "arc"), new_scratch(spark, "warc")
    write_arc(pages, arc)
    to_warc(spark, arc, warc)
    records = through_table(read_warc(spark, warc).filter(F.col("record_type").isin("response", "revisit")), "records")
    known = records.filter(F.col("record_type") == "response").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_page"))
    joined = records.join(known, "refers_to", "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to"))
