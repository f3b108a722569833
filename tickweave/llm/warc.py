"""Legacy archives made into WARC: ARC files are parsed by their version's header lines and declared lengths.

An ARC file begins with a version block that says how many fields its header lines have: url, address, date, type and length in
version 1; in version 2 the result code, checksum, location, offset and file name stand before the length. A
record's bytes are what its length declares, whatever they hold. Each becomes a WARC record with an identifier, a timestamp
in ISO form, a type and SHA-1 digests. Of records with equal payloads that with the smallest page_id is a response;
the others are revisits that refer to it and keep only the HTTP header.

Archives are written by Spark's text writer, whose line separator is the end of a record, so any file system it knows will
do; they are gzip streams with a version block or warcinfo record first, of at most ``FILE_ROWS`` records.

Nulls: null html is an empty payload. A null or blank url becomes ``urn:unknown``. A row with a null page_id is a response if
no other row has its payload, else it revisits; rows that share the smallest page_id are all responses. Empty tables give
archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.session import shared_folder

FILE_ROWS, LEAST_BYTES = 5000, 0
_DATE, _ADDRESS, _OUT_BYTES = "20240101000000", "0.0.0.0", 4 << 20
_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_SPACE = re.compile(r"[\x00-\x20\x7f\x85\xa0]")
#: How the version block of an archive that follows another in the same file begins; a page may have such a url, too.
_VERSION = re.compile(rb"\d+ \d+ [^\n]*\nURL IP-address ")


def _arc_block(version: int, name: str) -> bytes:
    said = f"{version} 0 tickweave\n{_FIELDS[version]}\n"
    more = "" if version == 1 else "200 - - 0 - "
    return f"filedesc://{name} {_ADDRESS} {_DATE} text/plain {more}{len(said)}\n{said}".encode()


def _arc_records(batches: Iterator[pa.RecordBatch], file_rows: int) -> Iterator[pa.RecordBatch]:
    """Pages as ARC records; partitions take turns in the two versions."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    version = 1 + part % 2
    for batch in batches:
        out, size = [], 0
        for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n % file_rows == 0:
                out.append(_arc_block(version, f"{part}-{n // file_rows}.arc"))
            payload = (html or "").encode()
            own = "" if page is None else f"X-Page-Id: {page}\r\n"
            body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
            name = _SPACE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), (url or "").strip()) or "urn:unknown"
            more = "" if version == 1 else f"200 - - {size} {part}.arc "
            out.append(f"{name} {_ADDRESS} {_DATE} text/html {more}{len(body)}\n".encode() + body)
            n, size = n + 1, size + len(body)
            if size > _OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


class Stream:
    """Bytes of an archive, unpacked as they are asked for; several gzip members may follow one another."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.held = raw, 0, bytearray()
        self.unpack = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        part = self.raw[self.at : self.at + (1 << 18)]
        self.at += len(part)
        while self.unpack and part:
            self.held += self.unpack.decompress(part)
            part = self.unpack.unused_data
            if part:
                self.unpack = zlib.decompressobj(31)
        self.held += part if not self.unpack else b""
        return True

    def line(self) -> bytes | None:
        """Up to a line feed, or None at the end."""
        seen = 0
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if not self._more():
                return None
        out = bytes(self.held[: end + 1])
        del self.held[: end + 1]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError(f"the archive ends {n - len(self.held)} bytes before its record does")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def arc_records(raw: bytes) -> Iterator[tuple[str, str, str, bytes]]:
    """(url, date, type, bytes) of each record of an ARC file but the version block."""
    stream, fields = Stream(raw), None
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        head = [x.decode() for x in line.rstrip().split(b" ") if x]  # other white space may be part of a url
        block = stream.take(int(head[-1])) if line.startswith(b"filedesc://") else None
        if block is not None and (fields is None or _VERSION.match(block)):
            said = block.decode().splitlines()
            fields = len(said[1].split())
            if fields != len(_FIELDS.get(int(said[0].split()[0]), "").split()):
                raise ValueError(f"an ARC version that isn't known: {said[:2]}")
            continue
        if len(head) != fields:
            raise ValueError(f"a header line of {len(head)} fields where the version has {fields}")
        yield head[0], head[2], head[3], stream.take(int(head[-1])) if block is None else block


def _digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("latin-1").split("\r\n")[1:])}


_PARSED = "page_id long, url string, date string, http binary, payload binary, payload_bytes long, payload_digest string"


def _parsed(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
    names = ["page_id", "url", "date", "http", "payload", "payload_bytes", "payload_digest"]
    for batch in batches:
        for raw in batch.column(0):
            out, size = [], 0
            for url, date, _, body in arc_records(raw.as_py()):
                head, _, payload = body.partition(b"\r\n\r\n")
                page = _headers(head).get("x-page-id")
                out.append((None if page is None else int(page), url, date, head, payload if with_payload else None, len(payload), _digest(payload)))
                size += len(body)
                if size > _OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _identifier(page, url: str, date: str) -> str:
    return f"<urn:page:{page}>" if page is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date}')}>"


def _warc_records(batches: Iterator[pa.RecordBatch], file_rows: int) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in batches:
        out, size = [], 0
        for page, url, date, head, payload, digest, first in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
            if n % file_rows == 0:
                said = b"format: WARC File Format 1.1\r\n"
                out.append(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {n}')}>\r\nWARC-Date: {stamp}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(said)}\r\n\r\n".encode() + said)
            again = first is not None and first != page
            body = head + b"\r\n\r\n" + (b"" if again else payload)
            lines = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {_identifier(page, url, date)}", f"WARC-Target-URI: {url}", f"WARC-Date: {stamp}"]
            if again:
                lines += [f"WARC-Refers-To: {_identifier(first, url, date)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Truncated: length"]
            lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_digest(body)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
            out.append("\r\n".join(lines).encode() + body)
            n, size = n + 1, size + len(body)
            if size > _OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def warc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file."""
    stream = Stream(raw)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not the beginning of a record: {line[:40]!r}")
        head = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        yield head, stream.take(int(head["content-length"]))


def _page(identifier: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", identifier or "")
    return int(found[1]) if found else None


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            out = []
            for head, block in warc_records(raw.as_py()):
                if head["warc-type"] not in ("response", "revisit"):
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and _digest(payload) != digest:
                    raise ValueError(f"the payload of {head['warc-record-id']} is not what its digest says")
                out.append((_page(head["warc-record-id"]), int(_headers(http)["content-length"]), digest, head["warc-type"], _page(head.get("warc-refers-to")), head["warc-target-uri"], head["warc-date"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "warc_date"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)


def _write(records: DataFrame, path: str, separator: str, file_rows: int) -> str:
    # a cast of bytes to a string leaves them as they are, and the writer puts them out so
    rows = records.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", separator)
    rows.option("maxRecordsPerFile", file_rows + 1).text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def write_arc(pages: DataFrame, path: str | None = None, file_rows: int = FILE_ROWS) -> str:
    """``pages`` (page_id, url, html) as ARC files; the folder they are in."""
    path = path or f"{shared_folder(pages.sparkSession)}/arc-{uuid.uuid4().hex}"
    return _write(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(lambda b: _arc_records(b, file_rows), "record binary"), path, "\n", file_rows)


def convert(spark: SparkSession, arc: str, path: str | None = None, least_bytes: int = LEAST_BYTES, file_rows: int = FILE_ROWS) -> str:
    """The ARC files of a folder as WARC files; the folder they are in. Payloads under ``least_bytes`` are never revisits."""
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    heads = _files(spark, arc).mapInArrow(lambda b: _parsed(b, False), _PARSED).where(F.col("payload_bytes") >= least_bytes)
    firsts = heads.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    records = _files(spark, arc).mapInArrow(lambda b: _parsed(b, True), _PARSED)
    records = records.join(firsts, ["payload_digest", "payload_bytes"], "left").select("page_id", "url", "date", "http", "payload", "payload_digest", "first")
    return _write(records.mapInArrow(lambda b: _warc_records(b, file_rows), "record binary"), path, "\r\n\r\n", file_rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri and warc_date of the records of a folder."""
    return _files(spark, path).mapInArrow(_read_back, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, warc_date string")


def archived(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    return read_warc(spark, convert(spark, write_arc(pages)))
