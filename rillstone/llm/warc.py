"""Web-archive records in ZIP packages, written and range-read (operator 8).

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``, one gzip
member a record, and ``indexes/index.cdx``, one line a record with its offset and
length in the former. :class:`ZipReader` parses the end record, the ZIP64 locator and
end record and the central directory through a ``read_at(offset, length)`` function
alone, so a record is read by two small ranges, whatever the package's size. Spark hands
its workers a file as bytes: packages are kept to about `package_bytes` (or one longer
record), and `read_at` cuts ranges of those bytes. A very long page costs its task a few
times its bytes.

Defined results: a null payload is the empty payload; of records with equal payloads of
at least `min_bytes` the largest page_id is the response and the others revisit it;
rows that repeat that page_id are responses too; a null page_id is smaller than any
other and comes back null; further columns are ignored; no pages, no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fresh
from .textkit import tune
from .token_store import read_files, write_files

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_LOCAL = struct.Struct("<IHHHHHIIIHH")
_CENTRAL = struct.Struct("<IHHHHHHIIIHHHHHII")
_END = struct.Struct("<IHHHHIIH")
_END64 = struct.Struct("<IQHHIIQQQQ")
_LOCATE64 = struct.Struct("<IIQI")
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF
_DOS_DATE = 0x5821  # 2024-01-01: a fixed date, so equal records give equal packages


def zip_package(members: list[tuple[str, bytes]], *, zip64: bool = False, comment: bytes = b"") -> bytes:
    """A ZIP package of stored members; with ZIP64 records where sizes need them or `zip64` asks."""
    out, directory = bytearray(), bytearray()
    for name, body in members:
        at, raw, crc, n = len(out), name.encode(), zlib.crc32(body), len(body)
        big = zip64 or n >= _MAX32 or at >= _MAX32
        size = _MAX32 if big else n
        local_extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        out += _LOCAL.pack(0x04034B50, 45 if big else 20, 0x800, 0, 0, _DOS_DATE, crc, size, size, len(raw), len(local_extra)) + raw + local_extra + body
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if big else b""
        directory += _CENTRAL.pack(0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, _DOS_DATE, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if big else at) + raw + extra
    at, n = len(out), len(members)
    big = zip64 or at + len(directory) >= _MAX32 or n >= _MAX16
    out += directory
    if big:
        end = len(out)
        out += _END64.pack(0x06064B50, _END64.size - 12, 45, 45, 0, 0, n, n, len(directory), at) + _LOCATE64.pack(0x07064B50, 0, end, 1)
    out += _END.pack(0x06054B50, 0, 0, _MAX16 if big else n, _MAX16 if big else n, _MAX32 if big else len(directory), _MAX32 if big else at, len(comment)) + comment
    return bytes(out)


class ZipReader:
    """Directory of a ZIP package and ranges of its stored members, through `read_at` alone."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        tail_at = max(0, size - _END.size - _MAX16)
        tail = bytes(read_at(tail_at, size - tail_at))
        i = tail.rfind(b"PK\x05\x06")
        while i >= 0 and i + _END.size + int.from_bytes(tail[i + 20 : i + 22], "little") != len(tail):
            i = tail.rfind(b"PK\x05\x06", 0, i)
        if i < 0:
            raise ValueError("not a ZIP package")
        _, _, _, _, n, length, at, _ = _END.unpack_from(tail, i)
        if n == _MAX16 or length == _MAX32 or at == _MAX32:
            mark, _, end64, _ = _LOCATE64.unpack(read_at(tail_at + i - _LOCATE64.size, _LOCATE64.size))
            if mark == 0x07064B50:
                _, _, _, _, _, _, _, n, length, at = _END64.unpack(read_at(end64, _END64.size))
        self.members: dict[str, tuple[int, int, int]] = {}  # name: local header, size, method
        self._data: dict[str, int] = {}
        directory, p = bytes(read_at(at, length)), 0
        for _ in range(n):
            head = _CENTRAL.unpack_from(directory, p)
            if head[0] != 0x02014B50:
                raise ValueError("broken central directory")
            method, packed, full, names, extras, notes, offset = head[4], head[8], head[9], head[10], head[11], head[12], head[16]
            name = directory[p + _CENTRAL.size : p + _CENTRAL.size + names].decode()
            extra, q = directory[p + _CENTRAL.size + names : p + _CENTRAL.size + names + extras], 0
            while q + 4 <= len(extra):
                kind, width = struct.unpack_from("<HH", extra, q)
                if kind == 1:
                    r = q + 4
                    if full == _MAX32:
                        full, r = int.from_bytes(extra[r : r + 8], "little"), r + 8
                    if packed == _MAX32:
                        packed, r = int.from_bytes(extra[r : r + 8], "little"), r + 8
                    if offset == _MAX32:
                        offset = int.from_bytes(extra[r : r + 8], "little")
                q += 4 + width
            self.members[name] = (offset, packed, method)
            p += _CENTRAL.size + names + extras + notes

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        offset, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        if name not in self._data:
            head = _LOCAL.unpack(self.read_at(offset, _LOCAL.size))
            if head[0] != 0x04034B50:
                raise ValueError("broken local header")
            self._data[name] = offset + _LOCAL.size + head[9] + head[10]
        length = size - start if length is None else length
        if start < 0 or start + length > size:
            raise ValueError("range outside the member")
        return bytes(self.read_at(self._data[name] + start, length))


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    key = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{key}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    body = rest[: int(fields["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("broken record")
    return fields, body


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_packages(pages: DataFrame, path: str, *, min_bytes: int = 0, package_bytes: int = 4 << 20, zip64: bool = True) -> None:
    """Write a record for each page under `path`, in packages of about `package_bytes` of payload.

    Equal payloads are found by a SHA-1 aggregated map-side first; only digests that
    repeat are joined back, by a join whose skewed keys the adaptive planner splits.
    """
    tune(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    many = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(many, "digest", "left").select("page_id", "url", "html", "first_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index, held = bytearray(), [], 0

        def flush() -> pa.RecordBatch:
            # The file's final newline is the package's comment, so the file is the package exactly.
            body = zip_package([(DATA, bytes(data)), (INDEX, "".join(index).encode())], zip64=zip64, comment=b"\n")[:-1]
            data.clear(), index.clear()
            return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["content"])

        for b in batches:
            for page_id, url, html, first in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                payload = html.encode()
                revisit = first is not None and page_id != first
                record = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = record.compress(warc_record(page_id, url, payload, sha1_base32(payload), first, revisit)) + record.flush()
                index.append(f"{'null' if page_id is None else page_id} {len(data)} {len(packed)}\n")
                data += packed
                held += len(payload) + 400
                if held >= package_bytes:
                    yield flush()
                    held = 0
        if index:
            yield flush()

    write_files(joined.mapInArrow(build, "content binary"), "content", path)


def records(package: ZipReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record, range-read by the package's index."""
    for line in package.read(INDEX).decode().splitlines():
        _, at, length = line.split(" ")
        yield parse_record(zlib.decompress(package.read(DATA, int(at), int(length)), 31))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record under `path`."""
    tune(spark)
    number = lambda x: None if x in (None, "null") else int(x)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0):
                buffer = memoryview(body.as_buffer())
                cols: list[list] = [[] for _ in range(6)]
                for fields, payload in records(ZipReader(lambda at, n, m=buffer: bytes(m[at : at + n]), len(buffer))):
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (sha1_base32(payload) != digest or len(payload) != int(fields["x-payload-length"])):
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    other = fields.get("warc-refers-to")
                    for c, v in zip(cols, (number(fields["warc-record-id"][10:-1]), fields["warc-target-uri"], int(fields["x-payload-length"]), digest, kind, number(other[10:-1] if other else None)), strict=True):
                        c.append(v)
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read_files(spark, path).select("content").mapInArrow(scan, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc(pages: DataFrame, **options) -> DataFrame:
    path = fresh(pages.sparkSession, "warc")
    write_packages(pages, path, **options)
    return read_packages(pages.sparkSession, path)
