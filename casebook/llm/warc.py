"""WARC archives packaged in ZIP files: written by tasks, read back through the ZIP directories by byte ranges.

An archive is a ZIP file with stored (not deflated) members: ``archive/*.warc.gz`` holds WARC 1.1 records, each a
gzip member of its own, and ``indexes/index.cdxj`` one line per record with member, offset and length. Since members
are stored, a record is one range of the ZIP file: the reader takes the tail of the file, the central directory (ZIP64
when the plain one overflows), the index, and then only the ranges it wants.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import shared_folder, slices, stored

MEMBER_BYTES = 8 << 20
ARCHIVE_BYTES = 64 << 20
REVISIT_BYTES = 1000

# Fixed values of the ZIP format (signatures, layouts, the marks that point to ZIP64 fields).
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_LAYOUT, END64_LAYOUT, LOCATOR64_LAYOUT = "<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL"
CENTRAL_LAYOUT, LOCAL_LAYOUT = "<4s4B4HL2L5H2L", "<4s2B4HL2L2H"
NONE16, NONE32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1
LONGEST_COMMENT = 65535


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a shared place and the path in it; the same names work on the driver and in tasks."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


@dataclass(frozen=True)
class Member:
    """One entry of a central directory."""

    name: str
    method: int
    crc: int
    size: int
    header: int


class ZipReader:
    """The directory of a ZIP file of ``size`` bytes, read through ``read(offset, length)`` only."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size

    def members(self) -> list[Member]:
        start, length, count = self._directory()
        raw, at, out = self.read(start, length), 0, []
        while len(out) < count:
            fields = struct.unpack_from(CENTRAL_LAYOUT, raw, at)
            if fields[0] != CENTRAL:
                raise ValueError("central directory is damaged")
            method, crc, packed, plain = fields[6], fields[9], fields[10], fields[11]
            n_name, n_extra, n_comment, offset = fields[12], fields[13], fields[14], fields[18]
            at += struct.calcsize(CENTRAL_LAYOUT)
            name, extra = raw[at : at + n_name].decode(), raw[at + n_name : at + n_name + n_extra]
            at += n_name + n_extra + n_comment
            wide = self._wide(extra)
            plain, packed, offset = (next(wide) if v == NONE32 else v for v in (plain, packed, offset))
            if method == 0 and plain != packed:
                raise ValueError(f"{name}: a stored member has two sizes")
            out.append(Member(name, method, crc, packed, offset))
        return out

    def data_start(self, member: Member) -> int:
        """Where the bytes of a stored member begin: behind its local header, whose extra field may differ."""
        if member.method:
            raise ValueError(f"{member.name} is deflated, so it cannot be read by ranges")
        n = struct.calcsize(LOCAL_LAYOUT)
        fields = struct.unpack(LOCAL_LAYOUT, self.read(member.header, n))
        if fields[0] != LOCAL:
            raise ValueError(f"{member.name}: no local header")
        return member.header + n + fields[-2] + fields[-1]

    def _directory(self) -> tuple[int, int, int]:
        n = struct.calcsize(END_LAYOUT)
        tail_start = max(0, self.size - n - LONGEST_COMMENT)
        tail = self.read(tail_start, self.size - tail_start)
        at = tail.rfind(END)
        while at >= 0 and (at + n > len(tail) or at + n + struct.unpack_from("<H", tail, at + n - 2)[0] != len(tail)):
            at = tail.rfind(END, 0, at)  # the mark may also stand in the comment
        if at < 0:
            raise ValueError("not a ZIP file")
        _, _, _, _, count, length, start, _ = struct.unpack_from(END_LAYOUT, tail, at)
        if count == NONE16 or NONE32 in (length, start):
            m = struct.calcsize(LOCATOR64_LAYOUT)
            mark, _, end64, _ = struct.unpack(LOCATOR64_LAYOUT, self.read(tail_start + at - m, m))
            if mark != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            fields = struct.unpack(END64_LAYOUT, self.read(end64, struct.calcsize(END64_LAYOUT)))
            if fields[0] != END64:
                raise ValueError("no ZIP64 directory")
            count, length, start = fields[7], fields[8], fields[9]
        return start, length, count

    @staticmethod
    def _wide(extra: bytes) -> Iterator[int]:
        """The 64-bit values of a ZIP64 extra field: those that the entry itself has no room for, in its order."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, at)
            if kind == EXTRA64:
                yield from struct.unpack_from(f"<{n // 8}Q", extra, at + 4)
                return
            at += 4 + n


def _record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page_of(record_id: str) -> int | None:
    digits = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def make_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response record with the payload, or a revisit record with the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Refers-To": _record_id(refers_to) if revisit else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in raw.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode() for k, _, v in pairs}


def parse_record(raw: bytes) -> dict:
    """The fields of one record; a payload that does not fit its digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    response = fields["warc-type"] == "response"
    length = int(_headers(http)["content-length"])
    if response and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"{fields['warc-record-id']}: the payload is damaged")
    return {
        "page_id": _page_of(fields["warc-record-id"]),
        "url": urllib.parse.unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
        "record_type": fields["warc-type"],
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": _page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload": payload if response else None,
    }


class _ArchiveWriter:
    """Collects records into WARC members and members into one ZIP file."""

    def __init__(self, folder: str, number: int, member_bytes: int):
        self.name = f"{folder}/part-{number:05d}-{uuid.uuid4().hex}.wacz"
        fs, path = store(self.name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.most, self.buffer, self.lines, self.parts, self.bytes = member_bytes, io.BytesIO(), [], 0, 0

    def add(self, page: int | None, record: bytes, level: int) -> None:
        packed = zlib.compressobj(level, wbits=31)
        body = packed.compress(record) + packed.flush()
        place = {"filename": f"data-{self.parts:05d}.warc.gz", "offset": self.buffer.tell(), "length": len(body)}
        self.lines.append(f"{_record_id(page)} {json.dumps(place)}\n")
        self.buffer.write(body)
        self.bytes += len(body)
        if self.buffer.tell() >= self.most:
            self._member()

    def _member(self) -> None:
        if self.buffer.tell():
            self.zip.writestr(f"archive/data-{self.parts:05d}.warc.gz", self.buffer.getvalue())
            self.buffer, self.parts = io.BytesIO(), self.parts + 1

    def close(self) -> tuple[str, int]:
        self._member()
        self.zip.writestr("indexes/index.cdxj", "".join(self.lines))
        self.zip.close()
        self.stream.close()
        return self.name, len(self.lines)


def with_targets(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: of equal payloads of ``least`` bytes or more, the row of the largest
    page_id is the one to refer to; ``refers_to`` is null in it, in smaller payloads and in payloads without a copy.

    Only digests are grouped, and the groups of two or more are written before they are joined, so a payload that a
    third of all pages share is split by the adaptive skew join.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")
    )
    hashed = rows.withColumn("digest", F.sha1("payload"))
    groups = hashed.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.filter("n > 1 AND target IS NOT NULL").select("digest", "target"), "warc-groups")
    other = ~F.col("page_id").eqNullSafe(F.col("target"))
    return hashed.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", F.when(other, F.col("target")).alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str | None = None, member_bytes: int = MEMBER_BYTES, archive_bytes: int = ARCHIVE_BYTES, level: int = 6, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Write one WARC record per row of ``page_id, url, html`` and return ``archive, records``: the finished archives.

    Null html is an empty payload, a null url has no target header, a null page_id an id without digits. Repeated rows
    are repeated records; if they share the largest page_id of their payload, each of them is a response. No rows: no
    archive. Other columns are left out. Files go to ``folder`` (default: a new one in the shared folder) under names
    of one attempt; only those that a finished task lists count, so a task that is run again does no harm.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out = TaskContext.get().partitionId(), None
        for batch in slices(batches, "payload"):
            done = []
            for row in batch.to_pylist():
                out = out or _ArchiveWriter(folder, number, member_bytes)
                revisit = row["refers_to"] is not None
                record = make_record(row["page_id"], row["url"], row["payload"].encode(), row["digest"], row["refers_to"], revisit, date)
                out.add(row["page_id"], record, level)
                if out.bytes >= archive_bytes:
                    done.append(out.close())
                    out = None
            if done:
                yield pa.RecordBatch.from_pydict({"archive": [d[0] for d in done], "records": [d[1] for d in done]})
        if out:
            name, n = out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n]})

    return stored(with_targets(pages).mapInArrow(run, "archive string, records long"), "warc-manifest")


def read_index(archives: DataFrame) -> DataFrame:
    """``archive, start, length``: the byte range of every record, from the ZIP directory and the index member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                fs, path = store(name)
                with fs.open_input_file(path) as file:
                    reader = ZipReader(lambda at, n, file=file: file.read_at(n, at), file.size())
                    members = {m.name: m for m in reader.members()}
                    starts = {n: reader.data_start(m) for n, m in members.items() if n.startswith("archive/")}
                    ranges = []
                    for m in (m for n, m in members.items() if n.startswith("indexes/")):
                        for line in file.read_at(m.size, reader.data_start(m)).decode().splitlines():
                            place = json.loads(line.partition(" ")[2])
                            ranges.append((starts[f"archive/{place['filename']}"] + place["offset"], place["length"]))
                for i in range(0, len(ranges), 4096):
                    part = ranges[i : i + 4096]
                    yield pa.RecordBatch.from_pydict({"archive": [name] * len(part), "start": [r[0] for r in part], "length": [r[1] for r in part]})

    return archives.select("archive").mapInArrow(run, "archive string, start long, length long")


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the ranges: type, digest, length and target from the headers, ``payload`` (null in a revisit) if wanted.

    Each range is read and unpacked for itself; an archive stays open while its ranges follow each other.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payload
    types = ["long", "string", "string", "long", "string", "long"] + ["binary"] * payload
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    wanted = pa.schema([(n, arrow[t]) for n, t in zip(names, types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                if r["archive"] != opened:
                    fs, path = store(r["archive"])
                    opened, file = r["archive"], fs.open_input_file(path)
                raw = zlib.decompress(file.read_at(r["length"], r["start"]), wbits=31)
                held += len(raw)
                row = parse_record(raw)
                if not payload:
                    del row["payload"]
                rows.append(row)
                if held > MEMBER_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, wanted)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, wanted)

    return index.select("archive", "start", "length").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the listed archives; archives are bounded in size, and each is read by one task."""
    n = max(1, archives.count())
    return read_records(read_index(archives.repartition(n)), payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    records = read_archives(write_archives(pages), payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
