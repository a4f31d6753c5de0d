"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

The writer makes one compressed member per record, in files of a bounded size in the shared folder; every attempt
of a task writes files of its own, and only those named in its result count.

The reader takes a file apart into members (or, if it is not compressed, into records by their version lines). A
record must have a complete head, its stated length, the closing blank lines and, where stated, the right digests.
When a check fails, the reader searches for the next member or version line that starts a valid record, goes on
from there, and reports the bytes between as a gap. Heads may have any length. Members are inflated as they are read:
records before a fault inside a member are kept, and only one record is held in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespark.llm.common import partitions
from salespark.session import shared_folder, ship_package, stage

VERSION = b"WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"  # fixed, so that reruns write equal archives
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
_READ, _HEAD, _PIECE = 1 << 20, 1 << 16, 1 << 14
_BEGIN, _MEMBER = b"WARC/1.", re.compile(re.escape(MAGIC))
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT_VERSION = re.compile(rb"\nWARC/1\.[01]\r\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of the shared folder as tasks see it, and the path in it."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


# --- writing


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]+", "%20", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return VERSION + "\r\n".join(head).encode() + END + block + END


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, label: str = "warc", least_bytes: int = 0, roll_bytes: int = 32 << 20) -> DataFrame:
    """Archive all pages; (path, bytes, records) of the files, as a table that is already written.

    pages needs page_id, url and html; other columns are ignored; null html is an empty payload. Of equal payloads
    of at least `least_bytes` bytes the smallest page_id is the response and all others are revisits of it. A null
    page_id is never the smallest unless all are null, then each is a response. Repeated rows of the smallest
    page_id are responses, each of them.
    """
    spark = pages.sparkSession
    ship_package(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload"))
    ids = stage(rows.select("page_id", "digest", "length"), f"{label}-digests")
    firsts = ids.where(F.col("length") >= least_bytes).groupBy("digest", "length").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    # revisits are settled among ids; payloads then meet them by page, so a payload that many pages share is no hot key
    revisits = stage(ids.join(firsts, ["digest", "length"]).where("page_id is null or page_id > refers_to").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct(), f"{label}-revisits")
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    folder = f"{shared_folder(spark).rstrip('/')}/salespark/{label}-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        stem, files, out, size, count = uuid.uuid4().hex, [], None, 0, 0

        def close() -> None:
            out.close()
            files.append((f"{folder}/{stem}-{len(files)}.warc.gz", size, count))

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    out, size, count = system.open_output_stream(f"{path}/{stem}-{len(files)}.warc.gz", compression=None), 0, 0
                data = member(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), refers_to.is_valid))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": [f[0] for f in files], "bytes": [f[1] for f in files], "records": [f[2] for f in files]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return stage(joined.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "path string, bytes long, records long"), f"{label}-files")


# --- reading


@dataclass
class Found:
    start: int
    end: int
    head: dict[str, str] | None  # None: a gap
    block: bytes = b""
    reason: str = ""


class Source:
    """Random access to the bytes of one file."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(n, self.size - at)))

    def has(self, at: int) -> bool:
        return at < self.size

    def forget(self, before: int) -> None:
        """Nothing before this place will be read again."""

    def find(self, pattern: re.Pattern[bytes], at: int, longest: int) -> int:
        """Where `pattern` (matches of at most `longest` bytes) occurs first from `at` on; the size if nowhere."""
        while at < self.size:
            piece = self.read(at, _READ)
            if hit := pattern.search(piece):
                return at + hit.start()
            if at + len(piece) >= self.size:
                break
            at += len(piece) - longest + 1
        return self.size


class Inflated:
    """The content of the member at a place of a file, inflated as far as it is asked for."""

    def __init__(self, source: Source, at: int):
        self.source, self.place = source, at
        self.machine, self.pending = zlib.decompressobj(31), b""
        self.held, self.base = bytearray(), 0
        self.marks = [(0, at)]  # how much there was when the file had been read up to a place
        self.ended = self.broken = False

    def places(self, at: int) -> tuple[int, int]:
        """Two places of the file between which content before `at` ended."""
        i = bisect_right(self.marks, (at, 0))
        i += i < len(self.marks) and self.marks[i][0] == at
        low, self.marks = self.marks[max(i - 1, 0)][1], self.marks[max(i - 1, 0) :]
        return low, next((place for size, place in self.marks if size >= at), self.consumed)

    @property
    def size(self) -> int:
        """How much there is; only known when all of it was asked for."""
        return self.base + len(self.held)

    @property
    def consumed(self) -> int:
        """The place in the file up to which the member was read."""
        return self.place - len(self.pending) - len(self.machine.unused_data)

    def _more(self) -> bool:
        if self.ended:
            return False
        piece = self.pending
        if not piece:
            piece = self.source.read(self.place, _PIECE)
            self.place += len(piece)
        before = self.machine.copy() if self.size or self.machine.unconsumed_tail else zlib.decompressobj(31)
        try:
            self.held += self.machine.decompress(piece, _READ)
            self.pending = self.machine.unconsumed_tail
            self.ended = self.machine.eof
            self.broken = not piece
            self.marks.append((self.size, self.consumed))
        except zlib.error:
            self._upto_fault(before, piece)
        self.ended |= self.broken
        return not self.broken

    def _upto_fault(self, machine: zlib._Decompress, piece: bytes) -> None:
        """Byte by byte, so that all that comes before the fault is kept and its place is known."""
        start = self.place - len(piece)
        self.broken = True
        try:
            for i in range(len(piece)):
                self.place = start + i + 1
                self.held += machine.decompress(piece[i : i + 1])
        except zlib.error:
            pass
        self.machine, self.pending = zlib.decompressobj(31), b""

    def has(self, at: int) -> bool:
        while self.size <= at and self._more():
            pass
        return self.size > at

    def read(self, at: int, n: int) -> bytes:
        self.has(at + n - 1)
        return bytes(self.held[at - self.base : at - self.base + n])

    def forget(self, before: int) -> None:
        if before - self.base > _READ:
            del self.held[: before - self.base]
            self.base = before

    def find(self, pattern: re.Pattern[bytes], at: int, longest: int) -> int:
        while self.has(at):
            if hit := pattern.search(self.held, at - self.base):
                return self.base + hit.start()
            at = max(at + 1, self.size - longest + 1)
            self.forget(at)
            if not self.has(self.size):
                break
        return self.size


def _head(source: Source | Inflated, at: int) -> tuple[dict[str, str], int] | None:
    """Fields by lower-case name, and the length of the head; None if no complete record head begins there.

    The head is read in growing pieces up to its blank line, the next version line or the end.
    """
    size, end, seen = _HEAD, -1, 0
    while end < 0:
        data = source.read(at, size)
        if not _VERSION_LINE.match(data):
            return None
        end = data.find(END, seen)
        following = _NEXT_VERSION.search(data, max(seen - 11, 0))
        if following and not 0 <= end < following.start() or end < 0 and not source.has(at + len(data)):
            return None
        seen, size = max(len(data) - len(END) + 1, 0), 2 * size
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return (fields, end + len(END)) if fields.get("content-length", "").isdecimal() and "warc-type" in fields else None


def _payload(block: bytes, head: dict[str, str]) -> bytes:
    return block.partition(END)[2] if head.get("content-type", "").startswith("application/http") else block


def _fault(head: dict[str, str], block: bytes) -> str:
    """What is wrong with a complete record; empty if nothing is."""
    checks = [("warc-block-digest", block)]
    if head["warc-type"] != "revisit":
        checks.append(("warc-payload-digest", _payload(block, head)))
    for name, data in checks:
        kind, _, digest = head.get(name, "").partition(":")
        if kind.lower() == "sha1" and digest.upper() not in (base32_sha1(data), hashlib.sha1(data).hexdigest().upper()):
            return name.removeprefix("warc-").replace("-", " ")
    return ""


def plain_records(source: Source | Inflated) -> Iterator[Found]:
    at, bad, reason = 0, None, ""
    while source.has(at):
        source.forget(at)
        parsed = _head(source, at)
        fault = "no record head"
        if parsed:
            head, skip = parsed
            length = int(head["content-length"])
            end = at + skip + length + len(END)
            fault = "" if source.has(end - 1) else "cut off"
            if not fault:
                block = source.read(at + skip, length)
                fault = "length" if source.read(end - len(END), len(END)) != END else _fault(head, block)
            if not fault:
                if bad is not None:
                    yield Found(bad, at, None, reason=reason)
                    bad = None
                yield Found(at, end, head, block)
                at = end
                continue
        if bad is None:
            bad, reason = at, fault
        at = source.find(_VERSION_LINE, at + 1, 10)
    if bad is not None:
        yield Found(bad, source.size, None, reason=reason)


def _begins_record(member: Inflated) -> bool:
    return member.read(0, len(_BEGIN)) == _BEGIN


def compressed_records(source: Source) -> Iterator[Found]:
    """Records and gaps. A record's place is its member's first byte and how far the member had been read by then."""
    at, bad, reason = 0, None, ""
    while at < source.size:
        member, upto, gaps, good = Inflated(source, at), at, [], False
        worth = _begins_record(member)
        for x in plain_records(member) if worth else ():
            if x.head is None:
                gaps.append(x)
                continue
            if not member.has(x.end) and member.broken:
                break  # the closing check right behind it failed
            if bad is not None:
                yield Found(bad, at, None, reason=reason)
                bad = None
            upto, end = member.places(x.end)
            end = member.consumed if member.ended and member.size == x.end else end
            yield from (Found(at, end, None, reason=g.reason) for g in gaps)
            yield Found(at, end, x.head, x.block)
            good = True
            gaps = []
        if worth and member.ended and not member.broken:
            if good:
                yield from (Found(at, member.consumed, None, reason=g.reason) for g in gaps)
            elif bad is None:
                bad, reason = at, gaps[0].reason
            at = member.consumed
            continue
        if bad is None:
            bad, reason = upto, "damaged member"
        at = source.find(_MEMBER, max(upto, at + 1), len(MAGIC))
    if bad is not None and bad < source.size:
        yield Found(bad, source.size, None, reason=reason)


def salvage(file: pa.NativeFile) -> Iterator[Found]:
    source = Source(file)
    # a damaged start doesn't decide: the kind is that of the first intact beginning
    line, at = source.find(_VERSION_LINE, 0, 10), source.find(_MEMBER, 0, len(MAGIC))
    while at < line:
        if _begins_record(Inflated(source, at)):
            return compressed_records(source)
        at = source.find(_MEMBER, at + 1, len(MAGIC))
    return plain_records(source)


READ_SCHEMA = "path string, start long, end long, kind string, type string, record_id string, refers_to string, uri string, payload_digest string, http_length long, payload binary, reason string"


def read_archives(files: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """Records and gaps of all files (column path; a null path is left out).

    kind is `record` or `gap`; a gap has its first byte, its end and the failed check as `reason`. A revisit has no
    payload; http_length is the length that its stored HTTP head states. An empty file has neither.
    """
    ship_package(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), *[(c, pa.string()) for c in ("kind", "type", "record_id", "refers_to", "uri", "payload_digest")], ("http_length", pa.int64()), ("payload", pa.binary()), ("reason", pa.string())])
        rows, held = [], 0
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, path = open_folder(uri)
                with system.open_input_file(path) as file:
                    for x in salvage(file):
                        head = x.head or {}
                        stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", x.block.partition(END)[0])
                        payload = _payload(x.block, head) if head and head.get("warc-type") != "revisit" else None
                        rows.append((uri, x.start, x.end, "record" if x.head else "gap", *[head.get(c) for c in ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-payload-digest")], int(stated[1]) if stated else None, payload, x.reason or None))
                        held += len(payload or b"") + 500
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spread = files.where("path is not null").select("path").repartition(partitions(files), "path")
    return spread.mapInArrow(read, READ_SCHEMA)


def page_records(records: DataFrame) -> DataFrame:
    """Per record of `write_archives`: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    page = lambda c: F.regexp_extract(F.col(c), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return records.where("kind = 'record'").select(
        page("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("http_length")).alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )
