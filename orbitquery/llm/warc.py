"""WARC archives: a deduplicating writer and a salvage reader.

Every page becomes a response record, or a revisit where an earlier page has the
same payload.  Records are gzip members of their own, so that damage stays local.

The reader takes members and plain records in any mixture.  After a failed check it
searches for the next version line (in plain bytes and inside members) or the next
member, goes on from there, and logs the bytes between as a quarantined gap.  What a
member held before its damage is kept.  Records are given out as they are read, members
are decompressed in steps, and each pattern is searched once along the file.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, fresh_path, in_slices, read_bytes, small_batches, write_bytes

#: Payloads below this are never revisited; an archive is closed at this many bytes.
LEAST, ARCHIVE_BYTES = 100, 64 << 20
#: Copies of the list of repeated payloads that the rows of one payload are spread over.
SALTS = 32
#: Compressed bytes read, and plain bytes made, in one go; plain bytes that tell whether a member is one.
STEP, MADE, TRIED = 1 << 14, 1 << 20, 1 << 10
VERSION, MEMBER = b"WARC/1.", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


@dataclass
class Record:
    """start and end are bytes of the file; inside a member, where that starts and what of it was read, and inner is the offset in it."""

    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    inner: int | None = None


@dataclass
class Gap:
    """Quarantined bytes; for a gap inside a member, start and end are its decompressed bytes and member where it starts."""

    start: int
    end: int
    reason: str
    member: int | None = None


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    clean = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n"))
    return {k.strip().lower(): v.strip() for k, sep, v in pairs if sep}


_VERSION_LINE = re.compile(rb"WARC/1\.[0-9]+\r\n")
_NAMED = re.compile(rb"[^\s:]+[ \t]*:|[ \t]")


def parse_record(raw, at: int = 0, whole: bool = True) -> tuple[Record, int] | str | int:
    """The record that starts at a position and where it ends, or what is wrong with it.

    Of bytes that are not the whole stream, a number says how many are needed to tell.
    Header lines are looked at one by one, so that a false version line costs little.
    """
    top = _VERSION_LINE.match(raw, at)
    if not top:
        return len(raw) + 1 if not whole and len(raw) - at < 16 else "no version line"
    line = top.end()
    while True:
        stop = raw.find(b"\r\n", line)
        if stop < 0:
            return "unfinished headers" if whole else len(raw) + 1
        if stop == line:
            break
        if not _NAMED.match(raw, line, stop):
            return "malformed headers"
        line = stop + 2
    headers = _fields(bytes(raw[top.end():stop]))
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return "no length"
    begin, end = stop + 2, stop + 2 + int(size)
    if end + 4 > len(raw) and not whole:
        return end + 4
    if raw[end:end + 4] != b"\r\n\r\n":
        return "wrong length"
    block = bytes(raw[begin:end])
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha256:") and hashlib.sha256(block).hexdigest() != want[7:]:
        return "block digest"
    record = Record(at, end + 4, headers)
    if headers.get("content-type", "").startswith("application/http"):
        top, _, record.payload = block.partition(b"\r\n\r\n")
        record.http = _fields(top.partition(b"\r\n")[2])
    else:
        record.payload = block
    want = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and want.startswith("sha256:") and hashlib.sha256(record.payload).hexdigest() != want[7:]:
        return "payload digest"
    return record, end + 4


class Plain:
    """Records and gaps of a stream of decompressed bytes; holds no more than the record being read."""

    def __init__(self):
        self.held, self.base, self.need, self.gap = bytearray(), 0, 0, None

    def feed(self, data: bytes, last: bool = False) -> Iterator[Record | Gap]:
        self.held += data
        at = 0
        while at < len(self.held) and (last or len(self.held) >= self.need):
            got = parse_record(self.held, at, last)
            if isinstance(got, int):
                self.need = got - at
                break
            if isinstance(got, str):
                if self.gap is None:
                    self.gap = (self.base + at, got)
                next_ = self.held.find(VERSION, at + 1)
                at = next_ if next_ >= 0 else len(self.held) if last else max(at + 1, len(self.held) - len(VERSION) + 1)
                continue
            yield from self._closed(at)
            got[0].inner = self.base + at
            yield got[0]
            at = got[1]
        if at:
            del self.held[:at]
            self.base += at
        if last:
            yield from self._closed(0)

    def _closed(self, at: int) -> Iterator[Gap]:
        if self.gap is not None:
            yield Gap(self.gap[0], self.base + at, self.gap[1])
            self.gap = None


class Bytes:
    """The bytes of a file, with the next place of each pattern kept: it is searched again only when that is passed."""

    def __init__(self, raw: bytes):
        self.raw, self.next = raw, {}

    def find(self, pattern: bytes, at: int) -> int:
        """Where the pattern stands next, or the end of the file."""
        known, since = self.next.get(pattern, (-1, 0))
        if not since <= at <= known:
            known = self.raw.find(pattern, at)
            known = len(self.raw) if known < 0 else known
            self.next[pattern] = (known, at)
        return known

    def deflated(self, at: int) -> int | None:
        """Where the compressed data of a gzip member begins, or None for what is no member."""
        raw, flags, begin = self.raw, self.raw[at + 3] if at + 10 <= len(self.raw) else 0xFF, at + 10
        if flags & 0xE0:
            return None
        if flags & 4:
            begin += 2 + int.from_bytes(raw[begin:begin + 2], "little")
        for flag in (8, 16):
            if flags & flag:
                begin = self.find(b"\0", begin) + 1
        begin += 2 * bool(flags & 2)
        try:
            if begin < len(raw):
                zlib.decompressobj(-15).decompress(memoryview(raw)[begin:begin + TRIED], TRIED)
                return begin
        except zlib.error:
            pass
        return None


def _inflate(raw: bytes, at: int) -> Iterator[tuple[bytes, int, str | None]]:
    """Pieces of a deflate stream as (bytes, end of the input used, what went wrong)."""
    unzip, view = zlib.decompressobj(-15), memoryview(raw)
    while not unzip.eof:
        if at >= len(raw):
            yield unzip.flush(), at, "unfinished member"
            return
        before, given = unzip.copy(), view[at:at + STEP]
        try:
            made = unzip.decompress(given, MADE)
        except zlib.error as e:
            # Byte by byte, so that nothing made before the damage is lost.
            made = bytearray()
            try:
                for k in range(len(given)):
                    made += before.decompress(given[k:k + 1])
            except zlib.error:
                pass
            yield bytes(made), at + k, f"damaged member: {str(e)[:60]}"
            return
        at += len(given) - len(unzip.unconsumed_tail) - len(unzip.unused_data)
        if made or unzip.eof:
            yield made, at, None


def _member(file: Bytes, at: int, begin: int) -> Iterator[Record | Gap | tuple[int, str | None]]:
    """Records and gaps inside a member; last, where it ends and what was wrong with it."""
    inner, size, crc, end, wrong, some = Plain(), 0, 0, begin, None, []

    def own(found):
        for x in found:
            if isinstance(x, Record):
                x.start, x.end = at, end
            else:
                x.member = at
            yield x

    for made, end, wrong in _inflate(file.raw, begin):
        size, crc = size + len(made), zlib.crc32(made, crc)
        # A record is held until the next piece is made, so that the last one learns where the member ends.
        for x in own(inner.feed(made)):
            yield from some
            some = [x]
    for x in own(inner.feed(b"", True)):
        yield from some
        some = [x]
    if wrong is None:
        check, end = file.raw[end:end + 8], min(end + 8, len(file.raw))
        if check != struct.pack("<II", crc, size & 0xFFFFFFFF):
            wrong = "member check"
    for x in some:
        if isinstance(x, Record):
            x.end = end
        yield x
    yield end, wrong


def salvage(raw: bytes) -> Iterator[Record | Gap]:
    """All whole records of an archive in order, gzip or plain or both, and the gaps between them.

    A member whose own check fails gives the records that pass theirs, and a gap.  Bytes
    that are neither are one gap; an empty archive gives nothing.
    """
    file, at, gap = Bytes(raw), 0, None

    def closed(to: int) -> Iterator[Gap]:
        nonlocal gap
        if gap is not None:
            yield Gap(min(gap[0], to), to, gap[1])
            gap = None

    while at < len(raw):
        reason, search = "no record", at + 1
        if raw.startswith(MEMBER, at) and (begin := file.deflated(at)) is not None:
            found, before, end, wrong = False, [], at, None
            for x in _member(file, at, begin):
                if isinstance(x, tuple):
                    end, wrong = x
                elif found:
                    yield x
                else:  # a member without any record is one gap, whatever is inside
                    before.append(x)
                    if isinstance(x, Record):
                        found = True
                        yield from closed(at)
                        yield from before
            if wrong is None and found:
                at = end
                continue
            if wrong is None or wrong == "member check":  # its end is known: what follows is read as usual
                gap = gap or (max(at, end - 8) if found else at, wrong or "no record in member")
                at = end
                continue
            reason = wrong
            if found:
                gap = (end, wrong)
        elif raw.startswith(VERSION, at):
            got = parse_record(raw, at)
            if not isinstance(got, str):
                yield from closed(at)
                yield got[0]
                at = got[1]
                continue
            reason = got
        if gap is None:
            gap = (at, reason)
        at = min(file.find(MEMBER, search), file.find(VERSION, search))
    yield from closed(len(raw))


def typed_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_digest, is_revisit, refers_to of every page.

    The rows of a common payload are spread over SALTS keys; the list of payloads that
    occur more than once has one row for each, so it is copied that often.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    )
    digest = F.sha2("payload", 256)
    keys = rows.where(F.octet_length("payload") >= least).groupBy(digest.alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = Table(keys.where("n > 1 and first is not null").select("d", "first"), "payloads").df
    spread = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.select("*", digest.alias("payload_digest"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = salted.join(spread, (salted.payload_digest == spread.d) & (salted.salt == spread.salt), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_digest", again.alias("is_revisit"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, compress: bool = True, least: int = LEAST) -> DataFrame:
    """Write each page as a record; returns the manifest (path, n_records, n_bytes).

    A null html is an empty payload, a null url about:blank, a null page_id is left out of
    the headers; repeated rows are written each.  Rows that share a payload's smallest
    page_id are all responses.
    """
    small_batches(pages.sparkSession)
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def run(batches):
        task = TaskContext.get()
        part, seq, held, size = task.partitionId(), 0, [], 0

        def close():
            nonlocal seq, held, size
            # The attempt is in the name: a task run twice never writes over what the manifest may name.
            path = f"{folder}/part-{part:06d}-{seq:06d}-{task.taskAttemptId()}.warc" + ".gz" * compress
            write_bytes(path, b"".join(held))
            row = pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(held)], "n_bytes": [size]})
            seq, held, size = seq + 1, [], 0
            return row

        for batch in batches:
            for few in in_slices(batch):
                for page_id, url, payload, digest, revisit, refers_to in zip(*(c.to_pylist() for c in few.columns), strict=True):
                    raw = make_record(page_id, url, payload, digest, refers_to, revisit)
                    if compress:
                        zipper = zlib.compressobj(4, zlib.DEFLATED, 31)
                        raw = zipper.compress(raw) + zipper.flush()
                    held.append(raw)
                    size += len(raw)
                    if size >= ARCHIVE_BYTES:
                        yield close()
        if held:
            yield close()

    return Table(typed_pages(pages, least).mapInArrow(run, "path string, n_records long, n_bytes long"), "archives").df


_ROW = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("inner", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def _whole(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _row(path: str, x: Record | Gap) -> tuple:
    if isinstance(x, Gap):
        return (path, x.start, x.end, x.member, x.reason, *[None] * 7)
    size = _whole(x.http.get("content-length")) if x.http else len(x.payload)
    return (path, x.start, x.end, x.inner, None, _whole(x.headers.get("x-page-id")), x.headers.get("warc-target-uri"), size,
            x.headers.get("warc-payload-digest", "").removeprefix("sha256:"), x.headers.get("warc-type"), _whole(x.headers.get("x-refers-to-page")), x.payload)


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row for each record, and for each quarantined gap (gap holds the reason, the record's columns are null).

    start and end are bytes of the file; inner is a record's offset in its gzip member (null
    in plain bytes).  For a gap inside a member inner is the member's place in the file and
    start and end count its decompressed bytes.  Only `path` of the manifest is read: an
    empty one gives no rows, an empty file none, a path listed twice its rows twice, and a
    null path or a missing file is an error.
    """
    n = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    shape = pa.schema(list(_ROW)[: None if keep_payload else -1])

    def run(batches):
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=False)], schema=shape)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for x in salvage(read_bytes(path)):
                    rows.append(_row(path, x)[: len(shape)])
                    held += len(x.payload) if keep_payload and isinstance(x, Record) else 0
                    if len(rows) >= 1000 or held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return manifest.select("path").repartition(n).mapInArrow(run, ", ".join(f"`{f.name}` {kinds[f.type]}" for f in shape))
