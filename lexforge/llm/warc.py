"""WARC archives: a writer with revisit records, and a salvage reader.

write(): one record a row, gzip member by member. Among records with equal payloads of LEAST bytes or more, that of the
largest id is a response; the others revisit it. Archives are kept as rows (archive, content) of about ARCHIVE_BYTES, so
that any file system that Spark reaches can hold them; Spark's binaryFile source gives the same rows from real files.

read(): the salvage reader. A record counts if its member unpacks with a right checksum, its head parses, its block has
the announced length and its payload has the announced digest. After a failed check the reader searches from the next
byte for a valid gzip member or a version line, goes on there, and logs the gap in bytes as quarantined. Inside a
member that breaks off, what was unpacked so far is searched for whole records first.

Defined cases: a null payload counts as empty; null ids are written as such and come back as null, and never
are a response that others revisit unless no id is there at all (then each is a response); repeated rows give as many
records; an empty table gives no archive and no record; columns of other names are ignored. No bytes make read() fail: what
doesn't parse, numbers beyond 15 digits included, is part of a gap, and a digest or id that
isn't one is null. Heads and lines may have any length. An archive is handled in one task's memory: ARCHIVE_BYTES and the largest single record.
A member is unpacked piece by piece; only a record that is not complete yet is held. One of over MEMBER_BYTES, more than a row of Spark can have,
is none: the records before it stand, and its member counts as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import materialize

LEAST, ARCHIVE_BYTES, MEMBER_BYTES = 1000, 8 << 20, 1 << 31
GZIP_HEAD_BYTES = 4096
#: A member that unpacks to no more is unpacked once; a larger one twice, first to learn whether it is whole.
HELD_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NOBODY = uuid.UUID(int=(1 << 64) - 1 << 64)  # of a null id
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NUMBER = re.compile(r"[0-9]{1,15}")
_HTTP_LENGTH = re.compile(rb"(?i)\ncontent-length:[ \t]{0,64}([0-9]{1,15})[ \t]{0,64}\r?(?:\n|$)")
_MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
DATE = "2024-01-01T00:00:00Z"


def record_id(key: int | None) -> str:
    """A record's id holds the row's id in its low 64 bits; the others are 0."""
    return f"<urn:uuid:{NOBODY if key is None else uuid.UUID(int=key & (1 << 64) - 1)}>"


def key_of(record: str | None) -> int | None:
    try:
        number = uuid.UUID((record or "").strip().removeprefix("<urn:uuid:").removesuffix(">")).int
    except ValueError:
        return None
    return None if number >> 64 else number - (1 << 64) if number >> 63 else number  # another writer's id isn't a row's


def record(key: int | None, uri: str | None, payload: bytes, revisits: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, which tells the full length, and leaves the body away."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits is not None else http + payload
    uri = re.sub(r"\s", "", uri or "") or "about:blank"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if revisits is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    if revisits is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(revisits)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


# ---- writing


def planned(pages: DataFrame, key: str, uri: str, payload: str, least: int = LEAST) -> DataFrame:
    """(key, uri, payload, revisits): revisits is the response's key, or null.

    Only payloads that recur are joined with their response: one row for each such digest, combined before the shuffle.
    A join by digest may be skewed, which adaptive execution splits on the side of the pages.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(uri).cast("string").alias("uri"), body.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.unhex(F.sha1("payload"))))
    kept = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.max("key").alias("response"), F.count("*").alias("n")).filter("n > 1 and response is not null")
    kept = materialize(kept.select("digest", "response"))  # as a table: only a join of two exchanges is split where it is skewed
    joined = rows.join(kept, "digest", "left")
    return joined.select("key", "uri", "payload", F.when(~F.col("key").eqNullSafe(F.col("response")), F.col("response")).alias("revisits"))


def archives(plan: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): the records of each partition, a new archive after archive_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "content"])

        for b in batches:
            for k in range(b.num_rows):
                one = record(*(b.column(c)[k].as_py() for c in range(4)))
                held.append(one)
                size += len(one)
                if size >= archive_bytes:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    return plan.select("key", "uri", "payload", "revisits").mapInArrow(run, "archive string, content binary")


def write(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = LEAST) -> None:
    archives(planned(pages, key, uri, payload, least)).write.parquet(path)


def load(spark: SparkSession, path: str, files: bool = False) -> DataFrame:
    """(archive, content) of what write() left, or of .warc and .warc.gz files."""
    if files:
        return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")
    return spark.read.schema("archive string, content binary").parquet(path)


# ---- reading


@dataclass
class Found:
    """A record at a byte of its archive, or (kind None) a quarantined gap."""

    offset: int
    size: int
    kind: str | None
    head: dict[str, str] | None = None
    payload: bytes | None = None
    reason: str = ""


class _More(Exception):
    """The data ends before the record does."""


@dataclass
class _Bad:
    """Why no record stands at a byte, and from where on another one may: its head is not read again for each version line in it."""

    reason: str
    resume: int


def _one(data: bytes, at: int, last: bool = True) -> tuple[dict[str, str], bytes, int] | _Bad:
    """The plain record at a byte: its head, its block and where it ends; or why there is none. last: no more data follows."""
    if not _VERSION.match(data, at):
        if not last and len(data) - at < 10:
            raise _More
        return _Bad("no version line or head", at + 1)
    head, places, begin = {}, {}, at + 10
    while (end := data.find(b"\r\n", begin)) > begin:
        line = data[begin:end]
        name, colon, value = line.partition(b":")
        if not colon or b"\r" in line or b"\n" in line:
            return _Bad("head", begin)  # any head that begins before this line fails here as well
        field = name.strip().lower().decode("latin-1")
        head[field], places[field] = value.strip().decode("utf-8", "replace"), begin
        begin = end + 2
    if end < 0:
        if not last:
            raise _More
        return _Bad("no version line or head", begin)
    first = begin + 2
    if not _NUMBER.fullmatch(head.get("content-length", "")):
        return _Bad("length", begin)
    end = first + int(head["content-length"])
    if end + 4 > len(data) and not last:
        if end - at > MEMBER_BYTES:
            return _Bad("too large", begin)
        raise _More
    if data[end : end + 4] != b"\r\n\r\n":
        return _Bad("length", begin)
    block = bytes(data[first:end])
    payload = _payload(head, block)
    claimed = head.get("warc-payload-digest", "")
    if http := _HTTP_LENGTH.search(block.partition(b"\r\n\r\n")[0]):
        head["http content-length"] = http[1].decode()
    if head.get("warc-type") == "response" and claimed.startswith("sha1:") and base64.b32encode(hashlib.sha1(payload).digest()).decode() != claimed[5:]:
        return _Bad("digest", min(places["warc-type"], places["warc-payload-digest"]))  # a head cut short may run into a whole one
    return head, block, end + 4


class _Inner:
    """The records and gaps inside a member, whose unpacked pieces are fed one by one."""

    def __init__(self) -> None:
        self.held, self.begin, self.gaps, self.need = bytearray(), 0, [], 0
        self.too_large = False

    def feed(self, piece: bytes, last: bool = False) -> Iterator[tuple[dict, bytes]]:
        """(head, block) of each record that is complete by now. gaps gets (start, end, reason); neighbours are joined."""
        self.held += piece
        if len(self.held) < self.need and not last:
            return
        at, data = 0, self.held
        while at < len(data):
            try:
                got = _one(data, at, last)
            except _More:
                break
            if isinstance(got, _Bad):
                self.too_large |= got.reason == "too large"
                following = _VERSION.search(data, max(got.resume, at + 1))
                end = following.start() if following else len(data) if last else max(len(data) - 9, at)  # a version line may be cut in two
                if end == at:
                    break
                self._gap(self.begin + at, self.begin + end, got.reason)
                at = end
            else:
                yield got[0], got[1]
                at = got[2]
        self.begin += at
        del data[:at]
        self.need = 2 * len(data)  # so that what is held is looked at seldom

    def _gap(self, start: int, end: int, reason: str) -> None:
        if self.gaps and self.gaps[-1][1] == start:
            self.gaps[-1] = (self.gaps[-1][0], end, self.gaps[-1][2])
        else:
            self.gaps.append((start, end, reason))


def _before(unpack, step: bytes) -> Iterator[bytes]:
    """What a step that fails unpacks to before the error: in halving pieces, then the failing byte's output byte by byte."""
    at, size = 0, len(step)
    while size and at < len(step):
        kept = unpack.copy()
        try:
            piece = unpack.decompress(step[at : at + size])
            at += size
            yield piece
        except zlib.error:
            unpack, size = kept, size // 2
    one = step[at : at + 1]
    out = bytearray()
    try:
        while got := unpack.decompress(one, 1):
            out += got
            one = unpack.unconsumed_tail
    except zlib.error:
        pass
    yield bytes(out)


def _gzip_head(data: bytes, at: int) -> int:
    """Where a gzip header of at most GZIP_HEAD_BYTES at a byte ends, else 0: its optional parts must end in time."""
    if data[at + 2 : at + 3] != b"\x08" or len(data) < at + 10 or data[at + 3] > 31:
        return 0
    flags, end, most = data[at + 3], at + 10, at + GZIP_HEAD_BYTES
    if flags & 4:
        end += 2 + int.from_bytes(data[end : end + 2], "little")
    for bit in (8, 16):  # a name and a comment, each up to a zero byte
        if flags & bit:
            if end >= most or (zero := data.find(b"\0", end, most)) < 0:
                return 0
            end = zero + 1
    end += 2 * (flags >> 1 & 1)
    return end if end <= min(most, len(data)) else 0


def _deflates(data: bytes, at: int) -> bool:
    """Whether a deflate stream may begin at a byte: a kind of block that exists, and a stored one's length as it says twice."""
    kind = data[at] >> 1 & 3 if at < len(data) else 0
    low, high = (int.from_bytes(data[k : k + 2], "little") for k in (at + 1, at + 3))
    return kind in (1, 2) or kind == 0 and (at + 5 > len(data) or low ^ high == 0xFFFF)


def _unpacked(data: bytes, at: int) -> Iterator[bytes | tuple[int, str]]:
    """What the gzip member at a byte unpacks to, piece by piece; at last its end, and what is wrong ('' if nothing). Output before an error is kept.

    Steps grow, so that bytes that only look like a member cost little.
    """
    first = _gzip_head(data, at)
    if not first or not _deflates(data, first):
        yield at, "member"
        return
    unpack, k, step = zlib.decompressobj(31), at, 1 << 7
    while k < len(data):
        kept, rest = unpack.copy(), data[k : k + step]
        try:
            piece = b"-"
            while (rest or len(piece) == PIECE_BYTES) and not unpack.eof:
                piece, rest = unpack.decompress(rest, PIECE_BYTES), unpack.unconsumed_tail
                if rest:
                    kept = unpack.copy()
                yield piece
        except zlib.error:
            yield from _before(kept, rest)
            yield at, "member"
            return
        k, step = k + step, min(2 * step, 1 << 16)
        if unpack.eof:
            yield min(k, len(data)) - len(unpack.unused_data), ""
            return
    yield at, "member breaks off"


def _member(data: bytes, at: int) -> tuple[int, str, Iterator[tuple[dict, bytes]], _Inner]:
    """The end of the gzip member at a byte, what is wrong ('' if nothing), its records, and what tells their gaps once they are read."""
    pieces, size, end, why = [], 0, at, ""
    for piece in _unpacked(data, at):
        if isinstance(piece, tuple):
            end, why = piece
        else:
            size += len(piece)
            pieces.append(piece)
            if size > HELD_BYTES:
                pieces.clear()
    inner = _Inner()

    def records() -> Iterator[tuple[dict, bytes]]:
        for piece in pieces if size <= HELD_BYTES else _unpacked(data, at):
            if not isinstance(piece, tuple):
                yield from inner.feed(piece)
        yield from inner.feed(b"", last=True)

    return end, why, records(), inner


def salvage(data: bytes) -> Iterator[Found]:
    """The records of an archive in order, and its gaps. Plain and gzip parts may alternate."""
    at, bad, why, member, version = 0, None, "", -1, -1

    def gap(end: int) -> Iterator[Found]:
        if bad is not None and end > bad:
            yield Found(bad, end - bad, None, reason=why)

    while at < len(data):
        end, got, reason, resume = at, None, "no member or version line", at + 1
        if data[at : at + 2] == b"\x1f\x8b":
            end, reason, records, inner = _member(data, at)
            some = False
            for head, block in records:
                if not some and not reason:
                    yield from gap(at)
                    bad = None
                some = True
                yield Found(at, max(end - at, 0), head.get("warc-type", ""), head, _payload(head, block))
            if inner.too_large:
                reason = reason or "member too large"
            if not reason and not some:
                reason = inner.gaps[0][2] if inner.gaps else "empty member"
            elif not reason:
                yield from (Found(at, end - at, None, reason="member too large" if e - s > MEMBER_BYTES else f"inside a member: {r}, {e - s} bytes") for s, e, r in inner.gaps)
                at = end
                continue
        elif data[at : at + 5] == b"WARC/":
            one = _one(data, at)
            if isinstance(one, _Bad):
                reason, resume = one.reason, max(one.resume, at + 1)
            else:
                end, reason = one[2], ""
                got = Found(at, end - at, one[0].get("warc-type", ""), one[0], _payload(one[0], one[1]))
        if got is not None:
            yield from gap(at)
            bad = None
            yield got
            at = end
            continue
        if bad is None:
            bad, why = at, reason
        # a place found before is still the next one, unless it is passed
        member = _next(_MEMBER, data, at + 1) if member <= at else member
        version = _next(_VERSION, data, resume) if version < resume else version
        at = min(member, version)
    yield from gap(len(data))


def _next(what: re.Pattern, data: bytes, at: int) -> int:
    """The next byte where a member, or a version line, may begin, else the end."""
    found = what.search(data, at)
    return found.start() if found else len(data)


def _payload(head: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block


FIELDS = "archive string, offset long, size long, record_type string, key long, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary, reason string"


def read(stored: DataFrame, payloads: bool = True) -> DataFrame:
    """FIELDS of every record, and of every gap (record_type null, with the reason), of rows (archive, content).

    payload_bytes and payload_digest are those of the full payload: of a revisit, as its heads tell.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for k in range(b.num_rows):
                rows, size = [], 0
                for f in salvage(b.column(1)[k].as_py() or b""):
                    rows.append((b.column(0)[k].as_py(), f.offset, f.size, *_fields(f, payloads)))
                    size += len(f.payload or b"")
                    if size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return stored.select("archive", "content").mapInArrow(run, FIELDS)


def _fields(f: Found, payloads: bool) -> tuple:
    if f.kind is None:
        return (None,) * 7 + (f.reason,)
    head, size = f.head, len(f.payload)
    claimed = head.get("warc-payload-digest", "")
    digest = hashlib.sha1(f.payload).hexdigest()
    if f.kind == "revisit":
        size = int(head["http content-length"]) if "http content-length" in head else None
        try:
            digest = base64.b32decode(claimed.removeprefix("sha1:")).hex()
        except ValueError:
            digest = None
    return f.kind, key_of(head.get("warc-record-id")), head.get("warc-target-uri"), size, digest, key_of(head.get("warc-refers-to")), f.payload if payloads else None, f.reason or None

