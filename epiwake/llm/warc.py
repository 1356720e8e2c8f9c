"""WARC archives of web pages, and a salvage reader for damaged ones.

Writing: one record per page, each a gzip member of its own. Of records with equal payloads of at
least ``MIN_SHARED`` bytes the one with the smallest page_id is a response, the others are revisits
that refer to it and hold no payload. Payload digests are grouped with a pre-aggregated minimum; the
pages themselves are not shuffled by payload, only joined with their revisit target by id.

Reading: records are read one by one, also from a gzip member of several records. If a member or
record fails its checks, the reader searches for the next gzip member (or, in uncompressed archives
and inside a member, the next version line) that starts a valid record, goes on there, and logs the
skipped bytes as a quarantined gap. ``round_trip`` fails if an archive gives back another number of
records than its manifest states.

An archive is written under a name of its own task attempt, and the manifest names the archives of
the attempts that counted, so files of lost attempts are never read.

Defined results: a null html is an empty payload. Rows that repeat a page_id are records of their
own; the smallest page_id of equal payloads is the response in each of its rows. A null page_id is
written as an empty id and comes back as null; it is never the target of a revisit, and its record
is a response. Other columns are ignored; an empty table gives no archives.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiwake.session import shared_dir

from .common import Steps, arrow_rows

MIN_SHARED = 100
#: A new archive is begun after so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 16

_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record: a response with its HTTP block, or a revisit without payload."""
    shown = "" if page_id is None else str(page_id)
    digest = hashlib.sha256(payload).hexdigest()
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = _HTTP if refers_to is not None else _HTTP + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{shown}>",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """The record as one gzip member, the same bytes for the same record."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def page(self, header: str = "warc-record-id") -> int | None:
        found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", self.headers.get(header, ""))
        return int(found.group(1)) if found else None


@dataclass(frozen=True)
class Gap:
    start: int
    end: int
    reason: str


class Damage(Exception):
    """A record that fails a check."""


def _parsed(raw: bytes, offset: int) -> tuple[Record, int]:
    """The record at the start of ``raw`` and its length."""
    version = _VERSION.match(raw)
    if not version:
        raise Damage("no version line")
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise Damage("header does not end")
    headers: dict[str, str] = {}
    for line in raw[version.end():end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("bad header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "surrogateescape").strip()
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise Damage("bad length")
    stop = end + 4 + int(size)
    if raw[stop:stop + 4] != b"\r\n\r\n":
        raise Damage("record does not end at its length")
    block = raw[end + 4:stop]
    declared = headers.get("warc-block-digest", "")
    if declared.startswith("sha256:") and hashlib.sha256(block).hexdigest() != declared[7:]:
        raise Damage("block digest differs")
    record = Record(offset, headers, block)
    declared = headers.get("warc-payload-digest", "")
    if record.kind == "response" and declared.startswith("sha256:") and hashlib.sha256(record.payload).hexdigest() != declared[7:]:
        raise Damage("payload digest differs")
    return record, stop + 4


class _Inflated:
    """The unpacked bytes of the gzip member at the start of a reader's buffer, as a source.

    It ends at the end of the member or where the member is damaged; ``error`` then says how.
    """

    def __init__(self, reader: "SalvageReader"):
        self.reader, self.opened = reader, zlib.decompressobj(31)
        self.at, self.made, self.error = 0, 0, ""
        #: (bytes made, bytes taken) after each part that was unpacked.
        self.parts: list[tuple[int, int]] = []

    def read(self, size: int) -> bytes:
        while not self.error and not self.opened.eof:
            if not self.reader._fill(self.at + 1):
                self.error = "member is cut off"
                break
            part = bytes(self.reader.buffer[self.at:self.at + READ_BYTES])
            before = self.opened.copy() if self.at else zlib.decompressobj(31)
            try:
                out = self.opened.decompress(part)
            except zlib.error as error:
                self.error = f"gzip: {error}"
                return self._up_to_damage(before, part)
            self.at, self.made = self.at + len(part), self.made + len(out)
            self.parts.append((self.made, self.at))
            if out:
                return out
        return b""

    @staticmethod
    def _up_to_damage(opened, part: bytes) -> bytes:  # noqa: ANN001
        out = bytearray()
        with contextlib.suppress(zlib.error):
            for k in range(len(part)):
                out += opened.decompress(part[k:k + 1])
        return bytes(out)

    def release(self, made: int) -> None:
        """Drop the parts that only hold bytes before ``made``."""
        done = [at for end, at in self.parts if end <= made]
        if done and not self.opened.eof:
            self.reader._drop(done[-1])
            self.at -= done[-1]
            self.parts = [(end, at - done[-1]) for end, at in self.parts[len(done):]]


@dataclass
class SalvageReader:
    """Reads an archive from a stream of bytes; memory holds two records and a read buffer.

    ``most_record`` bounds what a damaged length or header can make it hold. Records of one member
    have the member's offset. A member's only record counts if the member ends well; of several, each
    counts whose own digests agree.
    """

    source: object
    most_record: int = 1 << 30
    gaps: list[Gap] = field(default_factory=list)
    #: Whether gzip members are opened; not inside of one.
    members: bool = True

    def __post_init__(self) -> None:
        self.buffer, self.base, self.ended = bytearray(), 0, False
        self.gap: tuple[int, str] | None = None

    def _fill(self, size: int) -> bool:
        """Whether the buffer holds ``size`` bytes after reading on."""
        while len(self.buffer) < size and not self.ended:
            part = self.source.read(max(READ_BYTES, size - len(self.buffer)))
            self.ended = not part
            self.buffer += part
        return len(self.buffer) >= size

    def _drop(self, size: int) -> None:
        del self.buffer[:size]
        self.base += size

    def _sound(self, offset: int) -> None:
        """A gap ends where the next sound record starts."""
        if self.gap:
            self.gaps.append(Gap(self.gap[0], offset, self.gap[1]))
            self.gap = None

    def _member(self) -> Iterator[Record]:
        """The records in the gzip member at the start of the buffer, which is dropped."""
        start, packed = self.base, _Inflated(self)
        inside = SalvageReader(packed, self.most_record, members=False)
        held, several = None, False
        for record in inside:
            record.offset = start
            if held is not None:
                self._sound(start)
                several = True
                yield held
                packed.release(inside.base)
            held = record
        if packed.error and not several:
            raise Damage(packed.error)
        if held is None:
            self.gap = self.gap or (start, inside.gaps[0].reason if inside.gaps else "member is empty")
        else:
            self._sound(start)
            yield held
        if packed.error:
            packed.release(inside.base)
        else:
            self._drop(packed.at - len(packed.opened.unused_data))
        if held is not None:
            # Where the member breaks off, the last gap goes on outside.
            inner = inside.gaps[:-1] if packed.error and inside.gaps and inside.gaps[-1].end == inside.base else inside.gaps
            self.gaps += [Gap(start, self.base, f"inside of a member: {gap.reason}") for gap in inner]
        if packed.error:
            raise Damage(packed.error)

    def _plain(self) -> Iterator[Record]:
        """The uncompressed record at the start of the buffer, which is dropped."""
        at = 0
        while (end := self.buffer.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(self.buffer) - 3)
            if len(self.buffer) > self.most_record or not self._fill(len(self.buffer) + 1):
                raise Damage("header does not end")
        size = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", self.buffer[:end + 2])
        if size is None or int(size.group(1)) > self.most_record:
            raise Damage("no usable length")
        self._fill(end + 8 + int(size.group(1)))
        record, used = _parsed(bytes(self.buffer[:end + 8 + int(size.group(1))]), self.base)
        self._sound(self.base)
        self._drop(used)
        yield record

    def _here(self) -> Iterator[Record]:
        if self.members and self.buffer[:3] == _MEMBER:
            return self._member()
        if _VERSION.match(self.buffer):
            return self._plain()
        raise Damage("neither a member nor a version line")

    def _next_start(self) -> int:
        """Offset in the buffer of the next possible start after its first byte; its end if there is none."""
        at = 1
        while True:
            packed, plain = self.buffer.find(_MEMBER, at) if self.members else -1, _VERSION.search(self.buffer, at)
            found = ([packed] if packed >= 0 else []) + ([plain.start()] if plain else [])
            if found:
                return min(found)
            # A start can lie across the end of what was read.
            self._drop(max(at, len(self.buffer) - 9))
            at = 0
            if not self._fill(len(self.buffer) + 1):
                return len(self.buffer)

    def __iter__(self) -> Iterator[Record]:
        while self._fill(1):
            self._fill(16)
            try:
                yield from self._here()
            except Damage as damage:
                self.gap = self.gap or (self.base, str(damage))
                # What is left of a broken member may be used up.
                if self._fill(1):
                    self._drop(self._next_start())
        self._sound(self.base)


def revisits(pages: DataFrame, least: int = MIN_SHARED) -> DataFrame:
    """(page_id, refers_to) of the pages that repeat the payload of a smaller page_id."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    seen = pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least)).select("page_id", F.sha2(payload, 256).alias("digest"))
    first = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    return seen.join(first, "digest").where("page_id <> refers_to").select("page_id", "refers_to", "digest").distinct()


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives and return the stored manifest (path, n_records, n_bytes)."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    own = pages.select("page_id", "url", "html", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256).alias("digest"))
    # A repeated page_id can have several payloads, so the target belongs to id and digest.
    marked = own.join(revisits(pages), ["page_id", "digest"], "left")

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        from pyarrow import fs

        context = TaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, records, size, number = None, "", 0, 0, 0
        try:
            for page_id, url, html, refers_to in stream:
                if out is None:
                    name = f"pages-{context.partitionId():06d}-{number:05d}-{context.taskAttemptId()}.warc.gz"
                    out, records, size, number = store.open_output_stream(f"{path}/{name}", compression=None), 0, 0, number + 1
                packed = member(record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to))
                out.write(packed)
                records, size = records + 1, size + len(packed)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield f"{folder}/{name}", records, size
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield f"{folder}/{name}", records, size

    manifest = arrow_rows(marked, ["page_id", "url", "html", "refers_to"], run, "path string, n_records long, n_bytes long")
    return Steps(spark, "warc-manifest").save(manifest, "manifest")


def read_archives(manifest: DataFrame, paths: str = "path", counts: str | None = None) -> DataFrame:
    """Every record of the archives, and a row for each quarantined gap.

    Archives are dealt out one by one and streamed, so a task holds few records at a time. With
    ``counts``, a column of the manifest, an archive that gives another number of records is an error.
    """
    spread = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.rdd.getNumPartitions())

    def run(stream: Iterator[tuple]) -> Iterable[tuple]:
        from pyarrow import fs

        for uri, *expected in stream:
            store, path = fs.FileSystem.from_uri(uri)
            read = 0
            with store.open_input_stream(path, compression=None) as source:
                reader = SalvageReader(source)
                for record in reader:
                    read += 1
                    if record.kind == "response":
                        size, digest = len(record.payload), hashlib.sha256(record.payload).hexdigest()
                    else:
                        length = record.headers.get("x-payload-length", "")
                        size = int(length) if length.isdigit() else None
                        digest = record.headers.get("warc-payload-digest", "").removeprefix("sha256:")
                    yield uri, record.offset, None, None, record.page(), record.headers.get("warc-target-uri"), record.kind, size, digest, record.page("warc-refers-to"), record.payload if record.kind == "response" else None
                for gap in reader.gaps:
                    yield uri, gap.start, gap.end, gap.reason, None, None, "gap", None, None, None, None
            if expected and expected[0] != read:
                raise ValueError(f"{uri}: {read} of {expected[0]} records could be read; {reader.gaps[:3]}")

    return arrow_rows(manifest.repartition(spread, paths), [paths, *([counts] if counts else [])], run,
                      "path string, at long, gap_end long, reason string, page_id long, url string, record_type string, "
                      "payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives, read these back, and return a row per page."""
    records = read_archives(write_archives(pages), counts="n_records")
    return records.where("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
