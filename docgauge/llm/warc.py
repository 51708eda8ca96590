"""Web archives (WARC 1.1, one gzip member for each record): writing, and reading in parts.

Both ways go through Spark's own text files, so that archives lie in any store that Spark
reaches and only whole tasks are committed:

* Writing: rows are pieces of about a MB of whole gzip members.  The text writer ends each row
  with its line separator, here an *empty gzip member*, which is legal anywhere in an archive.
* Reading: the line separator is the gzip magic.  Spark cuts a file into byte ranges; a task
  scans its range for the magic and owns what begins inside, reading beyond its end where
  need be.  A candidate counts as a member if its gzip header is sound, its first bytes begin
  a WARC record, and its data ends just before the next magic with the right checksum.

The magic may also stand inside compressed data, and a payload may hold an archive of its own.
A file is certain if every range begins with a member and ends with the end of one: the
first range begins at the start of the file, so by induction no range has begun inside a
member.  A first pass checks this for all ranges.  Files of which a range is open (a few in a
hundred: a chance magic behind the end of a range, damage, members that hold many records) are
read once more, each in one stream.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm.stage import cleaned, stored

MAGIC = b"\x1f\x8b\x08"
#: A gzip member of no bytes; ends each piece of an archive.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x02\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 100
_PIECE = 1 << 20
#: Bytes that a member unfolds at a time.
_STEP = 1 << 22
_GAP = b"\r\n\r\n"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORDS = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Records of pages (page_id, url, html): page_id, url, payload, payload_digest, payload_bytes, refers_to.

    Of equal payloads of at least ``least`` bytes that of the smallest page_id is whole, the
    others refer to it.  A null html is an empty payload.  Null page_ids come after all others;
    if a payload has no other, each is whole.  Rows that share the smallest page_id are all
    whole.  Only digests are grouped; a digest that very many pages share is one row of the
    smaller side of a join, whose larger side Spark can split.
    """
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), text.alias("payload"), F.sha2(text, 256).alias("payload_digest"), F.octet_length(text).cast("long").alias("payload_bytes"))
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = stored(groups.filter("n > 1 AND first IS NOT NULL").drop("n"), "warc-firsts")
    return rows.join(firsts.hint("merge"), "payload_digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def _member(record_id: str, refers_to: str | None, uri: str | None, payload: bytes, digest: str, size: int, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:  # characters that would end the field are escaped
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_IDENTICAL}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + _GAP + block + _GAP) + packer.flush()


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", prefix: str = "urn:page:") -> None:
    """Writes a record for each row of with_revisits() to archives in the folder path, one for each task.

    An empty table gives archives without records.  Null page_ids are written as ``none``;
    a null url leaves the field out.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*[b.column(c) for c in ("page_id", "refers_to", "url", "payload", "payload_digest", "payload_bytes")], strict=True):
                page, first, url, payload, digest, n = (x.as_py() for x in row)
                name = lambda i: f"{prefix}{'none' if i is None else i}"
                held.append(_member(name(page), None if first is None else name(first), url, payload, digest, n, date))
                size += len(held[-1])
                if size >= _PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["piece"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["piece"])

    columns = ["page_id", "refers_to", "url", F.col("payload").cast("binary").alias("payload"), "payload_digest", "payload_bytes"]
    pieces = records.select(*columns).mapInArrow(packed, "piece binary").select(F.col("piece").cast("string").alias("value"))
    with cleaned(pieces.sparkSession):
        pieces.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


class _Fault(ValueError):
    """What is no WARC record or no gzip member."""


class _Member:
    """One gzip member, read piece by piece; add() gives the records that are whole by then."""

    def __init__(self):
        self.unpack, self.data, self.seen, self.head = zlib.decompressobj(31), bytearray(), 0, None

    def add(self, piece: bytes) -> Iterator[tuple]:
        try:
            while True:  # in steps, so that data which unfolds enormously is taken record by record
                made = self.unpack.decompress(piece, _STEP)
                self.data += made
                piece = self.unpack.unconsumed_tail
                yield from self._records()
                if self.unpack.eof or not piece and len(made) < _STEP:
                    break
        except zlib.error as e:
            raise _Fault(str(e)) from e
        if self.unpack.unused_data:
            raise _Fault("bytes behind a member")
        if self.unpack.eof and (self.head or self.data):
            raise _Fault("a record breaks off")

    def _records(self) -> Iterator[tuple]:
        while True:
            if self.head is None:
                if self.data[:5] != b"WARC/"[: len(self.data)]:
                    raise _Fault("no WARC record")
                at = self.data.find(_GAP, max(0, self.seen - 3))
                if at < 0:
                    self.seen = len(self.data)
                    return
                lines = self.data[:at].decode("utf-8", "replace").split("\r\n")[1:]
                self.head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                del self.data[: at + 4]
                if not self.head.get("content-length", "").isdecimal():
                    raise _Fault("a record without length")
            n = int(self.head["content-length"])
            if len(self.data) < n + 4:
                return
            if self.data[n : n + 4] != _GAP:
                raise _Fault("a record of wrong length")
            yield _row(self.head, bytes(self.data[:n]))
            del self.data[: n + 4]
            self.head, self.seen = None, 0


def _row(head: dict[str, str], block: bytes) -> tuple:
    bare = lambda k: head[k].strip("<>") if k in head else None
    payload, size = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(_GAP)
        size = len(payload)
        if head.get("warc-type") == "revisit":
            told = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
            size = int(told[1]) if told else None
    return head.get("warc-type"), bare("warc-record-id"), head.get("warc-target-uri"), bare("warc-refers-to"), head.get("warc-payload-digest"), size, payload, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string()]
    names = [c.split()[0] for c in _RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _cut(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about 16 MB of payload."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 500 + len(row[6] or b"")
        if size > 16 << 20:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """(file, start of its range) and a stretch that begins with the magic; the stretch before a file's first magic is as it is."""
    last = None
    for b in batches:
        for file, start, value in zip(b.column("file"), b.column("start"), b.column("value"), strict=True):
            place = file.as_py(), start.as_py()
            yield place, value.as_py() if place != last and place[1] == 0 else MAGIC + value.as_py()
            last = place


def _open_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files of ranges that don't consist of whole members."""
    last, member, bad, found = None, None, False, set()
    for place, piece in _fragments(batches):
        if place != last:
            if bad or member:
                found.add(last[0])
            last, member, bad = place, None, False
        if bad or not piece:
            continue
        member = member or _Member()
        try:
            for _ in member.add(piece):
                pass
        except _Fault:
            bad = True
        if member.unpack.eof:
            member = None
    if bad or member:
        found.add(last[0])
    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["file"])


def _certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        member = None
        for _, piece in _fragments(batches):
            if piece:
                member = member or _Member()
                yield from member.add(piece)
                if member.unpack.eof:
                    member = None

    yield from _cut(rows())


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole files in order; what can't be read is told and passed over up to the next magic that begins a member."""

    def fault(file: str, why: str) -> tuple:
        return (None,) * 7 + (f"{file}: {why}",)

    def rows() -> Iterator[tuple]:
        file, member, tried, told = None, None, [], False

        def feed(pieces: list[bytes]) -> Iterator[tuple]:
            """tried: pieces of a member that has given no record yet, to begin anew behind its first one."""
            nonlocal member, tried, told
            pieces = pieces[::-1]
            while pieces:
                piece = pieces.pop()
                if not piece:
                    continue
                first = member is None
                member = member or _Member()
                if tried is not None:
                    tried.append(piece)
                try:
                    for row in member.add(piece):
                        tried, told = None, False
                        yield row
                except _Fault as e:
                    if not told:
                        yield fault(file, str(e))
                    told = True
                    pieces += tried[:0:-1] if tried else [] if first else [piece]
                    member, tried = None, []
                    continue
                if member.unpack.eof:
                    member, tried = None, []

        def ended() -> Iterator[tuple]:
            nonlocal member, tried, told
            while member:
                if not told:
                    yield fault(file, "a member breaks off")
                told, rest = True, (tried or [])[1:]
                member, tried = None, []
                yield from feed(rest)

        for place, piece in _fragments(batches):
            if place[0] != file:
                yield from ended()
                file, member, tried, told = place[0], None, [], False
            yield from feed([piece])
        yield from ended()

    yield from _cut(rows())


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in the folder path.

    Returns record_type, record_id, target_uri, refers_to, payload_digest (as the record
    states it), payload_bytes (of a revisit: as its HTTP header states it), payload (null bytes
    of a revisit: empty) and error.  A stretch that is no archive gives one row that has
    nothing but its error.  Records of any size are read whole, each in the memory of a task;
    empty archives give no rows; records that repeat are given as often.  Files whose names
    end in .gz would be unpacked by Spark itself and must be named otherwise.
    """
    text = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    part: Column = F.monotonically_increasing_id()
    cut = text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    open_ = stored(cut.mapInArrow(_open_ranges, "file string").distinct(), "warc-open")
    if open_.isEmpty():
        return cut.mapInArrow(_certain, _RECORDS)
    # Names of files, fewer than the driver lists for any read of the folder.
    names = F.broadcast(open_)
    whole = cut.withColumn("at", part).join(names, "file", "left_semi").repartition("file").sortWithinPartitions("file", "start", "at")
    return cut.join(names, "file", "left_anti").select("value", "file", "start").mapInArrow(_certain, _RECORDS).union(whole.select("value", "file", "start").mapInArrow(_streamed, _RECORDS))


def through_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from archives written to path.

    The digest of a response is computed anew from what was read, that of a revisit is the
    record's.  One row for each row of pages; see with_revisits() for nulls and repeated rows.
    Empty and very long payloads are written and read whole; an empty table gives no rows;
    other columns of pages are ignored.
    """
    write_archives(with_revisits(pages, least), path)
    page = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("long")
    read = read_archives(pages.sparkSession, path)
    revisit = F.col("record_type") == "revisit"
    return read.select(
        page("record_id").alias("page_id"), "payload_bytes", F.when(revisit, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"), "error",
    )
