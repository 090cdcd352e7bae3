"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

The writer is Spark's own text writer: each value is a whole record, compressed as a gzip member of its own, and the
line separator between values is an empty member, so a file is a valid sequence of members and is committed like
any other output. The reader checks every record (member, version line, headers, length, end, digests). Where a
check fails it searches on for the next member or version line that passes, carries on from there, and logs
the bytes between as a quarantined gap.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
# Fixed value: a gzip member without content, in Latin-1.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
LEAST_BYTES = 100  # payloads from which copies become revisits
FILE_BYTES = 1 << 28  # of an archive before compression; a longer record has a file of its own
LARGE = 1 << 16  # bytes from which records are written apart, fewer to a file
FIRST_LINE = re.compile(rb"WARC/1\.[01]\Z")
DATE = "1970-01-01T00:00:00Z"  # pages carry no date


class Record(NamedTuple):
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


class Failed(Exception):
    pass


class Finder:
    """data.find() for places that only grow: what was found is remembered, so that each byte is searched once a mark."""

    def __init__(self, data: bytes):
        self.data, self.known = data, {}

    def next(self, mark: bytes, at: int) -> int:
        """Where mark stands next, from `at` on; the end if nowhere."""
        since, found = self.known.get(mark, (0, -1))
        if not since <= at <= found:
            found = self.data.find(mark, at)
            self.known[mark] = at, found = at, found if found >= 0 else len(self.data)
        return found


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """A member's content and where it ends."""
    d, out, pos = zlib.decompressobj(31), [], at
    view = memoryview(data)
    try:
        while not d.eof:
            if pos >= len(data):
                raise Failed("member ends early")
            out.append(d.decompress(view[pos : pos + 65536]))
            pos += 65536
    except zlib.error:
        raise Failed("member is damaged") from None
    return b"".join(out), min(pos, len(data)) - len(d.unused_data)


def _parse(marks: Finder, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that begins here; raises Failed unless all checks pass. Headers are read line by
    line, and a version line is none: from each one no more is read than up to the next."""
    data = marks.data
    line_end = data.find(b"\r\n", at, at + 16)
    if line_end < 0 or not FIRST_LINE.match(data[at:line_end]):
        raise Failed("no version line")
    headers: dict[str, str] = {}
    pos = line_end + 2
    while (end := data.find(b"\r\n", pos)) != pos:
        if end < 0:
            raise Failed("headers don't end")
        name, colon, value = data[pos:end].decode("utf-8", "replace").partition(":")
        if not colon:
            raise Failed("malformed header")
        headers[name.strip().lower()] = value.strip()
        pos = end + 2
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Failed("no length")
    begin, end = pos + 2, pos + 2 + int(length)
    if data[end : end + 4] != END:
        raise Failed("record doesn't end where its length says")
    block = data[begin:end]
    if not _digest_holds(headers.get("warc-block-digest"), block):
        raise Failed("block digest differs")
    if headers.get("warc-type") == "response" and not _digest_holds(headers.get("warc-payload-digest"), payload_of(block)):
        raise Failed("payload digest differs")
    return headers, block, end + 4


def _digest_holds(said: str | None, data: bytes) -> bool:
    """False only for a digest of a known kind that differs."""
    kind, _, value = (said or "").partition(":")
    return kind.lower() != "sha256" or hashlib.sha256(data).hexdigest() == value.lower()


def payload_of(block: bytes) -> bytes:
    head = block.find(END)
    return block[head + 4 :] if block.startswith(b"HTTP/") and head >= 0 else block


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """The records of an archive, compressed by the record, plain or both, and the gaps between them."""
    pos, bad, why, marks = 0, -1, "", Finder(data)
    while pos < len(data):
        try:
            if data.startswith(MAGIC, pos):
                raw, end = _inflate(data, pos)
                if raw:
                    headers, block, whole = _parse(Finder(raw), 0)
                    if whole != len(raw):
                        raise Failed("member holds more than a record")
            elif data.startswith(VERSION, pos):
                headers, block, end = _parse(marks, pos)
                raw = block or b"-"
            else:
                raise Failed("neither a member nor a version line")
        except Failed as e:
            if bad < 0:
                bad, why = pos, str(e)
            pos = min(marks.next(MAGIC, pos + 1), marks.next(VERSION, pos + 1))
            continue
        if bad >= 0:
            yield Gap(bad, pos, why)
            bad = -1
        if raw:
            yield Record(pos, end, headers, block)
        pos = end
    if bad >= 0:
        yield Gap(bad, len(data), why)


COLUMNS = "file string, kind string, start long, end long, reason string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"
ARROW = pa.schema([("file", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), *((k, pa.string()) for k in ("reason", "record_type", "record_id", "refers_to", "target_uri", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _row(file: str, x: Record | Gap, with_payload: bool) -> dict:
    if isinstance(x, Gap):
        return {"file": file, "kind": "gap", "start": x.start, "end": x.end, "reason": x.reason}
    h, payload = x.headers, payload_of(x.block)
    kind = h.get("warc-type")
    if kind == "revisit":  # the block holds the answer's headers only: they and the digest speak of the full payload
        said = re.search(rb"(?im)^content-length:\s*(\d+)", x.block)
        size, digest = int(said[1]) if said else None, h.get("warc-payload-digest", "").partition(":")[2].lower() or None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    out = {"file": file, "kind": "record", "start": x.start, "end": x.end, "record_type": kind, "record_id": h.get("warc-record-id"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": size}
    return out | ({"payload": payload} if with_payload and kind != "revisit" else {})


def _read(with_payload: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for x in salvage(data.as_py() or b""):
                    rows.append(_row(file.as_py(), x, with_payload))
                    size += len(rows[-1].get("payload") or b"") + 500
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return work


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of kind 'record' or 'gap' of all archives below path; start and end are byte offsets in the file.

    A task holds one file at a time: the writer bounds files by their bytes, and Spark refuses files beyond
    spark.sql.sources.binaryFile.maxLength (2 GB). Neither headers nor members have a bound of their own. Of a revisit, payload_digest and payload_bytes are those of the full
    payload that its headers name; payload is null. An empty file gives no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_read(with_payload), COLUMNS)


def records(archive: DataFrame, whole: bool = False) -> DataFrame:
    """The records; with whole, a gap is an error instead of a row that isn't there."""
    record = F.col("kind") == "record"
    lost = F.raise_error(F.concat(F.lit("gap in "), "file", F.lit(": "), "reason")).cast("boolean")
    return archive.where(F.when(record, True).otherwise(lost) if whole else record).drop("kind", "reason")


def gaps(archive: DataFrame) -> DataFrame:
    """(file, start, end, reason): the quarantined bytes."""
    return archive.where("kind = 'gap'").select("file", "start", "end", "reason")


def lost_revisits(archive: DataFrame) -> DataFrame:
    """Revisits whose response isn't among the recovered records."""
    found = records(archive)
    kept = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to")).distinct()
    return found.where("record_type = 'revisit'").join(kept, "refers_to", "left_anti")


def with_copies(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, n, first): first is the smallest page_id with this payload, null for payloads
    of fewer than least_bytes bytes and for those that no other page has. Sums go first, so a payload that a third of
    the pages share is one row by the time the pages meet it, and Spark can split its side of the join."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    firsts = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return rows.join(firsts, "digest", "left")


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def as_record(page_id: Column, url: Column, payload: Column, digest: Column, n: Column, first: Column) -> Column:
    """The text of a page's record, with its final blank lines."""
    revisit = first.isNotNull() & ~first.eqNullSafe(page_id)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, payload))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    uri = F.when(url.isNull(), F.lit("")).otherwise(header("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", " ")))
    refers = F.when(revisit, F.concat(header("WARC-Refers-To", _id(first)), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), header("WARC-Record-ID", _id(page_id)), header("WARC-Date", F.lit(DATE)), uri, refers,
        F.lit("Content-Type: application/http; msgtype=response\r\n"), header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), header("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        header("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block, F.lit("\r\n\r\n"),
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(0).to_pylist():
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(c.compress(x) + c.flush())
        yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, compressed: bool = True, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, large: int = LARGE) -> None:
    """Writes a record for each row of pages (page_id, url, html) to archives below path.

    Of pages with equal payloads (html in UTF-8; null: empty) of at least least_bytes bytes, that with the smallest
    page_id is a response and the others are revisits of it; shorter ones are all responses. Rows that repeat the
    smallest page_id are responses too; a row without page_id is a revisit unless all its copies lack one. Line
    breaks in a URL become spaces, without URL the header is left out. Other columns don't matter.

    A file holds about file_bytes before compression at most, or a single record: Spark rolls files by records, so pages of `large`
    bytes or more (with their URL) are written by classes of size, each twice the one before, each with its own number to a file.
    """
    rows = with_copies(pages, least_bytes)
    size = F.col("n") + F.coalesce(F.octet_length(F.col("url").cast("string")), F.lit(0))
    of_pages = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("url").cast("string")), F.lit(0))
    kind = lambda n: F.when(n < large, 0).otherwise(F.floor(F.log2(n / large)).cast("int") + 1)
    kinds = sorted(r[0] for r in pages.select(kind(of_pages).alias("k")).distinct().collect())  # as many as doublings
    for k in kinds or [0]:
        _write(rows if len(kinds) < 2 else rows.where(kind(size) == k), path, compressed, max(1, file_bytes // ((large << k) + 1024)))


def _write(rows: DataFrame, path: str, compressed: bool, records_a_file: int) -> None:
    record = as_record(*[F.col(c) for c in ("page_id", "url", "payload", "digest", "n", "first")])
    if compressed:
        values = rows.select(record.cast("binary").alias("value")).mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
        options = {"lineSep": EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1"}
    else:  # the separator is the record's last line break
        values = rows.withColumn("value", record).select(F.expr("left(value, length(value) - 2)").alias("value"))
        options = {"lineSep": "\r\n"}
    values.write.mode("append").options(**options).option("maxRecordsPerFile", records_a_file).text(path)
