"""WARC archives: a writer with revisit records and a salvage reader.

Archives are files of gzip members, one record each, with an empty member after
every few megabytes.  The reader also takes members of several records and plain
records.  It checks each record (member, version line, headers, length, closing
blank lines, block digest); after a failed check it searches for the next gzip
magic or version line from which a whole valid record can be read, goes on
there, and logs the bytes in between as a quarantined gap.  Inside a member it
searches in the same way for the next version line, and of a damaged member it
keeps the records whose block digest holds.

Files are written by Spark's text sink (bytes as they are, the empty member as
the line separator), so writing has its retries and commits, and read by its
binaryFile source, on any file system of the cluster.

Of pages with equal payloads the one with the largest page_id is the response
and the others are revisits of it, with the HTTP head only.

Cases: a null html is an empty payload; a null url an empty target; a null
page_id is written and read as such and revisits any other with its payload;
rows that repeat the largest page_id of a payload are all responses; other
columns are ignored; an archive without a valid record is one gap; an empty
table writes no archive.  An archive of the writer has 64 MB and a record more at
most; the reader holds one archive at a time, of 2 GB at most (binaryFile's
bound), and records of up to ``MOST_RECORD`` bytes.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.scratch import Scratch
from ledgerlark.llm.skew import join_uneven
from ledgerlark.llm.wordhash import tidy

#: Bytes of members that are written as one piece, and pieces in an archive.
PIECE_BYTES, PIECES = 4 << 20, 16
#: Bytes that a decompressed member may have; a longer one is a gap.
MOST_RECORD = 1 << 30
#: A gzip member of nothing, in Latin-1.
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush().decode("latin-1")
_STEP = 1 << 16
log = logging.getLogger(__name__)
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    n = record_id.removeprefix("<urn:x-page:").removesuffix(">")
    return int(n) if n else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response, or a revisit of ``refers_to`` that has the HTTP head alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url or ""))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Salvaged:
    records: list[tuple[int, int, dict[str, str], bytes]] = field(default_factory=list)  # from, to, headers, block
    gaps: list[tuple[int, int, str]] = field(default_factory=list)  # from, to, the check that failed


def _plain(data: bytes | memoryview, at: int) -> tuple[int, dict[str, str], bytes]:
    """The record that starts at ``at`` and where it ends; ValueError names the failed check."""
    near = bytes(data[at : at + 10])
    if not _VERSION.match(near):
        raise ValueError("version line")
    size, end = 4096, -1
    while end < 0:
        head = bytes(data[at : at + size])
        end = head.find(b"\r\n\r\n")
        if end < 0 and (len(head) < size or size > 1 << 20):
            raise ValueError("headers")
        size *= 4
    headers = {}
    for line in head[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("headers")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise ValueError("length")
    start = at + end + 4
    block = bytes(data[start : start + int(length)])
    if len(block) < int(length):
        raise ValueError("length")
    if bytes(data[start + len(block) : start + len(block) + 4]) != b"\r\n\r\n":
        raise ValueError("closing lines")
    said = headers.get("warc-block-digest")
    if said and said != "sha1:" + digest(block):
        raise ValueError("block digest")
    return start + len(block) + 4, headers, block


def _member(view: memoryview, at: int) -> tuple[int | None, bytes, str]:
    """Where the member ends (None if it is damaged), what it holds, and the check that failed."""
    z, out, size, pos = zlib.decompressobj(31), [], 0, at
    while not z.eof:
        if pos >= len(view):
            return None, b"".join(out), "member cut short"
        chunk = view[pos : pos + _STEP]
        try:
            out.append(z.decompress(chunk, MOST_RECORD + 1 - size))
        except zlib.error:
            return None, b"".join(out), "member"
        size += len(out[-1])
        if size > MOST_RECORD:
            return None, b"", "member too long"
        pos += len(chunk)
    return pos - len(z.unused_data), b"".join(out), ""


def _inside(data: bytes, digest_needed: bool) -> tuple[list[tuple[int, dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """The records of a member's bytes and the gaps between them."""
    records, gaps, at, bad_from, why = [], [], 0, None, ""
    while at < len(data):
        try:
            end, headers, block = _plain(data, at)
            if digest_needed and "warc-block-digest" not in headers:
                raise ValueError("no digest in a damaged member")
        except ValueError as e:
            if bad_from is None:
                bad_from, why = at, str(e)
            nxt = _VERSION.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
            continue
        if bad_from is not None:
            gaps.append((bad_from, at, why))
            bad_from = None
        records.append((at, headers, block))
        at = end
    if bad_from is not None:
        gaps.append((bad_from, len(data), why))
    return records, gaps


def salvage(data: bytes) -> Salvaged:
    """All records that pass their checks, and the gaps between them."""
    view, found = memoryview(data), Salvaged()
    at, bad_from, why = 0, None, ""
    while at < len(data):
        own, inner, failed, end = [], [], "", None
        if data[at : at + 3] == b"\x1f\x8b\x08":
            end, held, failed = _member(view, at)
            own, inner = _inside(held, end is None)
            own = [(at, end, headers, block) for _, headers, block in own]
        else:
            try:
                end, headers, block = _plain(view, at)
                own = [(at, end, headers, block)]
            except ValueError as e:
                failed = str(e)
        if end is None:
            if bad_from is None:
                bad_from, why = at, failed
            nxt = _START.search(data, at + 1)
            step = nxt.start() if nxt else len(data)
            found.records += [(a, step, headers, block) for a, _, headers, block in own]
            at = step
            continue
        if bad_from is not None:
            found.gaps.append((bad_from, at, why))
            bad_from = None
        found.records += own
        found.gaps += [(at, end, f"{reason} at {a}-{b} of the member") for a, b, reason in inner]
        at = end
    if bad_from is not None:
        found.gaps.append((bad_from, len(data), why))
    return found


def with_revisits(pages: DataFrame, scratch: Scratch, at_least: int = 0) -> DataFrame:
    """page_id, url, html, revisit, refers_to: which pages are written as revisits, and of which."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = pages.withColumn("k", F.sha2(F.encode("html", "utf-8"), 256)).withColumn("size", F.octet_length("html"))
    same = keyed.where(F.col("size") >= at_least).groupBy("k", "size").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 and top is not null")
    same = scratch.save(same, "same")
    out = join_uneven(keyed, same, ["k", "size"], "n", "left")
    revisit = F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("page_id"))
    return out.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("top")).alias("refers_to"))


@tidy
def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    for batch in batches:
        for page_id, url, html, revisit, target in zip(*(batch.column(c) for c in ("page_id", "url", "html", "revisit", "refers_to"))):
            held.append(member(record(page_id.as_py(), url.as_py(), html.as_py().encode(), target.as_py(), revisit.as_py())))
            size += len(held[-1])
            if size >= PIECE_BYTES:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def write_archives(pages: DataFrame, folder: str, scratch: Scratch) -> None:
    """Writes the pages as ``.warc.gz`` files into a new folder."""
    pieces = with_revisits(pages, scratch).mapInArrow(_write, "value binary").select(F.col("value").cast("string").alias("value"))
    pieces.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER).option("maxRecordsPerFile", PIECES).text(folder)
    # The sink has names of its own; this changes those of finished files.
    spark = pages.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.endswith(".txt") and not fs.rename(status.getPath(), path(f"{folder}/{name.removesuffix('.txt')}.warc.gz")):
            raise OSError(f"{name} could not be renamed")


def archives_of(spark: SparkSession, folder: str) -> DataFrame:
    """Archives as (path, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]+)", re.IGNORECASE)
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            got = salvage(content.as_py())
            rows = []
            for start, end, headers, block in got.records:
                head, _, body = block.partition(b"\r\n\r\n")
                kind = headers.get("warc-type", "")
                said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                length = kept.search(b"\r\n" + head)
                size = len(body) if kind != "revisit" else int(length[1]) if length else 0
                if kind == "response" and said != digest(body):
                    got.gaps.append((start, end, "payload digest"))
                    continue
                refers = _page_of(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
                rows.append((path, start, end, _page_of(headers.get("warc-record-id", "")), size, said, kind, refers, body, None))
            rows += [(path, start, end, None, None, None, "gap", None, None, why) for start, end, why in got.gaps]
            cols = list(zip(*rows)) or [()] * 10
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
            names = ["path", "first_byte", "end_byte", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "failed_check"]
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 256], k) for c, k in zip(cols, kinds)], names=names)


def read_archives(archives: DataFrame) -> DataFrame:
    """Rows of (path, content), such as those of the binaryFile source, read record by record.

    A gap has record_type ``gap``, its byte range and the check that failed.
    """
    schema = "path string, first_byte long, end_byte long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, failed_check string"
    return archives.select(F.col("path").cast("string").alias("path"), F.coalesce(F.col("content"), F.lit(b"")).alias("content")).mapInArrow(_read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Gaps are no pages: they are kept in a table of their own, whose place is logged.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.root}/archives"
    write_archives(pages, folder, scratch)
    found = scratch.save(read_archives(archives_of(pages.sparkSession, folder)).drop("payload"), "found")
    gaps = found.where("record_type = 'gap'")
    if lost := gaps.count():
        log.warning("%d byte ranges are quarantined: record_type = 'gap' in %s/found", lost, scratch.root)
    scratch.keep("found")
    return found.where("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
