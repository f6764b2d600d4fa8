"""The members of archives of any size by ranged reads (S-22).

A zip file ends with a record that says where its directory lies.  The tail of a
file and then its directory are read, nothing of the members; both come from
whatever file system pyarrow opens.  What can't be read is a row with the reason.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The end record has 22 bytes and a comment of at most 65,535.
TAIL = 22 + 65_535
#: Bytes of a directory that are held at once.
STEP = 1 << 20
MEMBERS = "path string, member string, bytes long, packed long, method int, read long, error string"
# Signatures of the format: entry, end record, and the two of the 64-bit form. Fixed values.
ENTRY, END, END64, LOCATOR64 = b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


class BadArchive(ValueError):
    pass


class _Ranged:
    """Reads of a file by place, counted."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.read = file, file.size(), 0

    def at(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        self.file.seek(start)
        got = self.file.read(n)
        self.read += len(got)
        return got


def directory_of(f: _Ranged) -> tuple[int, int, int]:
    """Where the directory starts, its bytes and its entries."""
    # Most archives have no comment: the last few hundred bytes are looked at first.
    for n in (512, TAIL):
        start = max(0, f.size - n)
        tail = f.at(start, n)
        at = tail.rfind(END)
        while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at >= 0:
            break
    else:
        raise BadArchive("no end record")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    end = start + at
    if 0xFFFF == entries or 0xFFFFFFFF in (size, offset):
        locator = f.at(end - 20, 20) if end >= 20 else b""
        if locator[:4] == LOCATOR64:
            end = struct.unpack_from("<Q", locator, 8)[0]
            record = f.at(end, 56)
            if record[:4] != END64 or len(record) < 56:
                raise BadArchive("no 64-bit end record")
            entries, size, offset = struct.unpack_from("<QQQ", record, 32)
    if offset + size > end:
        raise BadArchive("the directory lies beyond the file")
    return end - size, size, entries  # what stands before the archive moves its offsets


def _long_sizes(extra: bytes, size: int, packed: int) -> tuple[int, int]:
    """Sizes beyond 32 bits stand in the extra field of id 1, in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            found = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            size = next(found, size) if size == 0xFFFFFFFF else size
            packed = next(found, packed) if packed == 0xFFFFFFFF else packed
        at += 4 + n
    return size, packed


def entries_of(f: _Ranged) -> Iterator[tuple[str, int, int, int]]:
    """name, bytes, packed bytes, method of the members that are no folders."""
    at, left, entries = directory_of(f)
    held, pos, seen = b"", 0, 0
    while seen < entries:
        need = 46 if len(held) - pos < 46 else 46 + sum(struct.unpack_from("<HHH", held, pos + 28))
        if len(held) - pos < need:
            more = f.at(at, min(left, max(need, STEP)))
            if not more:
                raise BadArchive("the directory is cut short")
            at, left = at + len(more), left - len(more)
            held, pos = held[pos:] + more, 0
            continue
        if held[pos : pos + 4] != ENTRY:
            raise BadArchive("the directory is damaged")
        flags, method = struct.unpack_from("<HH", held, pos + 8)
        packed, size, n, extra, comment = struct.unpack_from("<IIHHH", held, pos + 20)
        name = held[pos + 46 : pos + 46 + n]
        size, packed = _long_sizes(held[pos + 46 + n : pos + 46 + n + extra], size, packed)
        text = name.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        if not text.endswith("/"):
            yield text, size, packed, method
        pos, seen = pos + 46 + n + extra + comment, seen + 1


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    names = [c.split()[0] for c in MEMBERS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for paths in batches:
        for path in paths.column(0).to_pylist():
            rows, f = [], None
            try:
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    f = _Ranged(file)
                    for name, size, packed, method in entries_of(f):
                        rows.append((path, name, size, packed, method, f.read, None))
                        if len(rows) >= 10_000:
                            yield batch(rows)
                            rows = []
            except Exception as e:  # of one file; the others are read
                rows.append((path, None, None, None, None, f.read if f else 0, f"{type(e).__name__}: {e}"))
            if rows:
                yield batch(rows)


def archive_members(files: DataFrame, path: str = "path") -> DataFrame:
    """path, member, bytes, packed, method, read (bytes of the file read so far), error of each member of each archive.

    ``files`` names them (as the binaryFile source does, whose content is not
    asked for); an archive without members has no row.
    """
    return files.select(F.col(path).cast("string").alias("path")).where("path is not null").mapInArrow(_list, MEMBERS)
