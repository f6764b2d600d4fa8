"""Derived tables that are built once and read until their source's files change (S-18, T-9).

Every version lies in a folder of its own under the name and the source's files,
named by a fingerprint of these; a version is put in place by a rename, so that
readers see a whole one or none, and of two builders one wins.

A caller that asks for the present gets the version of the source's present
files, and waits while it is built if need be.  One that takes what there is gets
the newest version at once, and the present one is built meanwhile by a single
builder: who holds the lease.  A lease that is older than ``LEASE`` seconds is
taken to be left by a builder that was lost.  Versions are removed ``GRACE``
seconds after a newer one has taken their place.
"""

from __future__ import annotations

import hashlib
import posixpath
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.session import shared_folder

LEASE, GRACE = 3_600.0, 3_600.0
#: Files whose sizes and times the driver asks for itself; those of more are listed by a job.
FEW_FILES = 64


def fingerprint(source: DataFrame) -> str:
    """A digest of the names, sizes and times of the files behind a scan; no row of them is read."""
    spark, paths = source.sparkSession, sorted(source.inputFiles())
    if not paths:
        return "none"
    if len(paths) <= FEW_FILES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(paths[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        seen = [(p, s.getLen(), s.getModificationTime()) for p in paths for s in (fs.getFileStatus(path(p)),)]
        return f"{len(paths)}-{hashlib.sha1(repr(seen).encode()).hexdigest()}"
    files = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    h = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return f"{h['n']}-{h['h'] or 0}".replace("--", "-m")


def place(source: DataFrame) -> str:
    """What stays the same while files come and go: the folder that holds them all, or the one file of a table that is no folder."""
    files = source.inputFiles()
    if len(files) == 1 and not posixpath.basename(files[0]).startswith("part-"):
        return files[0]
    return posixpath.commonpath([posixpath.dirname(f) for f in files]) if files else ""


class Stored:
    """The versions of one derived table."""

    def __init__(self, spark: SparkSession, name: str, source: DataFrame, lease: float = LEASE, grace: float = GRACE) -> None:
        self.spark, self.source, self.lease, self.grace = spark, source, lease, grace
        self.root = f"{shared_folder(spark)}/{name}-{hashlib.sha1(place(source).encode()).hexdigest()}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, str]]:
        """(time it was put in place, fingerprint), the newest first."""
        root = self._path(self.root)
        found = self._fs.listStatus(root) if self._fs.exists(root) else ()
        # A marker beside each version tells when it was put in place; a folder's own time moves with what is done in it.
        return sorted(((s.getModificationTime(), s.getPath().getName()[:-5]) for s in found if s.getPath().getName().endswith(".done")), reverse=True)

    def present(self, build: Callable[[str], None]) -> str:
        """The folder of the version of the source's present files."""
        mark = fingerprint(self.source)
        if not any(m == mark for _, m in self.versions()):
            self._build(mark, build)
        return f"{self.root}/{mark}"

    def at_hand(self, build: Callable[[str], None]) -> tuple[str, threading.Thread | None]:
        """The newest version there is, and the thread that builds the present one if this caller is its builder."""
        mark, found = fingerprint(self.source), self.versions()
        if not found:
            self._build(mark, build)
            return f"{self.root}/{mark}", None
        if any(m == mark for _, m in found) or not self._take(mark):
            return f"{self.root}/{mark if any(m == mark for _, m in found) else found[0][1]}", None

        def run() -> None:
            try:
                self._build(mark, build)
            finally:
                self._fs.delete(self._path(f"{self.root}/{mark}.lease"), False)

        worker = threading.Thread(target=run, name=f"build {mark}")
        worker.start()
        return f"{self.root}/{found[0][1]}", worker

    def _take(self, mark: str) -> bool:
        """Whether this caller may build: the lease is a file that only one can create."""
        at = self._path(f"{self.root}/{mark}.lease")
        if self._fs.exists(at) and time.time() * 1000 - self._fs.getFileStatus(at).getModificationTime() > self.lease * 1000:
            self._fs.delete(at, False)
        try:
            self._fs.create(at, False).close()
        except Exception as e:  # another one was first
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def _build(self, mark: str, build: Callable[[str], None]) -> None:
        draft, final = f"{self.root}/{mark}.{uuid.uuid4().hex}", self._path(f"{self.root}/{mark}")
        self._fs.mkdirs(self._path(self.root))
        build(draft)
        if self._fs.exists(final) or not self._fs.rename(self._path(draft), final):
            if not self._fs.exists(final):
                raise OSError(f"{draft} could not be moved to {final.toString()}")
            self._fs.delete(self._path(draft), True)
        self._fs.create(self._path(f"{self.root}/{mark}.done"), True).close()
        self.tidy()

    def tidy(self) -> list[str]:
        """Removes versions whose successor is older than ``grace``; their fingerprints."""
        found, now = self.versions(), time.time() * 1000
        gone = [m for (after, _), (_, m) in zip(found, found[1:]) if now - after > self.grace * 1000]
        for m in gone:
            self._fs.delete(self._path(f"{self.root}/{m}.done"), False)
            self._fs.delete(self._path(f"{self.root}/{m}"), True)
        return gone


_SEEN: dict[tuple[str, str], tuple[float, str]] = {}


def stored(spark: SparkSession, name: str, source: DataFrame, build: Callable[[str], None], fresh: float = 0.0) -> str:
    """The folder of what ``build`` writes for the source's present files; it runs only if that is not there yet.

    ``fresh``: seconds for which a caller is content with what it last saw.
    """
    held = Stored(spark, name, source)
    own = (spark.sparkContext.applicationId, held.root)
    if own not in _SEEN or time.monotonic() - _SEEN[own][0] >= fresh:
        _SEEN[own] = (time.monotonic(), held.present(build))
    return _SEEN[own][1]
