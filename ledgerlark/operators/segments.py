"""An index that grows (Q-18, Q-19, K-9): segments that are never changed, keys that are dead in them, merges by size.

A batch of new, changed and deleted records writes one segment with the
postings of its own records and, for older segments, the keys that it replaces.
Nothing else is touched.  Where ``FAN`` segments are of one size, or half of one
is dead, they are written anew as one without the dead; postings are merged as
they are, texts are not read again.  A version is one small file that names its
segments; it is put in place as the last step, and only if no other writer has
put one there, so readers see all of a batch or nothing of it.

Layout: ``postings/segment=/folder=`` (in order of terms), ``records/segment=``
(key, length), ``dead/segment=/version=`` (key), ``versions/<n>.json``.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import values as V
from ledgerlark.operators import index as I

#: Segments of one size that are merged; sizes are powers of it.
FAN = 4
#: Folders of a segment by a hash of the term.
FOLDERS = 32


#: Bytes of text for each token of a segment that is merged, about.
TOKEN_TEXT = 8


def tasks_of(size: int) -> tuple[int, int]:
    """Tasks that write the postings of so many bytes of text, and the shares of a folder: large folders are cut, small ones share a task."""
    dealt = 1 + size // (FOLDERS * I.FILE_TEXT)
    return max(1, min(FOLDERS * dealt, -(-4 * size // I.FILE_TEXT))), dealt


@dataclass
class Version:
    number: int = 0
    #: name: [records that are alive, their tokens, dead records]
    segments: dict[str, list[int]] = field(default_factory=dict)
    #: What the step that made this version wrote.
    written: list[str] = field(default_factory=list)


class GrowingIndex:
    """See the module; ``fields`` maps text columns to their weights."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: Mapping[str, float], kind: str = "long", fan: int = FAN, forms: I.Forms | None = None) -> None:
        self.spark, self.path, self.key, self.fields, self.kind, self.fan, self.forms = spark, path.rstrip("/"), key, fields, kind, fan, forms
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- versions -------------------------------------------------------------------------------

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> Version:
        """The newest version; one without segments where nothing has been written."""
        folder = self._at("versions")
        if not self._fs.exists(folder):
            return Version()
        numbers = [int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json")]
        if not numbers:
            return Version()
        text = self.spark.read.text(f"{self.path}/versions/{max(numbers)}.json", wholetext=True).first()[0]
        return Version(**json.loads(text))

    def _put(self, v: Version) -> Version:
        draft = self._at(f"versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(v.__dict__), "utf-8"))
        out.close()
        to = self._at(f"versions/{v.number}.json")
        # A rename never replaces a file: of two writers one is told.
        if self._fs.exists(to) or not self._fs.rename(draft, to):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {v.number} was written by another; apply the batch again")
        return v

    # ---- writing --------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, name: str, size: int) -> list[int]:
        """Writes a segment of the postings of so many bytes of text; returns its records and tokens."""
        tasks, dealt = tasks_of(size)
        share = F.col("folder") * dealt + F.pmod(F.xxhash64("key"), F.lit(dealt)).cast("int")
        placed = rows.withColumn("folder", I._folder(F.col("term"), FOLDERS)).repartitionById(tasks, F.pmod(share, F.lit(tasks))).sortWithinPartitions("folder", "term")
        placed.write.option("parquet.page.row.count.limit", I.PAGE_ROWS).partitionBy("folder").parquet(f"{self.path}/postings/segment={name}")
        own = self.spark.read.parquet(f"{self.path}/postings/segment={name}").where("lead").select("key", "length")
        own.write.parquet(f"{self.path}/records/segment={name}")
        seen = self.spark.read.schema(own.schema).parquet(f"{self.path}/records/segment={name}").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()
        return [seen["n"], seen["t"]]

    def _table(self, table: str, names: Sequence[str], schema: str) -> DataFrame:
        there = [n for n in names if self._fs.exists(self._at(f"{table}/segment={n}"))]
        if not there:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/segment={n}" for n in there)).withColumn("segment", F.col("segment").cast("string"))

    def _alive(self, rows: DataFrame, v: Version, names: Sequence[str]) -> DataFrame:
        """Rows (key, segment) of segments without the dead; segments without any are not joined."""
        with_dead = [n for n in names if v.segments[n][2]]
        if not with_dead:
            return rows
        dead = self._table("dead", with_dead, f"key {self.kind}, version int").where(F.col("version") <= v.number).select("segment", "key")
        return rows.join(dead, ["segment", "key"], "left_anti")

    def apply(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> Version:
        """Takes in records (the key and the fields) that are new or changed, and keys that are gone; then merges.

        A key that a batch repeats counts once, with its greatest fields; one that
        is changed and deleted is deleted; a null key is left out.
        """
        v = self.version()
        nxt = Version(v.number + 1, {n: list(x) for n, x in v.segments.items()})
        gone = None if deleted is None else deleted.select(F.col(self.key).cast(self.kind).alias("key")).where("key is not null").distinct()
        if changed is not None:
            fields = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in self.fields]
            rows = changed.select(F.col(self.key).cast(self.kind).alias("key"), F.struct(*fields).alias("f")).where("key is not null").groupBy("key").agg(F.max("f").alias("f")).select("key", "f.*")
            rows = rows if gone is None else rows.join(gone, "key", "left_anti")
            made = rows.mapInArrow(partial(I._postings, fields=tuple(self.fields), forms=self.forms, bare=True), f"key {self.kind}, term string, tf array<int>, length long, lead boolean")
            name = f"{nxt.number:08d}-{uuid.uuid4().hex[:8]}"
            size = changed.agg(F.sum(reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(F.col(f).cast("string")), F.lit(0)).cast("long") for f in self.fields))).alias("b")).first()["b"] or 0
            records, tokens = self._write(made, name, size)
            if records:
                nxt.segments[name] = [records, tokens, 0]
                nxt.written.append(name)
        keys = [self._table("records", nxt.written, self._records()).select("key")] if nxt.written else []
        keys += [] if gone is None else [gone]
        if keys and v.segments:
            every = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
            old = self._alive(self._table("records", list(v.segments), self._records()), v, list(v.segments))
            # Replaced records keep their place: a folder for each segment they are dead in.
            dead = old.join(every, "key", "left_semi").select("key", "length", "segment", F.lit(nxt.number).alias("version"))
            draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
            dead.write.partitionBy("segment", "version").parquet(draft)
            found = self.spark.read.schema(f"key {self.kind}, length long, segment string, version int").parquet(draft)
            for r in found.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("t")).collect():  # a row for each segment
                s = nxt.segments[r["segment"]]
                nxt.segments[r["segment"]] = [s[0] - r["n"], s[1] - r["t"], s[2] + r["n"]]
                to = self._at(f"dead/segment={r['segment']}/version={nxt.number}")
                self._fs.mkdirs(to.getParent())
                self._fs.delete(to, True)  # what a writer left that did not finish
                self._fs.rename(self._jvm.org.apache.hadoop.fs.Path(f"{draft}/segment={r['segment']}/version={nxt.number}"), to)
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(draft), True)
        nxt.segments = {n: x for n, x in nxt.segments.items() if x[0]}
        return self.merge(self._put(nxt))

    def _records(self) -> str:
        return f"key {self.kind}, length long"

    def merge(self, v: Version | None = None) -> Version:
        """Writes segments of one size as one while there are ``fan`` of them, and those that are half dead."""
        v = v or self.version()
        while True:
            tiers: dict[int, list[str]] = {}
            for n, (records, _, _) in sorted(v.segments.items()):
                tiers.setdefault(int(math.log(records, self.fan) + 1e-9), []).append(n)
            todo = next((names for _, names in sorted(tiers.items()) if len(names) >= self.fan), None) or [n for n, x in v.segments.items() if x[2] > x[0]][:1]
            if not todo:
                return v
            nxt = Version(v.number + 1, {n: x for n, x in v.segments.items() if n not in todo}, list(v.written))
            name = f"{nxt.number:08d}-{uuid.uuid4().hex[:8]}"
            rows = self._alive(self._table("postings", todo, self._shape()), v, todo)
            records, tokens = self._write(rows.select("key", "term", "tf", "length", "lead"), name, TOKEN_TEXT * sum(v.segments[n][1] for n in todo))
            nxt.segments[name] = [records, tokens, 0]
            nxt.written.append(name)
            v = self._put(nxt)

    def _shape(self) -> str:
        return f"key {self.kind}, term string, tf array<int>, length long, lead boolean, folder int"

    def vacuum(self) -> list[str]:
        """Removes segments that the newest version does not name, and older versions; no reader may hold one."""
        v, gone = self.version(), set()
        for table in ("postings", "records", "dead"):
            folder = self._at(table)
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                name = s.getPath().getName().partition("=")[2]
                if name not in v.segments:
                    gone.add(name)
                    self._fs.delete(s.getPath(), True)
        for s in self._fs.listStatus(self._at("versions")):
            if s.getPath().getName() != f"{v.number}.json":
                self._fs.delete(s.getPath(), True)
        return sorted(gone)

    # ---- reading --------------------------------------------------------------------------------

    def postings(self, terms: Sequence[str], v: Version | None = None) -> DataFrame:
        """key, term, tf, length of the living records of a version that hold one of the terms (stems)."""
        v = v or self.version()
        names = list(v.segments)
        rows = self._table("postings", names, self._shape()).where(F.col("folder").isin(sorted({zlib.crc32(t.encode()) % FOLDERS for t in terms})) & F.col("term").isin(list(terms)))
        return self._alive(rows, v, names).select("key", "term", "tf", "length")

    def top(self, words: Sequence[str], rows: int = V.ARM_ROWS) -> DataFrame:
        """Q-3: key, bm25 of the best records by the words, as an index built anew would have them."""
        v = self.version()
        n, tokens = sum(x[0] for x in v.segments.values()), sum(x[1] for x in v.segments.values())
        mean = tokens / n if n and tokens else 1.0
        terms = list(dict.fromkeys(I.term_of(w, self.forms) for w in words))
        own = self.postings(terms, v).select("key", "term", "length", I._weighed(self.fields).alias("w"))
        df = {r["term"]: r["df"] for r in own.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row for each term of a query
        score = F.lit(0.0)
        for t in df:
            score = score + F.coalesce(F.max(F.when(F.col("term") == t, I.rarity(n, df[t]) * I.saturation(F.col("w"), F.col("length"), mean))), F.lit(0.0))
        out = own.groupBy("key").agg(score.alias("bm25")).orderBy(F.desc("bm25"), "key")
        # The best of fewer records than are asked for are all of them: sorted by many tasks, where a limit takes one.
        return out if rows >= n else out.limit(rows)


def stream_into(index: GrowingIndex, changes: DataFrame, checkpoint: str, deleted: str = "deleted"):  # noqa: ANN201
    """Q-19: every micro-batch of changes (the key, the fields, a flag) is a batch of the index."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        index.apply(rows.where(~F.coalesce(F.col(deleted), F.lit(False))), rows.where(F.col(deleted)))
        rows.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
