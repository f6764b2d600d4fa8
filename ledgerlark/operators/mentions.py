"""A table of names met with a table of texts (J-18, J-19, Q-16, P-11).

Anywhere and by whole words: one automaton over all names reads each text once,
however many names there are.  Names that are small, by a sum of their bytes,
are sent to the tasks; each Python worker builds the automaton once.  Beyond
that size the names are cut into ranges of about that size (neighbours in order
share most of their automaton) and the texts are read once for each range, so
no executor ever holds more.  Nothing is shuffled but the names (and the texts of
a table of fewer files than cores).

By prefix: an equi join on the beginnings of a text that are as long as any
name is; no pair is looked at that does not match.

Case of A-Z is ignored everywhere, as LIKE does.  A null or empty text or name
matches nothing; repeated names count once; rows that repeat a key are texts of
their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.session import shared_folder, spread

#: Bytes of names whose automaton a Python worker holds (about fifty bytes of memory for each byte).
SENT_BYTES = 4 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def folded(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, _UPPER, _UPPER.lower())


class Names:
    """Folded names, and their automaton where it is first asked for."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self._automaton = None

    def __getstate__(self) -> dict:
        return {"names": self.names, "_automaton": None}

    @property
    def automaton(self):  # noqa: ANN201
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            for n in self.names:
                found.add_word(n, n)
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def hits(self, text: str, whole: bool) -> dict[str, tuple[int, int]]:
        """For each name in the text how often it stands there and the code points before the first."""
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # only A-Z, so no place moves
        out: dict[str, tuple[int, int]] = {}
        for last, name in self.automaton.iter(low) if self.names else ():
            at = last - len(name) + 1
            if whole and (at and low[at - 1].isalnum() and name[0].isalnum() or last + 1 < len(low) and low[last + 1].isalnum() and name[-1].isalnum()):
                continue
            n, first = out.get(name, (0, at))
            out[name] = (n + 1, min(first, at))
        return out


def _scan(batches: Iterator[pa.RecordBatch], sent: object, whole: bool) -> Iterator[pa.RecordBatch]:
    names: Names = sent.value
    for batch in batches:
        rows, said, count, first = [], [], [], []
        for i, text in enumerate(batch.column("text")):
            for name, (n, at) in names.hits(text.as_py(), whole).items():
                rows.append(i)
                said.append(name)
                count.append(n)
                first.append(at)
            if len(rows) >= 100_000:
                yield _batch(batch, rows, said, count, first)
                rows, said, count, first = [], [], [], []
        yield _batch(batch, rows, said, count, first)


def _batch(batch: pa.RecordBatch, rows: list[int], said: list[str], count: list[int], first: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), pa.array(said, pa.string()), pa.array(count, pa.int64()), pa.array(first, pa.int64())], names=["key", "name", "hits", "first"])


def _ranges(names: DataFrame, parts: int) -> Iterator[DataFrame]:
    """The names in ranges of their order, written once."""
    path = f"{shared_folder(names.sparkSession)}/names-{uuid.uuid4().hex}"
    names.repartitionByRange(parts, "name").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(path)
    rows = names.sparkSession.read.parquet(path)
    return (rows.where(F.col("part") == p).select("name") for p in range(parts))


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, whole: bool = False, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """key, name (folded), hits, first (code points before the first) of every name in every text.

    ``whole``: where a name begins or ends with a letter or digit, none may stand
    next to it.  Matches may overlap.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text <> ''")
    rows = spread(rows)
    every = names.select(folded(F.col(name).cast("string")).alias("name")).where("name <> ''").distinct()
    size = every.agg(F.sum(F.octet_length("name")).alias("b")).first()["b"] or 0
    parts = [every] if size <= sent_bytes else _ranges(every, -(-size // sent_bytes))
    shape = f"key {dict(rows.dtypes)['key']}, name string, hits long, first long"
    found = []
    for part in parts:
        sent = spark.sparkContext.broadcast(Names([r["name"] for r in part.collect()]))  # about ``sent_bytes`` at most
        found.append(rows.mapInArrow(partial(_scan, sent=sent, whole=whole), shape))
    return reduce(DataFrame.unionByName, found).withColumnRenamed("key", key)


def beginnings(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """J-19: key, name of every name that a text begins with."""
    every = names.select(folded(F.col(name).cast("string")).alias("name")).where("name <> ''").distinct()
    lengths = [r["n"] for r in every.select(F.length("name").alias("n")).distinct().collect()]  # one for each length of a name
    if not lengths:
        return texts.select(key, F.lit("").alias("name")).limit(0)
    head = folded(F.substring(F.col(text).cast("string"), 1, max(lengths)))
    heads = texts.select(F.col(key).alias("key"), head.alias("head")).where("head <> ''")
    cut = F.explode(F.transform(F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n <= F.length("head")), lambda n: F.substring(F.col("head"), F.lit(1), n)))
    return heads.select("key", cut.alias("name")).join(every, "name").select(F.col("key").alias(key), "name")


def named_elsewhere(texts: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    """J-18: owner, texts (of others that name it), owners (how many others), hits; for owners that any other names.

    A text's owner is a name itself: who is spoken of where it does not publish.
    """
    owners = texts.select(owner).distinct()
    # An owner travels with its text as part of the key, so what is found needs no join.
    row = texts.select(F.struct(F.col(key).alias("id"), folded(F.col(owner)).alias("owner")).alias("row"), F.col(text).alias("said"))
    found = mentions(row, "row", "said", owners, owner, whole=True).where(F.col("row.owner").isNull() | (F.col("row.owner") != F.col("name")))
    by = found.groupBy("name", F.col("row.owner").alias("by")).agg(F.count(F.lit(1)).alias("texts"), F.sum("hits").alias("hits"))
    return by.groupBy(F.col("name").alias(owner)).agg(F.sum("texts").alias("texts"), F.count("by").alias("owners"), F.sum("hits").alias("hits"))
