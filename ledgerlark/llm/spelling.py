"""Spelling variants: words one edit apart, by an even-partition pigeonhole join, and the form that each leads to.

A word of length l is indexed under two segments: its first l // 2 code points
and the rest.  One edit leaves one of them whole, so a word of the same length,
or one longer (whose second segment is then shifted by one), shares a segment
with it.  Each word probes with its substrings at those places for the lengths
l and l - 1; what meets is verified to be exactly one edit.

A segment that many words share (a common beginning of short words) would bring
all their pairs together.  Index rows are counted for every segment; where more
than ``MOST`` share one, the same argument is used again on what the segment
leaves open: that is cut into two halves, one of which must be whole too, and
the row is dealt to longer segments.  This ends where a single code point is
left open, at which no more than an alphabet's words can meet, so no pair is
lost and none is capped.

Words are counted in the tasks that read the texts and sent as counts by word.

Cases: a null or empty text has no words; a null doc_id leaves its runs as they
are; rows that share a doc_id are read each; words of any length take part;
ties of counts go to the first word in code-point order; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.scratch import Scratch
from ledgerlark.llm.wordhash import slices, tidy

LEAST_LENGTH, LEAST_COUNT, SHARE, CHANGED = 6, 5, 5, 199
#: Index rows that share a segment before it is cut further.
MOST = 16
#: Distinct words of a task that are counted before they are sent.
HELD = 200_000


def _kept() -> bytes:
    """For each Latin-1 code: the lower case of A-Z, other letters as they are, a space for the rest."""
    letter = {*range(65, 91), *range(97, 123), *range(0xC0, 0x100)}
    return bytes(c + 32 if 65 <= c <= 90 else c if c in letter else 32 for c in range(256))


_KEPT = _kept()


def runs(text: str) -> list[bytes]:
    """The maximal runs of letters up to U+00FF, A-Z lower-cased, one byte for each code point."""
    return text.encode("latin-1", "replace").translate(_KEPT).split()


@tidy
def _counts(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def sent() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in total], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for part in slices(batch):
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                own = Counter(w for w in runs(text.as_py() or "") if len(w) >= least)
                base = None if i is None else zlib.crc32(b"%d:" % i)
                for w, n in own.items():
                    if base is not None:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), base)
                        if h % every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least:
                                continue
                    total[w] += n
                if len(total) >= HELD:
                    yield sent()
                    total.clear()
    if total:
        yield sent()


def word_counts(documents: DataFrame, least: int = LEAST_LENGTH, every: int = CHANGED) -> DataFrame:
    """word, n: occurrences over all texts of the words of at least ``least`` code points."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(partial(_counts, least=least, every=every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# Rows of the join: word, n; longer (null: an index row, else whether the probing word is one longer); a and m, the start
# and the length, in the index word, of what is left open.


def _open_rows(words: DataFrame) -> DataFrame:
    """Every word as an index row and as the two probing rows, with the whole word open."""
    size = F.length("word")
    roles = F.array(F.lit(None).cast("int"), F.lit(0), F.lit(1))
    return words.select("word", "n", F.explode(roles).alias("longer")).select("word", "n", "longer", F.lit(0).alias("a"), (size - F.coalesce("longer", F.lit(0))).alias("m"))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row under both halves of what it leaves open: the other half is whole and belongs to the segment."""
    h = F.floor(F.col("m") / 2).cast("int")
    halves = F.array(F.struct((F.col("a") + h).alias("a"), (F.col("m") - h).alias("m")), F.struct(F.col("a").alias("a"), h.alias("m")))
    return _keyed(rows.withColumn("half", F.explode(halves)).select("word", "n", "longer", "half.a", "half.m"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the hash of the length, the place left open and all that stands around it."""
    shift = F.coalesce("longer", F.lit(0))
    after = F.col("a") + F.col("m") + shift
    before = F.col("word").substr(F.lit(1), F.col("a"))
    rest = F.col("word").substr(after + 1, F.greatest(F.length("word") - after, F.lit(0)))
    return rows.withColumn("key", F.xxhash64(F.length("word") - shift, "a", "m", before, rest))


def _meet(rows: DataFrame) -> DataFrame:
    """Pairs of an index word and a probing word of one segment that are one edit apart."""
    index = rows.where("longer is null").select("key", F.col("word").alias("x"), F.col("n").alias("x_n"))
    probe = rows.where("longer is not null").select("key", "longer", F.col("word").alias("y"), F.col("n").alias("y_n"))
    one = F.levenshtein("x", "y", 1) == 1
    return index.join(probe, "key").where(((F.col("longer") == 1) | (F.col("x") < F.col("y"))) & one).select("x", "x_n", "y", "y_n")


def near_pairs(words: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """x, x_n, y, y_n: each pair of distinct words exactly one inserted, deleted or replaced code point apart, once.

    ``words``: word (distinct), n.
    """
    rows, level, found = _cut(_open_rows(words)), 0, None
    while True:
        rows = scratch.save(rows, f"segments-{level}")
        seen = rows.groupBy("key").agg(F.count_if(F.col("longer").isNull()).alias("i"), F.count_if(F.col("longer").isNotNull()).alias("p"), F.max("m").alias("m"))
        # a hash that different segments share is cut as long as any of them can be
        hot = scratch.save(seen.where((F.col("i") > most) & (F.col("p") > 0) & (F.col("m") > 1)).select("key"), f"hot-{level}")
        met = scratch.save(_meet(rows.join(hot, "key", "left_anti")), f"pairs-{level}")
        found = met if found is None else found.unionByName(met)
        if not hot.limit(1).count():
            return found.dropDuplicates(["x", "y"])
        rows = _cut(rows.join(hot, "key", "left_semi"))
        level += 1


def variants(words: DataFrame, scratch: Scratch, share: int = SHARE) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of ``words`` (word, n)."""
    pairs = scratch.save(near_pairs(words, scratch), "pairs")
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("other"), F.col("y_n").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("y").alias("word"), F.col("x").alias("other"), F.col("x_n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    led: Column = F.coalesce(-F.col("best.less") >= share * F.col("n"), F.lit(False))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, F.col("best.other")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n"))
    rows = scratch.save(rows, "forms")
    return rows.join(_roots(rows, scratch), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of the words that have a form: pointers are doubled until none moves, as counts grow ``share`` times a step."""
    point = scratch.save(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots-0")
    step = 0
    while True:
        up = point.select(F.col("word").alias("root"), F.col("root").alias("up"))
        nxt = scratch.save(point.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), f"roots-{step + 1}")
        point, step = nxt.select("word", "root"), step + 1
        if not nxt.where("moved").limit(1).count():
            return point


def group_variants(documents: DataFrame, least: int = LEAST_LENGTH, fewest: int = LEAST_COUNT, share: int = SHARE, every: int = CHANGED) -> DataFrame:
    """One row for each word of at least ``least`` code points and ``fewest`` occurrences: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n if that is ``share`` times the
    word's, ``root`` the end of the chain of forms.
    """
    scratch = Scratch(documents.sparkSession, "spelling")
    words = scratch.save(word_counts(documents, least, every).where(F.col("n") >= fewest), "words")
    return variants(words, scratch, share).select("word", "form", "root", "n", "n_near", "form_n")
