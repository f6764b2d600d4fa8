"""A stored inverted index: postings by term with the tokens' stems, records and counts.

Texts are folded (case and diacritics), split and stemmed once, when the index
is built.  A query reads the postings of its own terms only: they lie in
folders by a hash of the term and in order of terms within files, so that both
the folders and the row groups of other terms are skipped.  Everything that
the arms of a search ask of the keywords comes from one aggregate over them.

Records are dealt to blocks: those of about one length stand together, and a
block is a range of such places.  Within a term postings lie in order of places,
and for every term that many records hold a small table has the most that any
record of a block can score by it.  ``top`` reads the best blocks first; what its
rows score is a bound that lets all blocks fall which cannot reach it, and the
places that are left reach the scan as ranges.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import values as V
from ledgerlark.functions.logic import any_of
from ledgerlark.functions.text import fold, stem
from ledgerlark.operators.retrieval import ranked, terms_of
from ledgerlark.session import spread

#: Part of a stored index's name; another one for another layout or analyser.
LAYOUT = "search-index-6"
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Words of a stem, by stem: where they are stated, no other word is taken for one of them (a stemmer joins too much now and then).
Forms = Mapping[str, Sequence[str]]
#: Text bytes whose postings share a folder, and those whose postings share a task and a file of a folder.
FOLDER_TEXT, FILE_TEXT = 1 << 28, 1 << 25
#: Text bytes that are counted at once.
PART_TEXT = 1 << 22
#: Records of a block, about, and how many records must hold a term for it to have blocks.
BLOCK = 4_096
#: Places of records of one length; blocks are ranges of them.
PLACES = 1 << 24
#: Terms with blocks, in bytes, that every task holds; more are joined by a shuffle.
COMMON_BYTES = 1 << 26
#: Rows of a parquet page, below which nothing is skipped.
PAGE_ROWS = 4_096
#: Blocks that are read first, and ranges of places that a scan takes as filters; more are joined.
FIRST_BLOCKS, RANGES = 16, 200
_TOKEN = re.compile("[a-z0-9]+")
# An index folder is never written twice.
_STATS: dict[str, Row] = {}
_COUNTS: dict[tuple[str, str], Row | None] = {}


def _postings(batches: Iterator[pa.RecordBatch], fields: Sequence[str], forms: Forms | None = None, bare: bool = False) -> Iterator[pa.RecordBatch]:
    """key, term, tf (by field), length of every term of every record; ``lead`` marks one row of each record.

    ``bare``: a record without any token has a row of an empty term.
    """
    known: dict[str, str] = {}

    def of(word: str) -> str:
        if word not in known:
            if len(known) >= 1 << 18:
                known.clear()
            known[word] = term_of(word, forms)
        return known[word]

    for batch in batches:
        for part in _parts(batch, fields):
            yield from _counted(part, fields, of, bare)


def _parts(batch: pa.RecordBatch, fields: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's records with about ``PART_TEXT`` bytes of text."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(f)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // PART_TEXT)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _counted(batch: pa.RecordBatch, fields: Sequence[str], of: Callable[[str], str], bare: bool) -> Iterator[pa.RecordBatch]:
    """The postings of a few records: tokens are numbered, and counted by record and term."""
    tokens: list[str] = []
    many = np.zeros((batch.num_rows, len(fields)), np.int64)
    for j, f in enumerate(fields):
        for i, x in enumerate(batch.column(f).to_pylist()):
            if x:
                found = _TOKEN.findall(fold(x))
                many[i, j] = len(found)
                tokens += found
    words, distinct = pd.factorize(np.array(tokens, dtype=object))
    stems, terms = pd.factorize(np.array([of(w) for w in distinct], dtype=object))
    row = np.concatenate([np.repeat(np.arange(batch.num_rows), many[:, j]) for j in range(len(fields))])
    field = np.repeat(np.arange(len(fields)), many.sum(axis=0))
    place, back = np.unique(row * max(len(terms), 1) + stems[words], return_inverse=True)
    tf = np.bincount(back * len(fields) + field, minlength=len(place) * len(fields)).astype(np.int32)
    at, term = np.divmod(place, max(len(terms), 1))
    lead = np.diff(at, prepend=-1) != 0
    names = pa.array(terms.tolist(), pa.string())
    if bare and len(none := np.flatnonzero(many.sum(axis=1) == 0)):
        names = pa.concat_arrays([names, pa.array([""], pa.string())])
        at, term, lead = np.concatenate([at, none]), np.concatenate([term, np.full(len(none), len(terms))]), np.concatenate([lead, np.ones(len(none), bool)])
        tf = np.concatenate([tf, np.zeros(len(none) * len(fields), np.int32)])
    length = many.sum(axis=1)[at]
    for lo in range(0, len(at), 100_000):
        hi = min(lo + 100_000, len(at))
        counts = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * len(fields), len(fields)), pa.int32()), pa.array(tf[lo * len(fields) : hi * len(fields)]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[lo:hi])), names.take(pa.array(term[lo:hi])), counts, pa.array(length[lo:hi]), pa.array(lead[lo:hi])], names=["key", "term", "tf", "length", "lead"])


def term_of(word: str, forms: Forms | None = None) -> str:
    """The term under which a word is indexed: its stem, or the word itself where ``forms`` states the stem's words and it is none of them.

    Such a word that is spelled as the stem is marked, so that it is not taken for the stem.
    """
    word = fold(word)
    term = stem(word)
    if word in (forms or {}).get(term, (word,)):
        return term
    return word if word != term else f"={word}"


def _folder(term: Column, folders: int) -> Column:
    return (F.crc32(term.cast("binary")) % folders).cast("int")


def _size_class(length: Column) -> Column:
    """Four classes for each doubling of a record's length."""
    return F.floor(4 * F.log2(length + 1)).cast("long")


def _weighed(fields: Mapping[str, float]) -> Column:
    """A posting's count, by the weights of the fields."""
    return reduce(lambda a, b: a + b, (F.get("tf", F.lit(i)) * float(w) for i, w in enumerate(fields.values())))


def saturation(tf: Column, length: Column, mean: float) -> Column:
    """What BM25 makes of a term's count, before its rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def rarity(n: int, df: int) -> float:
    """The term's weight in BM25; it has a small floor."""
    return max(math.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)


@dataclass
class SearchIndex:
    """A written index: see ``build``."""

    spark: SparkSession
    path: str
    key: str
    fields: Mapping[str, float]
    forms: Forms | None = None  # those that the index was built with

    @staticmethod
    def build(docs: DataFrame, key: str, fields: Mapping[str, float], path: str, publisher: str | None = None, block: int = BLOCK, forms: Forms | None = None) -> None:
        """Q-18: writes postings, terms, blocks, stats and publishers (their names and record counts) under ``path``.

        Null texts are empty; a null key is left out; repeated keys are records of their own.
        """
        docs = docs.where(F.col(key).isNotNull())
        spark = docs.sparkSession
        size, records = docs.agg(F.sum(reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(F.col(f)), F.lit(0)).cast("long") for f in fields))).alias("b"), F.count(F.lit(1)).alias("n")).first()
        folders = max(8, (size or 0) // FOLDER_TEXT)
        dealt = 1 + (size or 0) // (folders * FILE_TEXT)
        kind = dict(docs.dtypes)[key]
        rows = spread(docs.select(F.col(key).alias("key"), *(F.col(f).cast("string").alias(f) for f in fields)), -(-(size or 0) // FILE_TEXT)).mapInArrow(partial(_postings, fields=tuple(fields), forms=forms), f"key {kind}, term string, tf array<int>, length long, lead boolean")
        rows = rows.withColumn("at", _size_class(F.col("length")) * PLACES + F.pmod(F.xxhash64("key"), F.lit(PLACES)))
        # Numbered partitions: a hash of folder and share would put several of them into one.  Shares are ranges of places, so that a term's block lies in one or two files.
        share = F.col("folder") * dealt + F.floor(F.pmod("at", F.lit(PLACES)) * dealt / PLACES).cast("int")
        rows = rows.withColumn("folder", _folder(F.col("term"), folders)).repartitionById(folders * dealt, share)
        rows.sortWithinPartitions("folder", "term", "at").write.option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("folder").parquet(f"{path}/postings")
        every = spark.read.parquet(f"{path}/postings")
        # A row for each class of length.  Records without any token count for the mean, too.
        seen = every.where("lead").groupBy(_size_class(F.col("length")).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).collect()
        mean = sum(r["tokens"] for r in seen) / max(records, 1)
        widths = {r["c"]: max(1, PLACES // -(-r["n"] // block)) for r in seen}
        spark.createDataFrame([(records, mean, folders, block, widths)], "n long, mean double, folders long, block long, widths map<long,long>").coalesce(1).write.parquet(f"{path}/stats")
        most = saturation(_weighed(fields), F.col("length"), mean or 1.0)
        held = F.array(*(F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(fields))))
        terms = every.groupBy("folder", "term").agg(F.count(F.lit(1)).alias("df"), F.max(most).alias("most"), held.alias("held"))
        terms.repartitionById(folders, F.col("folder")).sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(f"{path}/terms")
        common = spark.read.parquet(f"{path}/terms").where(F.col("df") > block).select("folder", "term")
        # Shuffled, all postings of a term would meet in one task.
        if (common.agg(F.sum(F.octet_length("term") + 16).alias("b")).first()["b"] or 0) <= COMMON_BYTES:
            common = F.broadcast(common)
        blocks = every.join(common, ["folder", "term"], "left_semi").groupBy("folder", "term", _block(F.col("at"), widths).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.max(most).alias("most"))
        blocks.repartitionById(folders, F.col("folder")).sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{path}/blocks")
        if publisher:
            docs.groupBy(F.col(publisher).alias("publisher")).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/publishers")

    @property
    def stats(self) -> Row:
        """n, mean, folders; an index folder is never written twice."""
        if self.path not in _STATS:
            _STATS[self.path] = self.spark.read.parquet(f"{self.path}/stats").first()
        return _STATS[self.path]

    def _of(self, table: str, terms: Sequence[str], schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        folders = sorted({zlib.crc32(t.encode()) % self.stats["folders"] for t in terms})
        return reader.parquet(f"{self.path}/{table}").where(F.col("folder").isin(folders) & F.col("term").isin(list(terms)))

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """The postings of these terms (stems), folders and row groups of others skipped."""
        return self._of("postings", terms)

    def counts(self, terms: Sequence[str]) -> dict[str, Row]:
        """term: df, most (its greatest saturation), held (how many records hold it in each field)."""
        unseen = [t for t in terms if (self.path, t) not in _COUNTS]
        if unseen:
            if len(_COUNTS) > 1 << 16:
                _COUNTS.clear()
            found = {r["term"]: r for r in self._of("terms", unseen).collect()}  # a row for each term of a query
            _COUNTS.update({(self.path, t): found.get(t) for t in unseen})
        return {t: row for t in terms if (row := _COUNTS[self.path, t]) is not None}

    def terms(self, words: Sequence[str]) -> list[str]:
        """The terms of a query's words, each once."""
        return list(dict.fromkeys(term_of(w, self.forms) for w in words))

    def matches(self, words: Sequence[str], publisher: str | None = None) -> Matches:
        """What the arms of a search ask of these words of a query."""
        terms = self.terms(words)
        place = list(self.fields).index(publisher) if publisher else None
        pub = F.get("tf", F.lit(place)) > 0 if publisher else F.lit(False)
        rows = self.postings(terms).select("key", "term", "length", _weighed(self.fields).alias("w"), pub.alias("pub"))
        found = {t: (r["df"], r["held"][place] if publisher else 0) for t, r in self.counts(terms).items()}
        return Matches(self, terms, _by_key(rows, terms), found)

    def top(self, words: Sequence[str], rows: int = V.ARM_ROWS, digits: int | None = None) -> DataFrame:
        """O-2: key, bm25 (rounded to ``digits``) of the best records by the words, exactly those of a whole read, ties by key."""
        terms = self.terms(words)
        seen = self.counts(terms)
        found = {t: seen[t] for t in terms if t in seen}  # sums are in the order of the words
        weight = {t: rarity(self.stats["n"], r["df"]) for t, r in found.items()}
        common = [t for t, r in found.items() if r["df"] > self.stats["block"]]
        rare = [t for t in found if t not in common]
        parts = self._own(rare)
        if common:
            left = self._left(self._own(common), common, rare, weight, rows, 0.0 if digits is None else 10.0**-digits)
            parts = left.unionByName(parts) if rare else left
        return _rounded(self._scored(parts, found), digits).orderBy(F.desc("bm25"), "key").limit(rows)

    def _own(self, terms: Sequence[str]) -> DataFrame:
        return self.postings(terms).select("key", "at", "term", "length", _weighed(self.fields).alias("w"), F.lit(False).alias("pub"))

    def _scored(self, parts: DataFrame, found: Mapping[str, Row]) -> DataFrame:
        return _by_key(parts, list(found)).select("key", _bm25(self, list(found), {t: r["df"] for t, r in found.items()}).alias("bm25"))

    def bounds(self, weight: Mapping[str, float], common: Sequence[str]) -> DataFrame:
        """block, n (postings), most: the most that the common terms can give to a record of the block."""
        idf = reduce(lambda c, t: c.when(F.col("term") == t, weight[t]), common[1:], F.when(F.col("term") == common[0], weight[common[0]]))
        return self._of("blocks", common, "term string, block long, n long, most double, folder int").groupBy("block").agg(F.sum("n").alias("n"), F.sum(idf * F.col("most")).alias("most"))

    def _left(self, postings: DataFrame, common: list[str], rare: list[str], weight: Mapping[str, float], rows: int, slack: float = 0.0) -> DataFrame:
        """The postings of the common terms without blocks that hold no record of the best ``rows``, or of less than ``slack`` below them."""
        widths = self.stats["widths"]
        bounds = self.bounds(weight, common)
        first = [r["block"] for r in bounds.orderBy(F.desc("most"), "block").limit(FIRST_BLOCKS).collect()]
        part = lambda df, terms: df.groupBy("key").agg(F.first("at").alias("at"), F.sum(_part(self, weight, terms)).alias("part"))
        sure = part(postings.where(_inside(first, widths)), common)
        # Records with a rare term, at most a block's worth for each term: their own parts are read whole.
        rarely = part(self._own(rare), rare) if rare else None
        if rarely is not None:
            sure = sure.unionByName(rarely)
        best = [r["s"] for r in sure.groupBy("key").agg(F.max("part").alias("s")).orderBy(F.desc("s")).limit(rows).collect()]
        # Sums in another order differ by their rounding.
        least = best[-1] * (1 - 1e-9) - slack if len(best) == rows else 0.0
        todo = bounds.where(F.col("most") >= least).select("block")
        if rarely is not None:
            also = rarely.join(bounds, _block(F.col("at"), widths) == F.col("block")).where(F.col("part") + F.col("most") >= least)
            todo = todo.unionByName(also.select("block")).distinct()
        listed = [r["block"] for r in todo.limit(8 * RANGES + 1).collect()]
        if len(listed) <= 8 * RANGES and len(_ranges(listed, widths)) <= RANGES:
            return postings.where(_inside(listed, widths))
        return postings.join(todo, _block(F.col("at"), widths) == F.col("block"), "left_semi")


def _block(at: Column, widths: Mapping[int, int]) -> Column:
    """The first place of the block in which a place lies."""
    width = F.try_element_at(F.create_map(*(F.lit(x).cast("long") for pair in sorted(widths.items()) for x in pair)), F.floor(at / PLACES).cast("long")) if widths else F.lit(1)
    return (at - F.pmod(F.pmod(at, F.lit(PLACES)), width)).cast("long")


def _ranges(blocks: Sequence[int], widths: Mapping[int, int]) -> list[tuple[int, int]]:
    """The places of blocks as ranges that do not touch."""
    out: list[tuple[int, int]] = []
    for b in sorted(blocks):
        end = min(b + widths[b // PLACES], (b // PLACES + 1) * PLACES)
        if out and out[-1][1] == b:
            out[-1] = (out[-1][0], end)
        else:
            out.append((b, end))
    return out


def _inside(blocks: Sequence[int], widths: Mapping[int, int]) -> Column:
    return any_of((F.col("at") >= lo) & (F.col("at") < hi) for lo, hi in _ranges(blocks, widths))


def _rounded(scored: DataFrame, digits: int | None) -> DataFrame:
    return scored if digits is None else scored.withColumn("bm25", F.round("bm25", digits))


def _by_key(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """key, length and for each term its weighted count and whether the publisher's name has it."""
    cols = [F.max("length").alias("length")]
    for i, t in enumerate(terms):
        cols += [F.coalesce(F.max(F.when(F.col("term") == t, F.col("w"))), F.lit(0.0)).alias(f"tf_{i}"), F.coalesce(F.max(F.when(F.col("term") == t, F.col("pub"))), F.lit(False)).alias(f"pub_{i}")]
    return rows.groupBy("key").agg(*cols)


def _bm25(index: SearchIndex, terms: Sequence[str], df: Mapping[str, int], words: Sequence[str] | None = None) -> Column:
    score = F.lit(0.0)
    for t in terms if words is None else index.terms(words):
        if df.get(t):
            score = score + rarity(index.stats["n"], df[t]) * saturation(F.col(f"tf_{terms.index(t)}"), F.col("length"), index.stats["mean"] or 1.0)
    return score


def _part(index: SearchIndex, weight: Mapping[str, float], terms: Sequence[str]) -> Column:
    """What a posting of one of the terms gives to its record's score."""
    idf = reduce(lambda c, t: c.when(F.col("term") == t, weight[t]), terms[1:], F.when(F.col("term") == terms[0], weight[terms[0]]))
    return idf * saturation(F.col("w"), F.col("length"), index.stats["mean"] or 1.0)


@dataclass
class Matches:
    """The records with any of a query's terms: key, length and for each term its weighted count."""

    index: SearchIndex
    terms: list[str]
    rows: DataFrame
    found: dict[str, tuple[int, int]]  # how many records hold a term, and how many in the publisher's name

    def _has(self, words: Sequence[str]) -> list[Column]:
        return [F.col(f"tf_{self.terms.index(t)}") > 0 for t in self.index.terms(words)]

    def bm25(self, words: Sequence[str]) -> Column:
        """Okapi BM25 with the reserved constants; counts are weighted by field; idf has a small floor."""
        return _bm25(self.index, self.terms, {t: n for t, (n, _) in self.found.items()}, words)

    def any(self, words: Sequence[str]) -> Column:
        """Whether a record has any of the words."""
        return reduce(lambda a, b: a | b, self._has(words), F.lit(False))

    def all(self, words: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, self._has(words), F.lit(bool(words)))

    def keyword_arm(self, words: Sequence[str], rows: int = V.ARM_ROWS) -> DataFrame:
        """Q-3: key, rank (from 0) of the best by BM25."""
        return ranked(self.index.top(words, rows), "key", "bm25", rows)

    def geo_arm(self, words: Sequence[str], inside: DataFrame, rows: int = V.ARM_ROWS, digits: int | None = None, keep: bool = False) -> DataFrame:
        """Q-5: key, rank of records with every word whose box holds the point (``inside``: their keys).

        With ``digits`` the ranks are those of rounded scores, ties by key; ``keep``: with bm25.
        """
        held = self.rows.where(self.all(words)).select("key", self.bm25(words).alias("bm25") if words else F.lit(0.0).alias("bm25"))
        return ranked(_rounded(held, digits).join(inside, "key", "left_semi"), "key", "bm25", rows, keep)

    def rare(self, words: Sequence[str]) -> Column:
        """Q-4: whether a record has the rarest of two or more words over two letters, unless even that is common."""
        words = [w for w in words if len(w) > 2]
        of = lambda w: term_of(w, self.index.forms)
        seen = sorted((self.found[of(w)][0], w) for w in set(words) if of(w) in self.found)
        if len(words) < 2 or not seen or seen[0][0] > V.RARE_DF:
            return F.lit(False)
        return self._has([seen[0][1]])[0]

    def topic(self, words: Sequence[str]) -> Column | None:
        """Q-6: whether a record has any topic word over two letters; None for a query that is only a place."""
        words = [w for w in words if len(w) > 2]
        return self.any(words) if words else None

    def publisher(self, words: Sequence[str], most: int = V.PUBLISHER_HITS) -> Column:
        """Q-7: whether the publisher's name has a word over three letters that few enough records' publishers have."""
        good = [t for t in self.index.terms([w for w in words if len(w) > 3]) if 0 < self.found.get(t, (0, 0))[1] <= most]
        return reduce(lambda a, b: a | b, (F.col(f"pub_{self.terms.index(t)}") for t in good), F.lit(False))


def words_of(query: str, place: str | None) -> tuple[list[str], list[str]]:
    """All terms of a query, and those that are not the place's."""
    every = terms_of(query)
    return every, [t for t in every if t not in set((place or "").split())]
