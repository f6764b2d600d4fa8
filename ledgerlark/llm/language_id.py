"""Language ID by fusing evidence: text likelihoods, declared markup language, address suffix and host priors.

Text: letter trigrams under one multinomial for each language, fitted on a
bounded sample of rows with a declared language (``FIT_ROWS`` for each), and a
tempered sum (neighbouring trigrams are not independent).  Declared language
and suffix: how often each is seen with each language, by counts over all rows
under the text's own verdict.  Host: shares of languages among all rows of the
host, smoothed towards those of its suffix, and these towards those of all
rows, by grouped aggregation.  The posterior is their normalised product.

Every declared language is told apart.  A text of some length so unlike all of
them that uniform trigrams explain it far better is of no language known here,
``und``.  A row is rejected when its text is not language: without any letter,
or of no language known here and with A-Z spread as evenly as random letters.
Neither depends on the posterior, which only names the language of a row:
``keep_language`` keeps the same rows whatever its evidence.

Cases: a null or empty text has no evidence of its own, its language is
``und`` and it is rejected; null or unknown declarations, hosts and suffixes
weigh nothing; without any declared language all rows are ``und``, and those
with language are accepted; ties go to the first language by name; repeated rows
count and are judged each; very long texts are read whole; an empty table gives an
empty result; other columns are kept by ``keep_language`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.scratch import Scratch
from ledgerlark.llm.wordhash import buffers, slices, tidy

#: At most about so many declared rows of each language fit its trigrams.
FIT_ROWS = 2_000
BUCKETS = 1 << 14
#: Trigrams after which more text adds no certainty.
FULL_TEXT = 60.0
#: Pseudo-counts that pull a host towards its suffix, a suffix towards all rows, and counts of declarations.
PULL = 20.0
#: Trigrams from which a text can be unlike any language, and by how much uniform ones must explain it better (nats each).
JUDGED, WORSE = 64, 1.0
#: Chance that two letters of a text are the same, up to which they count as random; 26 even ones have 0.038, languages 0.05 and more.
EVEN = 0.043
#: Languages whose counts a task holds at once.
HELD = 64

_FOLD = np.zeros(256, np.int64)
for _c in range(65, 91):
    _FOLD[_c] = _FOLD[_c + 32] = _c - 64
for _c in range(128, 256):
    _FOLD[_c] = _c - 100


def has_letter(column: pa.Array) -> np.ndarray:
    body, at = buffers(column)
    seen = np.concatenate([[0], np.cumsum(_FOLD[body] > 0)])
    return seen[at[1:]] > seen[at[:-1]]


def uneven(text: str) -> bool:
    """Whether letters repeat more than random ones of A-Z do, or some are beyond ASCII."""
    n = np.bincount(_FOLD[np.frombuffer(text.encode(), np.uint8)], minlength=27)[1:]
    own = n[:26]
    return bool(n[26:].sum() * 50 > n.sum() or (own * (own - 1)).sum() > EVEN * own.sum() * (own.sum() - 1))


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all texts, where two letters stand together, and n + 1 offsets into them."""
    body, at = buffers(column)
    if len(body) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    second = np.concatenate([[False], body[:-1] == 0xC3]) & (body >= 0x80) & (body <= 0x9E)
    letter = _FOLD[np.where(second, body + 0x20, body)]  # A-Z, and Latin-1 capitals by their second byte
    code = (letter[:-2] * 160 + letter[1:-1]) * 160 + letter[2:]
    keep = (letter[1:-1] > 0) & ((letter[:-2] > 0) | (letter[2:] > 0))
    for edge in at[1:-1]:
        if edge > 0:
            keep[max(0, edge - 2) : edge] = False
    place = np.flatnonzero(keep)
    bucket = ((code[place] * 0x9E3779B1) >> 7) & (BUCKETS - 1)
    return bucket, np.searchsorted(place, at)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in total.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(own[some])], names=["lang", "bucket", "n"])
        total.clear()

    for batch in batches:
        for part in slices(batch):
            bucket, at = grams(part.column("text"))
            for lang, a, b in zip(part.column("declared").to_pylist(), at[:-1], at[1:]):
                if lang not in total and len(total) == HELD:
                    yield from flush()
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(bucket[a:b], minlength=BUCKETS)
    yield from flush()


def primary(tag: Column) -> Column:
    """``de-AT`` and ``DE_de`` are ``de``; blank is null."""
    code = F.regexp_extract(F.lower(F.trim(tag.cast("string"))), "^([a-z]{2,3})(?:[-_]|$)", 1)
    return F.when(code != "", code)


def evidence_of_documents(documents: DataFrame) -> DataFrame:
    """doc_id, text, declared, host, suffix of documents: the source stands for the host, there is no address."""
    return documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), primary(F.col("lang")).alias("declared"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"))


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """The same of web pages: the markup's lang attribute, the host, the last label of the host; tags are cut out of the text."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    tag = F.regexp_extract(html, r"(?i)<html[^>]{0,300}?\blang=[\"']?([A-Za-z_-]+)", 1)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "://([^/?#:]+)", 1))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>|&[A-Za-z#0-9]+;", " ")
    suffix = F.regexp_extract(host, r"\.([a-z]+)$", 1)
    return pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), primary(tag).alias("declared"), F.when(host != "", host).alias("host"), F.when(suffix != "", suffix).alias("suffix"))


def identify(evidence: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """For each row of (id, text, declared, host, suffix): id, language, posterior, declared, accepted (and text_key)."""
    spark = evidence.sparkSession
    scratch = Scratch(spark, "language")
    said = evidence.where("declared is not null").groupBy("declared").count().collect()  # at most a row for each code of two or three letters
    names = sorted(r["declared"] for r in said)
    at_most = spark.createDataFrame([(r["declared"], int(min(1.0, fit_rows / r["count"]) * (1 << 20))) for r in said], "declared string, at_most int")
    part = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20))
    seen = evidence.where("declared is not null").join(F.broadcast(at_most), "declared").where(part < F.col("at_most")).select("declared", "text").mapInArrow(_counts, "lang string, bucket long, n long")
    seen = seen.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows for each language
    table = np.zeros((len(names), BUCKETS))
    np.add.at(table, (np.searchsorted(names, seen["lang"].to_numpy(dtype=str)), seen["bucket"].to_numpy(dtype=np.int64)), seen["n"].to_numpy())
    logs = np.log((table + 0.05) / (table.sum(1, keepdims=True) + 0.05 * BUCKETS)).astype(np.float32)
    sent = spark.sparkContext.broadcast((logs, np.float32(-np.log(BUCKETS))))

    @tidy
    def read(batches):  # noqa: ANN001, ANN202
        logs, flat = sent.value
        for batch in batches:
            for own in slices(batch):
                bucket, at = grams(own.column("text"))
                n = np.diff(at)
                total = np.zeros((len(n), len(logs)))
                some = n > 0
                if some.any():
                    for k, row in enumerate(logs):
                        total[some, k] = np.add.reduceat(row[bucket], at[:-1][some], dtype=np.float64)
                mean = total / np.maximum(n, 1)[:, None]
                known = has_letter(own.column("text")) & ((n < JUDGED) | (mean.max(1, initial=-np.inf) > flat - WORSE))
                score = mean * np.minimum(n, FULL_TEXT)[:, None]
                language = known.copy()
                for i in np.flatnonzero((n >= JUDGED) & ~known):
                    language[i] = uneven(own.column("text")[int(i)].as_py())
                best = score.argmax(1) if len(logs) else np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("id", "text_key", "declared", "host", "suffix")), pa.array(list(score), pa.list_(pa.float64())), pa.array(best), pa.array(known), pa.array(language)], names=["id", "text_key", "declared", "host", "suffix", "score", "best", "known", "language"])

    schema = "id long, text_key long, declared string, host string, suffix string, score array<double>, best long, known boolean, language boolean"
    rows = scratch.save(evidence.withColumn("text_key", F.xxhash64("text")).select("id", "text_key", "text", "declared", "host", "suffix").mapInArrow(read, schema), "rows")

    if not names:
        return rows.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), "declared", F.col("language").alias("accepted"), "text_key")

    # Counts of each language, by the text's own verdict, overall and for each value of the other evidence.
    told = rows.where("known")
    L = len(names)
    every = np.zeros(L)
    for r in told.groupBy("best").count().collect():  # at most a row for each language
        every[r["best"]] = r["count"]
    share = (every + 1) / (every.sum() + L)

    def by(column: str) -> DataFrame:
        n = told.where(F.col(column).isNotNull()).groupBy(column, "best").agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy(column).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("m"), F.sum("n").alias("n"))

    def counts(m: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(L - 1)), lambda i: F.coalesce(F.try_element_at(m, i.cast("long")), F.lit(0)).cast("double"))

    overall = F.array(*(F.lit(float(x)) for x in share))
    suffix = by("suffix").select("suffix", F.zip_with(counts(F.col("m")), overall, lambda x, p: x + PULL * p).alias("s"), F.col("n").alias("sn"))
    suffix = suffix.select("suffix", F.transform("s", lambda x: x / (F.col("sn") + PULL)).alias("suffix_share"))
    pairs = told.where("host is not null").select("host", "suffix").distinct().groupBy("host").agg(F.max("suffix").alias("suffix"))
    host = by("host").join(pairs, "host").join(suffix, "suffix", "left")
    prior = F.coalesce("suffix_share", overall)
    host = host.select("host", F.zip_with(counts(F.col("m")), prior, lambda x, p: (x + PULL * p)).alias("h"), F.col("n").alias("hn"))
    host = scratch.save(host.select("host", F.transform("h", lambda x: F.log(x / (F.col("hn") + PULL))).alias("host_log")), "hosts", None)
    # P(declared | language): counts by language, smoothed by the declaration's overall share.
    said_n = told.where("declared is not null").groupBy("declared", "best").count().collect()  # at most the number of languages squared
    place = {name: i for i, name in enumerate(names)}
    seen_with = np.full((L, L), 0.0)
    for r in said_n:
        seen_with[place[r["declared"]], r["best"]] = r["count"]
    overall_said = (seen_with.sum(1) + 1) / (seen_with.sum() + L)
    given = np.log((seen_with + PULL * overall_said[:, None]) / (seen_with.sum(0, keepdims=True) + PULL))
    declared = F.broadcast(spark.createDataFrame([(name, given[i].tolist()) for i, name in enumerate(names)], "declared string, said_log array<double>"))
    base = F.array(*(F.lit(float(x)) for x in np.log(share)))
    none = F.array(*(F.lit(0.0) for _ in names))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    out = rows.join(host, "host", "left").join(declared, "declared", "left")
    total = add(add(F.col("score"), F.coalesce("host_log", base)), F.coalesce("said_log", none))
    out = out.select("id", "text_key", "declared", "known", "language", total.alias("total"))
    top = F.array_max("total")
    out = out.select("id", "text_key", "declared", "known", "language", (F.array_position("total", top) - 1).cast("int").alias("k"), (1.0 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("posterior"))
    name = F.when(F.col("known"), F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)).otherwise(F.lit("und"))
    return out.select("id", name.alias("language"), F.when(F.col("known"), F.round("posterior", 6)).otherwise(F.lit(0.0)).alias("posterior"), "declared", F.col("language").alias("accepted"), "text_key")


def document_languages(documents: DataFrame) -> DataFrame:
    """One row for each document: doc_id, language, posterior, declared, accepted."""
    return identify(evidence_of_documents(documents)).withColumnRenamed("id", "doc_id").drop("text_key")


def keep_language(documents: DataFrame) -> DataFrame:
    """The documents whose text is language, all columns kept."""
    judged = identify(evidence_of_documents(documents)).where(~F.col("accepted")).select(F.col("id").alias("bad_id"), F.col("text_key").alias("bad_text")).distinct()
    bad = Scratch(documents.sparkSession, "language").save(judged, "rejected")
    same = [documents["doc_id"].cast("long").eqNullSafe(bad["bad_id"]), F.xxhash64(documents["text"].cast("string")) == bad["bad_text"]]
    return documents.join(bad, same, "left_anti")
