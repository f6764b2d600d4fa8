"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, all in DataFrame functions.

A window is 13 consecutive words of an item (a shorter item is one window).
It is contained in a document only if all its shingles are, so one of them is
a necessary prefix: the rarest, by exact counts over all documents.  The first
pass over the documents counts the items' shingles, the second joins each
window's prefix shingle to the documents' positions, keeps starts that lie
within the document (positional and length bounds) and compares the words of
the whole window.  Both joins send the benchmark's side, after a check of its
size, and so shuffle no text.  Beyond that size only positions and hashes are
shuffled: shingles are counted before they meet the benchmark's, places of
prefix shingles meet the windows in salted parts, and the words of the windows
so proposed are cut out of each document once and compared.

Cases: a null or empty text has no words and is clean; an item without words
has no windows; repeated documents and items, ties in rarity (settled by
position) and other columns change nothing; very long texts are one array of words
in a task; an empty table gives an empty result; rows that share a doc_id are told
apart by their text; a null doc_id keeps its row; items with a null item_id hit
like others, count as one item in n_items and are left out of items_sha256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.scratch import Scratch

WINDOW = 13
SHINGLE = 3
#: A document is contaminated when 1 in this many of its words is hit.
SHARE = 20
#: Bytes of the benchmark's side that are sent to all executors; more are joined by shuffling.
SENT_BYTES = 64 << 20
#: Parts into which a frequent shingle's places are dealt where they are shuffled.
SALTS = 16

_PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Runs of digits, letters and bytes beyond ASCII, with A-Z lower-cased and nothing else."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(low, _PARTS), "")


def shingles(tokens: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, in order."""
    at = F.sequence(F.lit(0), F.size(tokens) - k)
    return F.when(F.size(tokens) >= k, F.transform(at, lambda i: F.xxhash64(*(F.get(tokens, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """item_id, the window's words, their number, the shingle width for them (less than ``k`` for the shortest)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win")).distinct()
    return cut.select("item_id", "win", F.size("win").alias("len"), F.least(F.size("win"), F.lit(k)).alias("k"))


def _counted(docs: DataFrame, asked: DataFrame, widths: list[int], send: bool) -> DataFrame:
    """h, df, k: how often the documents hold the benchmark's shingles."""
    out = None
    for k in widths:
        own, mine = docs.select(F.explode(shingles(F.col("w"), k)).alias("h")), asked.where(F.col("k") == k).select("h")
        if send:
            one = own.join(F.broadcast(mine), "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("df"))
        else:  # counts come first, so that no frequent shingle is shuffled row by row
            one = own.groupBy("h").agg(F.count(F.lit(1)).alias("df")).join(mine, "h", "left_semi")
        one = one.withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def _met(docs: DataFrame, prefix: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, text_key, start, len, items of the windows that documents hold, by sending the prefixes."""
    out = None
    for k in widths:
        own = docs.select("doc_id", "text_key", "w", F.posexplode(shingles(F.col("w"), k)).alias("pos", "h"))
        met = own.join(F.broadcast(prefix.where(F.col("k") == k).select("win", "len", "at", "h", "items")), "h")
        met = met.where("pos >= at and pos - at + len <= size(w)").where("slice(w, pos - at + 1, len) = win")
        one = met.select("doc_id", "text_key", F.expr("pos - at").alias("start"), "len", "items")
        out = one if out is None else out.unionByName(one)
    return out


def _met_by_shuffling(docs: DataFrame, prefix: DataFrame, widths: list[int], scratch: Scratch) -> DataFrame:
    """The same for a benchmark of any size: no words travel with the positions.

    Rows without a doc_id go by -1: what a text holds does not depend on its id.
    """
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")))
    wanted = prefix.select("k", "h", "at", "len", F.xxhash64("win").alias("win_key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    places = None
    for k in widths:
        own = docs.select("doc_id", "text_key", F.size("w").alias("n"), F.posexplode(shingles(F.col("w"), k)).alias("pos", "h"))
        own = own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "pos"), F.lit(SALTS)).cast("int"))
        one = own.join(wanted.where(F.col("k") == k).drop("k"), ["h", "salt"]).where("pos >= at and pos - at + len <= n")
        one = one.select("doc_id", "text_key", F.struct(F.expr("pos - at").alias("start"), "len", "win_key").alias("c"))
        places = one if places is None else places.unionByName(one)
    # At most a few for each position of a document.
    places = scratch.save(places.groupBy("doc_id", "text_key").agg(F.collect_set("c").alias("c")), "places")
    cut = F.transform("c", lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), c["win_key"].alias("win_key"), F.slice("w", c["start"] + 1, c["len"]).alias("win")))
    proposed = docs.join(places, ["doc_id", "text_key"]).select("doc_id", "text_key", F.explode(cut).alias("c")).select("doc_id", "text_key", "c.*")
    proposed = proposed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "start"), F.lit(SALTS)).cast("int"))
    held = prefix.select("win", F.xxhash64("win").alias("win_key"), "items", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = proposed.join(held, ["win_key", "win", "salt"]).select("doc_id", "text_key", "start", "len", "items")
    bare = met.where("doc_id = -1").withColumn("doc_id", F.lit(None).cast("long"))
    return met.unionByName(bare)


def contamination(documents: DataFrame, benchmark: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and text_key, a hash of the text)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "decontaminate")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    wins = scratch.save(item_windows(benchmark), "windows", 4)
    widths = [r["k"] for r in wins.select("k").distinct().collect()]  # at most the few numbers up to SHINGLE
    # (window, position, shingle) rows of the benchmark
    pieces = None
    for k in widths:
        one = wins.where(F.col("k") == k).select("item_id", "win", "len", "k", F.posexplode(shingles(F.col("win"), k)).alias("at", "h"))
        pieces = one if pieces is None else pieces.unionByName(one)
    if pieces is None:
        hits = spark.createDataFrame([], "doc_id long, text_key long, start int, len int, item_id long")
    else:
        rows = wins.count() * (WINDOW - SHINGLE + 1)
        files = -(-rows // 250_000)  # of tables of the benchmark's size
        pieces = scratch.save(pieces, "pieces", files)
        asked = scratch.save(pieces.select("k", "h").distinct(), "asked", files)
        counted = _counted(docs, asked, widths, asked.count() * 48 <= sent_bytes)
        counted = scratch.save(counted, "counted", files)
        # Windows with a shingle that no document holds drop out at this inner join: they occur nowhere.
        whole = pieces.join(counted, ["k", "h"], "left").groupBy("item_id", "win", "len", "k").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at", "h")).alias("rare"))
        prefix = whole.where("rare.df > 0").groupBy("win", "len", "k", F.col("rare.at").alias("at"), F.col("rare.h").alias("h")).agg(F.collect_set(F.struct("item_id")).alias("items"))
        prefix = scratch.save(prefix, "prefix", files)
        size = prefix.agg(F.sum(F.octet_length(F.array_join("win", " ")) + 12 * F.size("win") + 24 * F.size("items") + 64).alias("b")).first()["b"] or 0
        met = _met(docs, prefix, widths) if size <= sent_bytes else _met_by_shuffling(docs, prefix, widths, scratch)
        found = met.select("doc_id", "text_key", "start", "len", F.explode("items").alias("item")).withColumn("item_id", F.col("item.item_id")).drop("item")
        hits = scratch.save(found.distinct(), "hits")
        scratch.keep("hits")
    at = hits.select("doc_id", "text_key", "start", "len").distinct().select("doc_id", "text_key", F.explode(F.expr("sequence(start, start + len - 1)")).alias("p")).distinct()
    n_hit = at.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select("doc_id", "text_key", "item_id").distinct().groupBy("doc_id", "text_key").agg(F.collect_list(F.col("item_id").cast("string")).alias("items"), F.count(F.lit(1)).alias("m"))
    per = n_hit.join(items, [n_hit["doc_id"].eqNullSafe(items["doc_id"]), n_hit["text_key"] == items["text_key"]]).select(n_hit["doc_id"].alias("d"), n_hit["text_key"].alias("t"), "n_hit", "items", "m")
    base = docs.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"))
    out = base.join(per, [base["doc_id"].eqNullSafe(per["d"]), base["text_key"] == per["t"]], "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce(F.array_sort("items"), F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("m", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((n > 0) & (SHARE * n >= F.col("n_words"))).alias("contaminated"), "text_key")


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(documents, benchmark).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_text")).distinct()
    bad = Scratch(documents.sparkSession, "decontaminate").save(bad, "bad")
    same = [documents["doc_id"].cast("long").eqNullSafe(bad["bad_id"]), F.xxhash64(documents["text"]) == bad["bad_text"]]
    return documents.join(bad, same, "left_anti")
