"""Hybrid retrieval: the vector arm, rank fusion, re-ranking, collapsing, paging, places.

Queries are small (a few terms, one vector, one point) and are part of the
expressions; candidates are ranked by top-k.  The keyword arms read the stored
index of ``operators.index``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import values as V

YEAR = r"\b(?:19|20)[0-9]{2}\b"
# Years, months, quarters, versions and document formats in titles. Fixed values.
EDITION = (
    YEAR + r"|\b(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec)\b"
    r"|\bq[1-4]\b|\bv(?:ersion)?\.?\s*[0-9]+\b|\b(?:odt|pdf)\b"
)


def tokens(text: Column) -> Column:
    """Q-1."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def terms_of(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", query.lower())


def topic_terms(query: str, place: str | None = None) -> list[str]:
    """The query's terms without the place's words, unless nothing is left."""
    every = terms_of(query)
    words = set((place or "").split())
    return [t for t in every if t not in words] or every


def postings(docs: DataFrame, key: str, fields: Mapping[str, float]) -> DataFrame:
    """Q-18: key, field, term, tf of every unstemmed term of a table, without an index."""

    def of(field: str) -> Column:
        return F.transform(tokens(F.col(field)), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))

    parts = F.flatten(F.array(*map(of, fields)))
    return docs.select(key, F.explode(parts).alias("p")).groupBy(key, "p.field", "p.term").agg(F.count(F.lit(1)).alias("tf"))


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """The dot product with a query vector; both are of unit length."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def vector_arm(vectors: DataFrame, key: str, vector: str, query: Sequence[float], rows: int = V.ARM_ROWS) -> DataFrame:
    """Q-2, O-1: key, rank, similarity of the nearest."""
    return ranked(vectors.select(key, cosine(F.col(vector), query).alias("similarity")), key, "similarity", rows, keep=True)


def ranked(scored: DataFrame, key: str, score: str, rows: int, keep: bool = False) -> DataFrame:
    """The first rows by score, then key, with their rank from 0 (a window over ``rows`` rows at most)."""
    top = scored.orderBy(F.desc(score), key).limit(rows)
    rank = (F.row_number().over(Window.orderBy(F.desc(score), key)) - 1).alias("rank")
    return top.select(key, rank, *([score] if keep else []))


def fuse(arms: Sequence[DataFrame], key: str) -> DataFrame:
    """Q-8, U-6: reciprocal rank fusion."""
    every = reduce(lambda a, b: a.unionByName(b), (a.select(key, (1.0 / (V.RRF_K + F.col("rank") + 1)).alias("part")) for a in arms))
    return every.groupBy(key).agg(F.sum("part").alias("score"))


def multiplier(rare: Column, publisher: Column, geo: Column, place_only: Column, availability: Column, resources: Column, foreign: Column, score: Column | float = 1.0) -> Column:
    """Q-9: the score times all boosts and demotions, one after the other (another order rounds otherwise); null signals count as false."""
    true = lambda c: F.coalesce(c, F.lit(False))
    m = score * F.when(true(rare), V.BOOST_RARE).otherwise(1.0) * F.when(true(publisher), V.BOOST_PUBLISHER).otherwise(1.0)
    m = m * F.when(true(geo) & (F.coalesce(availability, F.lit("")) != "dead") & ~true(place_only), V.BOOST_GEO).otherwise(1.0)
    m = m * F.when(true(place_only), V.PLACE_ONLY).otherwise(1.0)
    checked = reduce(lambda w, kv: w.when(availability == kv[0], kv[1]), list(V.AVAILABILITY_BOOST.items())[1:], F.when(availability == "data", V.AVAILABILITY_BOOST["data"]))
    m = m * checked.when(availability.isNull() & (F.coalesce(resources, F.lit(0)) == 0), V.UNKNOWN).otherwise(1.0)
    return m * F.when(true(foreign), V.FOREIGN).otherwise(1.0)


def collapse_duplicates(scored: DataFrame, key: str, canonical: DataFrame, retired: DataFrame) -> DataFrame:
    """Q-10: the best score of a canonical record's copies; ``canonical`` has key and canonical, ``retired`` key."""
    c = scored.join(canonical, key, "left").select(F.coalesce("canonical", key).alias(key), "score").join(retired, key, "left_anti")
    return c.groupBy(key).agg(F.max("score").alias("score"))


def series_key(title: Column) -> Column:
    """Q-11: the title without years, months, quarters, versions and document formats; null if it has none or nothing else."""
    low = F.lower(F.coalesce(title, F.lit("")))
    stripped = F.regexp_replace(low, EDITION, " ")
    slug = F.trim(F.regexp_replace(stripped, "[^a-z0-9]+", " "))
    return F.when((stripped != low) & (slug != ""), slug)


def collapse_editions(scored: DataFrame, key: str, title: str = "title", publisher: str = "publisher", modified: str = "modified") -> DataFrame:
    """Q-11: one row for each series: the newest edition with the best score; other records stay as they are."""
    s = scored.withColumn("series", series_key(F.col(title)))
    years = F.transform(F.regexp_extract_all(F.col(title), F.lit(YEAR), 0), lambda y: y.cast("int"))
    edition = F.struct(F.coalesce(F.array_max(years), F.lit(0)).alias("y"), F.coalesce(F.col(modified).cast("string"), F.lit("")).alias("m"), F.col(key).alias("k"))
    grouped = s.where("series is not null").groupBy(F.lower(F.coalesce(F.col(publisher), F.lit(""))).alias("p"), "series").agg(F.max(edition).alias("e"), F.max("score").alias("score"))
    return grouped.select(F.col("e.k").alias(key), "score").unionByName(s.where("series is null").select(key, "score"))


def page(scored: DataFrame, key: str, k: int = 10, offset: int = 0) -> DataFrame:
    """O-3: a page in order of score, then key."""
    return scored.orderBy(F.desc("score"), key).offset(offset).limit(k)


def confidence(similarity: float | None, any_result: bool, topic_seen: bool | None) -> str:
    """Q-12: ``topic_seen``: whether the first three results meet the topic; None if the query has none."""
    if not any_result or similarity is None or similarity < V.WEAK:
        return "none"
    return "strong" if similarity >= V.STRONG and topic_seen is not False else "weak"


def grams(query: str, longest: int = 6) -> list[tuple[int, int, str]]:
    """Runs of up to ``longest`` words of a query: their number, place and text."""
    w = terms_of(query)
    return [(n, i, " ".join(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def place_in(query: str, vocabulary: DataFrame, place: str = "place"):  # noqa: ANN201
    """Q-13 for one query: the vocabulary's row of the longest name in it, the last of equally long ones; None without any."""
    every = grams(query)
    if not every:
        return None
    seen = {r[place]: r for r in vocabulary.where(F.col(place).isin(sorted({g for _, _, g in every}))).collect()}  # at most a few for each word of the query
    return seen.get(max(((n, i, g) for n, i, g in every if g in seen), default=(0, 0, None))[2])


def detect_place(queries: DataFrame, vocabulary: DataFrame, query: str = "query", place: str = "place", longest: int = 6) -> DataFrame:
    """Q-13: adds the longest place name in a query, the last of equally long ones.

    ``vocabulary`` holds names in lower case; it is joined by equality of n-grams.
    """
    w = F.split(F.trim(F.regexp_replace(F.lower(query), "[^a-z0-9]+", " ")), " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.struct(n.alias("n"), i.alias("i"), F.array_join(F.slice(w, i, n), " ").alias("gram")))).otherwise(F.array().cast("array<struct<n:int,i:int,gram:string>>"))))
    keyed = queries.withColumn("place_row", F.monotonically_increasing_id())
    hit = keyed.select("place_row", F.explode(spans).alias("s")).select("place_row", "s.*").join(vocabulary.select(F.col(place).alias("gram")).distinct(), "gram")
    best = hit.groupBy("place_row").agg(F.max_by("gram", F.struct("n", "i")).alias(place))
    return keyed.join(best, "place_row", "left").drop("place_row")
