"""Queries that meet a table of names with a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.mentions import beginnings, mentions, named_elsewhere
from ledgerlark.registry import query
from ledgerlark.session import table as t

_HOST = "lower(regexp_extract(url, '([A-Za-z0-9-]+)[.]example[.]', 1))"


@query("hosts_named_elsewhere", f"""WITH p AS (SELECT page_id, {_HOST} AS owner, lower(html) AS said FROM pages), n AS (SELECT DISTINCT owner FROM p WHERE owner <> ''),
c AS MATERIALIZED (SELECT n.owner, p.owner AS other, p.page_id, p.said FROM n JOIN p ON p.owner <> n.owner AND contains(p.said, n.owner)),
h AS (SELECT owner, other FROM c WHERE regexp_matches(said, '(^|[^\\pL\\pN])' || regexp_escape(owner) || '($|[^\\pL\\pN])')) SELECT owner, count(*) AS texts, count(DISTINCT other) AS owners FROM h GROUP BY 1""")
def hosts_named_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    """J-18: the names in hosts that the pages of other hosts say."""
    p = t(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "([A-Za-z0-9-]+)[.]example[.]", 1)).alias("owner"), "html")
    return named_elsewhere(p, "page_id", "owner", "html").drop("hits")


_NAMES = """SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer UNION SELECT c_mktsegment FROM customer UNION SELECT unnest(string_split(p_name, ' ')) FROM part
UNION SELECT array_to_string(w[1:2], ' ') FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark)"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Names of nations, regions, suppliers, customers, segments and goods, and the two words that each benchmark item begins with."""
    one = lambda table, column: t(spark, d, table).select(F.col(column).alias("name"))
    out = one("nation", "n_name").union(one("region", "r_name")).union(one("supplier", "s_name")).union(one("customer", "c_name")).union(one("customer", "c_mktsegment"))
    out = out.union(t(spark, d, "part").select(F.explode(F.split("p_name", " "))))
    return out.union(t(spark, d, "benchmark").select(F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), 1, 2), " ")))


@query("names_in_documents", f"""WITH n AS (SELECT DISTINCT lower(name) AS name FROM ({_NAMES}) WHERE name <> ''), d AS (SELECT doc_id, lower(text) AS s FROM documents WHERE text <> '')
SELECT name, count(*) AS texts, min(strpos(s, name) - 1) AS first FROM n JOIN d ON contains(s, name) GROUP BY 1""")
def names_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """P-11, Q-16: how many documents hold a name anywhere, and the earliest place."""
    found = mentions(t(spark, d, "documents"), "doc_id", "text", _names(spark, d), "name")
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"))


@query("names_as_words", f"""WITH n AS (SELECT DISTINCT lower(name) AS name FROM ({_NAMES}) WHERE name <> ''), d AS (SELECT doc_id, lower(text) AS s FROM documents WHERE text <> ''),
c AS MATERIALIZED (SELECT doc_id, name, s FROM n JOIN d ON contains(s, name)) SELECT doc_id, name FROM c WHERE regexp_matches(s, '(^|[^\\pL\\pN])' || regexp_escape(name) || '($|[^\\pL\\pN])')""")
def names_as_words(spark: SparkSession, d: str) -> DataFrame:
    """N-28, J-18: names that stand in a document as whole words."""
    return mentions(t(spark, d, "documents"), "doc_id", "text", _names(spark, d), "name", whole=True).select("doc_id", "name")


@query("texts_by_beginning", """WITH n AS (SELECT DISTINCT lower(regexp_extract(text, '^[A-Za-z]+')) AS name FROM benchmark WHERE regexp_matches(text, '^[A-Za-z]+')),
x AS (SELECT name, doc_id, n_chars FROM n LEFT JOIN documents ON starts_with(lower(text), name)) SELECT name, count(doc_id) AS texts, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars FROM x GROUP BY 1""")
def texts_by_beginning(spark: SparkSession, d: str) -> DataFrame:
    """J-19, A-10: totals of the texts that begin with a name, with names that none begins with."""
    names = t(spark, d, "benchmark").select(F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("name")).where("name <> ''").distinct()
    docs = t(spark, d, "documents")
    hit = beginnings(docs.select(F.struct("doc_id", "n_chars").alias("doc"), "text"), "doc", "text", names, "name")
    by = hit.groupBy("name").agg(F.count(F.lit(1)).alias("texts"), F.sum("doc.n_chars").alias("chars"))
    return names.join(by, "name", "left").select("name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("texts", "chars")))
