"""Predicates, joins and reports of the catalogue that the other modules do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import normalise as N
from ledgerlark.functions import pages as P
from ledgerlark.registry import query
from ledgerlark.session import table as t


@query("retired_records", """SELECT doc_id FROM documents WHERE regexp_matches(CASE WHEN doc_id % 9 = 0 THEN 'Note: this dataset has been withdrawn. ' WHEN doc_id % 9 = 1 THEN 'It Has Been Superseded By v2' ELSE 'current' END, '(?i)(this (record|dataset) (has been|is) (retired|withdrawn|superseded))|(record has been retired)|(has been superseded by)')""")
def retired_records(spark: SparkSession, d: str) -> DataFrame:
    """P-3."""
    said = F.when(F.col("doc_id") % 9 == 0, "Note: this dataset has been withdrawn. ").when(F.col("doc_id") % 9 == 1, "It Has Been Superseded By v2").otherwise("current")
    return t(spark, d, "documents").where(P.retired(said)).select("doc_id")


@query("foreign_boxes", """SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 80 - 50 END AS w, c_custkey % 80 - 45 AS e, c_custkey % 30 + 30 AS n FROM customer) WHERE w IS NOT NULL AND (e < -30 OR w > 15 OR n < 40)""")
def foreign_boxes(spark: SparkSession, d: str) -> DataFrame:
    """P-7: boxes that lie wholly elsewhere."""
    k = F.col("c_custkey")
    x = t(spark, d, "customer").select("c_custkey", F.when(k % 5 > 0, k % 80 - 50).alias("w"), (k % 80 - 45).alias("e"), (k % 30 + 30).alias("n"))
    return x.where("w is not null and (e < -30 or w > 15 or n < 40)").select("c_custkey")


@query("quality_gate_children", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE length(o_orderpriority) >= 6) GROUP BY 1, 2""")
def quality_gate_children(spark: SparkSession, d: str) -> DataFrame:
    """P-13: a record that fails the gate takes its children with it."""
    good = t(spark, d, "orders").where("length(o_orderpriority) >= 6").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, d, "lineitem").join(good, "l_orderkey", "left_semi").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("short_and_prefixed", """SELECT p_partkey, p_name LIKE 'part 1%' AS prefixed, length(trim(p_name)) <= 6 AS short FROM part WHERE p_name LIKE 'part 1%' OR length(trim(p_name)) <= 6 OR lower(p_name) LIKE '%ni 0%'""")
def short_and_prefixed(spark: SparkSession, d: str) -> DataFrame:
    """P-12."""
    p = t(spark, d, "part").select("p_partkey", F.startswith("p_name", F.lit("part 1")).alias("prefixed"), (F.length(F.trim("p_name")) <= 6).alias("short"), F.col("p_name").ilike("%ni 0%").alias("ni"))
    return p.where("prefixed or short or ni").select("p_partkey", "prefixed", "short")


@query("successor_chain", """WITH m(old, new) AS (VALUES (1, 2), (2, 3), (7, 8)) SELECT n_nationkey, coalesce(b.new, a.new, n_nationkey) AS successor FROM nation LEFT JOIN m a ON a.old = n_nationkey LEFT JOIN m b ON b.old = a.new""")
def successor_chain(spark: SparkSession, d: str) -> DataFrame:
    """J-29: codes to their successors, two steps far; the mapping is a fixed table."""
    m = F.create_map(*(F.lit(x) for pair in ((1, 2), (2, 3), (7, 8)) for x in pair))
    one = F.try_element_at(m, F.col("n_nationkey"))
    return t(spark, d, "nation").select("n_nationkey", F.coalesce(F.try_element_at(m, one), one, F.col("n_nationkey")).alias("successor"))


@query("county_of_district", """SELECT substring(CAST(c_custkey + 1000000 AS VARCHAR), 1, 5) AS county, count(*) AS n, min(c_acctbal) AS least FROM customer GROUP BY 1""")
def county_of_district(spark: SparkSession, d: str) -> DataFrame:
    """J-30: the county is a prefix of the district's code."""
    return t(spark, d, "customer").groupBy(F.substring((F.col("c_custkey") + 1_000_000).cast("string"), 1, 5).alias("county")).agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("least"))


@query("receipts", """SELECT l_orderkey, l_linenumber, l_partkey, p_name AS title FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def receipts(spark: SparkSession, d: str) -> DataFrame:
    """J-31: rows with the title of the file they came from."""
    p = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, "l_partkey", "left")


@query("mentions_place", """SELECT o_orderkey, contains(lower(c_name || ' ' || n_name), lower(r_name)) OR contains(lower(n_name), left(lower(r_name), 2)) AS mentioned FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def mentions_place(spark: SparkSession, d: str) -> DataFrame:
    """Q-16."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey").join(n, "c_nationkey")
    said = F.contains(F.lower(F.concat_ws(" ", "c_name", "n_name")), F.lower("r_name")) | F.contains(F.lower("n_name"), F.substring(F.lower("r_name"), 1, 2))
    return t(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").select("o_orderkey", said.alias("mentioned"))


@query("covers_and_hydrates", """SELECT d.doc_id, left(d.text, 280) AS description, d.n_chars, l.quality, coalesce(l.quality, 0) = 1 AS covers FROM documents d LEFT JOIN labels l USING (doc_id)""")
def covers_and_hydrates(spark: SparkSession, d: str) -> DataFrame:
    """Q-17, J-2: the shown columns of records."""
    la = t(spark, d, "labels").select("doc_id", "quality")
    x = t(spark, d, "documents").join(la, "doc_id", "left")
    return x.select("doc_id", F.substring("text", 1, 280).alias("description"), "n_chars", "quality", (F.coalesce("quality", F.lit(0)) == 1).alias("covers"))


@query("source_quality_report", """SELECT source, count(*) AS datasets, count(*) FILTER (coalesce(quality, 0) = 0) AS unlabelled, round(100.0 * count(*) FILTER (n_chars < 800) / count(*), 2) AS short_pct, max(n_chars) AS longest, round(avg(length(text)), 2) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def source_quality_report(spark: SparkSession, d: str) -> DataFrame:
    """A-5."""
    x = t(spark, d, "documents").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = F.count(F.lit(1))
    return x.groupBy("source").agg(n.alias("datasets"), F.count_if(F.coalesce("quality", F.lit(0)) == 0).alias("unlabelled"), F.round(100.0 * F.count_if(F.col("n_chars") < 800) / n, 2).alias("short_pct"), F.max("n_chars").alias("longest"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"))


@query("resources_first_wins", """SELECT l_orderkey, l_partkey, min(l_linenumber) AS at FROM lineitem GROUP BY 1, 2""")
def resources_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """N-22: of children with one address the first stays."""
    return t(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("at"))


@query("slug_and_alias", """SELECT n_nationkey, split_part(lower('data-' || replace(n_name, ' ', '') || '.opendata.gov.example'), '.', 1) AS label, CASE WHEN length(n_name) > 2 THEN lower(n_name) END AS place FROM nation""")
def slug_and_alias(spark: SparkSession, d: str) -> DataFrame:
    """N-48, Q-14: a host's telling label and a place's key."""
    host = F.lower(F.concat(F.lit("data-"), F.replace("n_name", F.lit(" "), F.lit("")), F.lit(".opendata.gov.example")))
    key = N.name_key(F.col("n_name"))
    return t(spark, d, "nation").select("n_nationkey", F.concat(F.lit("data-"), P.slug_of_host(host)).alias("label"), F.when(F.length("n_name") > 2, F.when(P.gazetteer_key(F.col("n_name")) == key, F.lower("n_name"))).alias("place"))


@query("repeated_sequences", """SELECT p_partkey, p_brand AS once FROM part""")
def repeated_sequences(spark: SparkSession, d: str) -> DataFrame:
    """N-12: a text said two or three times over."""
    x = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_brand", "p_brand")).otherwise(F.concat_ws(" ", "p_brand", "p_brand", "p_brand"))
    return t(spark, d, "part").select("p_partkey", N.collapse_repeat(x).alias("once"))


@query("gazetteer_points", """SELECT n_nationkey, n_nationkey * 3.0 - 20 AS lon, n_nationkey * 1.0 + 40 AS lat FROM nation WHERE NOT starts_with(lower(n_name), 'of ')""")
def gazetteer_points(spark: SparkSession, d: str) -> DataFrame:
    """Q-14, D-19."""
    k = P.gazetteer_key(F.col("n_name"))
    return t(spark, d, "nation").where(k.isNotNull()).select("n_nationkey", (F.col("n_nationkey") * 3.0 - 20).alias("lon"), (F.col("n_nationkey") * 1.0 + 40).alias("lat"))


_CHECKED = "(SELECT l_orderkey, l_linenumber, 'http://p/' || l_partkey AS url FROM lineitem) r JOIN (SELECT 'http://p/' || p_partkey AS url, CASE WHEN p_size > 40 THEN 'dead' ELSE 'data' END AS verdict FROM part WHERE p_partkey % 3 <> 0) k USING (url)"


def _resources(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("http://p/"), F.col("l_partkey").cast("string")).alias("url"))


def _checks(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("http://p/"), F.col("p_partkey").cast("string")).alias("url"), F.when(F.col("p_size") > 40, "dead").otherwise("data").alias("verdict"))


@query("resources_checked", f"SELECT l_orderkey, l_linenumber, verdict FROM {_CHECKED}")
def resources_checked(spark: SparkSession, d: str) -> DataFrame:
    """J-1: resources with what the check of their address said."""
    return _resources(spark, d).join(_checks(spark, d), "url").select("l_orderkey", "l_linenumber", "verdict")


@query("dead_links_of_datasets", f"SELECT o_orderpriority AS publisher, count(*) AS dead, count(DISTINCT o_orderkey) AS datasets FROM {_CHECKED} JOIN orders ON o_orderkey = l_orderkey WHERE verdict = 'dead' GROUP BY 1")
def dead_links_of_datasets(spark: SparkSession, d: str) -> DataFrame:
    """J-9: resources, checks and datasets; dead links are counted by dataset before they are by publisher."""
    by = _resources(spark, d).join(_checks(spark, d).where("verdict = 'dead'"), "url").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    x = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("publisher")).join(by, "o_orderkey")
    return x.groupBy("publisher").agg(F.sum("n").alias("dead"), F.count(F.lit(1)).alias("datasets"))
