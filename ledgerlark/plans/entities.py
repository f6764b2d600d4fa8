"""Entity resolution over documents, and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import entity
from ledgerlark.registry import query
from ledgerlark.session import table as t


def _key(c: str = "text"):  # noqa: ANN202
    return F.md5(F.encode(c, "utf-8"))


@query("exact_dup", """SELECT md5(text) AS k, min(doc_id) AS canonical, count(*) AS copies, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_dup(spark: SparkSession, d: str) -> DataFrame:
    """X-1: blocks of equal keys."""
    x = t(spark, d, "documents").select("doc_id", "source", _key().alias("k"))
    return x.groupBy("k").agg(F.min("doc_id").alias("canonical"), F.count(F.lit(1)).alias("copies"), F.count_distinct("source").alias("sources")).where("copies > 1")


@query("cross_file_dup", """SELECT doc_id, CASE WHEN source <> first_value(source) OVER (PARTITION BY md5(text) ORDER BY doc_id) THEN 1 ELSE 0 END AS is_dup FROM documents""")
def cross_file_dup(spark: SparkSession, d: str) -> DataFrame:
    """X-8, J-12: the same row in a file other than the one that had it first."""
    x = t(spark, d, "documents").select("doc_id", "source", _key().alias("k"))
    return entity.cross_file_duplicates(x, "source", "doc_id", [F.col("k")]).select("doc_id", "is_dup")


@query("canonical_elect", """SELECT k, doc_id AS canonical FROM (SELECT md5(text) AS k, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY (coalesce(toxic, 0) = 0) DESC, (doc_id % 4 > 0) DESC, (source <> 'src0') DESC, doc_id % 4 DESC, lang DESC, doc_id) AS rn FROM documents LEFT JOIN labels USING (doc_id)) WHERE rn = 1""")
def canonical_elect(spark: SparkSession, d: str) -> DataFrame:
    """X-6: which copy of each group is kept."""
    la = t(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("retired"))
    x = t(spark, d, "documents").join(la, "doc_id", "left").select(F.col("doc_id").alias("key"), _key().alias("k"), "retired", F.expr("cast(doc_id % 4 as int)").alias("resource_count"), F.when(F.col("source") == "src0", "data_gov_uk").otherwise(F.col("source")).alias("source_id"), F.col("lang").alias("modified"))
    return entity.elect(x, "k")


@query("components", """WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY md5(text)) AS b FROM documents UNION ALL SELECT doc_id, doc_id // 3 FROM documents WHERE doc_id % 7 = 0) WHERE a <> b),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT doc_id AS node, doc_id AS m FROM documents UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.m) SELECT node, min(m) AS component FROM r GROUP BY 1""")
def components(spark: SparkSession, d: str) -> DataFrame:
    """X-5: groups that any chain of links joins."""
    x = t(spark, d, "documents").select("doc_id", _key().alias("k"))
    first = x.groupBy("k").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = x.join(first, "k").select(F.col("doc_id").alias("a"), "b").union(x.where("doc_id % 7 = 0").select("doc_id", F.expr("doc_id div 3"))).where("a <> b")
    return entity.components(edges, x.select(F.col("doc_id").alias("node")))


@query("components_updated", """WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY md5(text)) AS b FROM documents UNION ALL SELECT doc_id, doc_id // 3 FROM documents WHERE doc_id % 7 = 0) WHERE a <> b AND a % 11 <> 4),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT doc_id AS node, doc_id AS m FROM documents UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.m) SELECT node, min(m) AS component FROM r GROUP BY 1""")
def components_updated(spark: SparkSession, d: str) -> DataFrame:
    """X-4, X-5: components of a part of the links, then more links added and some taken away, without a run over all."""
    x = t(spark, d, "documents").select("doc_id", _key().alias("k"))
    first = x.groupBy("k").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = x.join(first, "k").select(F.col("doc_id").alias("a"), "b").union(x.where("doc_id % 7 = 0").select("doc_id", F.expr("doc_id div 3"))).where("a <> b")
    start = edges.where("a % 3 = 0 or a % 11 = 4")
    labels = entity.components(start, x.select(F.col("doc_id").alias("node")))
    gone = edges.where("a % 11 = 4")
    labels = entity.update_components(labels, start.where("a % 11 <> 4"), removed=gone)
    return entity.update_components(labels, edges.where("a % 11 <> 4"), added=edges.where("a % 3 <> 0 and a % 11 <> 4"))


@query("uuid_pairs", """WITH r AS (SELECT *, regexp_extract('Layer of ' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || ' and ' || m[1:8], '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS u FROM (SELECT *, md5(CAST(o_custkey AS VARCHAR)) AS m FROM orders))
SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM r a JOIN r b ON a.u = b.u AND a.u <> '' AND a.o_orderpriority <> b.o_orderpriority AND a.o_orderstatus = b.o_orderstatus AND a.o_orderkey < b.o_orderkey""")
def uuid_pairs(spark: SparkSession, d: str) -> DataFrame:
    """X-4, J-16: records of different sources that share an identifier and are corroborated."""
    m = F.md5(F.col("o_custkey").cast("string").cast("binary"))
    cut = [F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    title = F.concat(F.lit("Layer of "), F.concat_ws("-", *cut), F.lit(" and "), cut[0])
    o = t(spark, d, "orders").select("o_orderkey", entity.first_uuid(F.lit("rec"), title).alias("u"), "o_orderpriority", "o_orderstatus").where("u is not null")
    a, b = o.alias("a"), o.alias("b")
    j = a.join(b, (F.col("a.u") == F.col("b.u")) & (F.col("a.o_orderstatus") == F.col("b.o_orderstatus")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")))
    return j.where("a.o_orderpriority <> b.o_orderpriority").select(F.col("a.o_orderkey").alias("x"), F.col("b.o_orderkey").alias("y"))


@query("identity_join", """WITH s AS (SELECT s_suppkey, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(n_name || ' City Council'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('city', 'council', '')))), ' ') AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower('The ' || n_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('the', '')))), ' ') AS k FROM nation) SELECT n_nationkey, count(s_suppkey) AS publishers FROM c LEFT JOIN s USING (k) GROUP BY 1""")
def identity_join(spark: SparkSession, d: str) -> DataFrame:
    """J-17, C-19, N-25: bodies to publishers by equal sets of words."""
    from ledgerlark.functions.normalise import identity

    n = t(spark, d, "nation")
    said = lambda x: F.array_join(identity(x), " ").alias("k")
    c = n.select("n_nationkey", said(F.concat(F.lit("The "), "n_name")))
    s = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("m")).join(n, "n_nationkey").select(said(F.concat("n_name", F.lit(" City Council"))), "m")
    return c.join(s, "k", "left").groupBy("n_nationkey").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("publishers"))


@query("greedy_clusters", """WITH RECURSIVE kinds(source_id, suffix) AS (VALUES ('data_gov_uk', ' City Council'), ('own', ''), ('hub', ' Open Data'), ('data_gov_uk', ' Council')),
x AS (SELECT source_id || ':' || n_nationkey || ':' || suffix AS key, 'title ' || n_regionkey AS block, source_id, trim(regexp_replace(lower(n_name || suffix), '[^a-z0-9]+', ' ', 'g')) AS p FROM nation, kinds),
w AS (SELECT *, list_filter(list_distinct(string_split(p, ' ')), lambda v: v NOT IN ('city', 'council', 'open', 'data')) AS w, row_number() OVER (PARTITION BY block ORDER BY key) AS rn FROM x),
n AS (SELECT a.key, list(b.key) AS near FROM w a JOIN w b ON a.block = b.block AND a.key <> b.key AND (a.p = b.p OR ((a.source_id = 'data_gov_uk') <> (b.source_id = 'data_gov_uk')
  AND least(len(a.w), len(b.w)) > 0 AND len(list_intersect(a.w, b.w)) = least(len(a.w), len(b.w)) AND (len(a.w) = len(b.w) OR least(len(a.w), len(b.w)) >= 2))) GROUP BY 1),
o AS (SELECT w.key, block, rn, coalesce(near, []) AS near FROM w LEFT JOIN n ON n.key = w.key),
r AS (SELECT block, rn, [[key]] AS c FROM o WHERE rn = 1 UNION ALL SELECT block, rn, CASE WHEN pos > 0 THEN list_concat(c[1:pos - 1], [list_append(c[pos], key)], c[pos + 1:]) ELSE list_append(c, [key]) END FROM (
  SELECT o.block, o.rn, o.key, r.c, coalesce(list_position(list_transform(r.c, lambda g: len(list_filter(g, lambda m: NOT list_contains(o.near, m))) = 0), true), 0) AS pos FROM r JOIN o ON o.block = r.block AND o.rn = r.rn + 1))
SELECT unnest(g) AS key, g[1] AS cluster FROM (SELECT unnest(c) AS g FROM r JOIN (SELECT block, max(rn) AS last FROM o GROUP BY 1) z ON z.block = r.block AND z.last = r.rn)""")
def greedy_clusters(spark: SparkSession, d: str) -> DataFrame:
    """X-2, X-3, J-15: records of one title in clusters whose members all agree."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name", F.col("n_regionkey").alias("r"))
    kinds = F.array(*(F.struct(F.lit(s).alias("source_id"), F.lit(p).alias("suffix")) for s, p in (("data_gov_uk", " City Council"), ("own", ""), ("hub", " Open Data"), ("data_gov_uk", " Council"))))
    x = n.withColumn("kind", F.explode(kinds)).select(F.concat_ws(":", "kind.source_id", "k", "kind.suffix").alias("key"), F.concat(F.lit("Title "), F.col("r").cast("string")).alias("title"), "kind.source_id", F.concat("n_name", "kind.suffix").alias("publisher"), F.lit(None).cast("string").alias("source_label"))
    return entity.cluster_titles(x)
