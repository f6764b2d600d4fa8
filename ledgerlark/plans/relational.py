"""Scans, predicates, joins, set operations and reshaping over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.registry import query
from ledgerlark.session import table as t


@query("scan_project_filter", """SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 30""")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1995-01-01' and l_shipdate < TIMESTAMP_NTZ '1996-01-01' and l_quantity > 30").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("join_star", """SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def join_star(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    # Lines are summed by order first: the join carries a row for each order.
    by_order = li.groupBy("l_orderkey").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("lines"))
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = by_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = j.groupBy("c_nationkey").agg(F.sum("v").alias("v"), F.sum("lines").alias("lines"))
    return j.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.sum("lines").alias("lines"), F.round(F.sum("v"), 2).alias("revenue"))


@query("anti_findable", """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def anti_findable(spark: SparkSession, d: str) -> DataFrame:
    """P-1, J-7: neither in one set nor in another."""
    c = t(spark, d, "customer")
    retired = c.where("c_acctbal < 0").select("c_custkey")
    ordered = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(ordered, "c_custkey", "left_anti").join(retired, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("semi_elsewhere", """SELECT DISTINCT a.l_suppkey, a.l_partkey FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey <> a.l_suppkey)""")
def semi_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    """J-10: also held by another; one aggregate in place of a self join."""
    p = t(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    more = p.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return p.join(more, "l_partkey", "left_semi").select("l_suppkey", "l_partkey")


@query("left_stale", """SELECT o_orderkey, max(l_shipdate) AS last_ship FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey HAVING max(l_shipdate) IS NULL OR max(l_shipdate) < TIMESTAMP '1994-01-01'""")
def left_stale(spark: SparkSession, d: str) -> DataFrame:
    """J-4, T-3: never checked, or last checked before a date."""
    last = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    o = t(spark, d, "orders").select("o_orderkey")
    return o.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").where("last_ship is null or last_ship < TIMESTAMP_NTZ '1994-01-01'").select("o_orderkey", "last_ship")


@query("first_row_per_key", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def first_row_per_key(spark: SparkSession, d: str) -> DataFrame:
    """J-5, W-4: the first row of a key by an explicit ordinal, as one aggregate."""
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("f")
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(first).select("l_orderkey", "f.l_linenumber", "f.l_partkey", "f.l_quantity")


@query("theta_prefix", """SELECT p_partkey, p_name, v.word FROM part JOIN (VALUES ('a'), ('b'), ('part'), ('s')) v(word) ON starts_with(lower(p_name), v.word)""")
def theta_prefix(spark: SparkSession, d: str) -> DataFrame:
    """J-19: names by prefix; a vocabulary of fixed size is a chain of tests, not a join."""
    p = t(spark, d, "part").select("p_partkey", "p_name")
    words = F.array(*(F.lit(w) for w in ("a", "b", "part", "s")))
    return p.withColumn("word", F.explode(F.filter(words, lambda w: F.startswith(F.lower("p_name"), w))))


@query("nlj_contains", """SELECT p_partkey, v.word FROM part JOIN (VALUES ('1'), ('99'), ('e'), ('steel')) v(word) ON contains(lower(p_name), v.word)""")
def nlj_contains(spark: SparkSession, d: str) -> DataFrame:
    """J-18: names that hold a word of a small vocabulary anywhere."""
    words = F.array(*(F.lit(w) for w in ("1", "99", "e", "steel")))
    return t(spark, d, "part").select("p_partkey", F.explode(F.filter(words, lambda w: F.contains(F.lower("p_name"), w))).alias("word"))


@query("range_bbox", """WITH box AS (SELECT n_nationkey AS k, n_nationkey AS w, n_nationkey + 10 AS e, (n_nationkey % 5) / 100.0 AS s, (n_nationkey % 5) / 100.0 + 0.03 AS n FROM nation)
SELECT k, count(*) AS points FROM lineitem JOIN box ON l_quantity BETWEEN w AND e AND l_discount BETWEEN s AND n GROUP BY 1""")
def range_bbox(spark: SparkSession, d: str) -> DataFrame:
    """J-3, P-6: points inside boxes, bounds included; cells of the box's width make it an equi join."""
    box = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").alias("w"), (F.col("n_nationkey") + 10).alias("e"), (F.col("n_nationkey") % 5 / 100.0).alias("s"), (F.col("n_nationkey") % 5 / 100.0 + 0.03).alias("n"))
    cells = box.withColumn("cell", F.explode(F.expr("sequence(cast(w div 10 as int), cast(e div 10 as int))")))
    points = t(spark, d, "lineitem").groupBy("l_quantity", "l_discount").count().withColumn("cell", F.expr("cast(floor(l_quantity / 10) as int)"))
    hit = points.join(cells, "cell").where("l_quantity between w and e and l_discount between s and n")
    return hit.groupBy("k").agg(F.sum("count").alias("points"))


@query("first_with_columns", """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn = 1""")
def first_with_columns(spark: SparkSession, d: str) -> DataFrame:
    """J-33: the first related row that has what is asked."""
    f = t(spark, d, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.min(F.struct("o_orderkey", "o_orderpriority")).alias("f"))
    return f.select("o_custkey", "f.o_orderkey", "f.o_orderpriority")


@query("latest_per_source", """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS latest FROM orders GROUP BY 1""")
def latest_per_source(spark: SparkSession, d: str) -> DataFrame:
    """J-11, W-7: the latest run of each source."""
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("latest"))


@query("coalesce_lookup_chain", """SELECT c_custkey, coalesce(s.s_name, n.n_name) AS assigned, CASE WHEN s.s_name IS NOT NULL THEN 'supplier' WHEN n.n_name IS NOT NULL THEN 'nation' END AS method
FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey LEFT JOIN nation n ON n.n_nationkey = c_nationkey""")
def coalesce_lookup_chain(spark: SparkSession, d: str) -> DataFrame:
    """J-26, J-28: the first lookup that answers, and which it was."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j = t(spark, d, "customer").select("c_custkey", "c_nationkey").join(s, "c_custkey", "left").join(n, "c_nationkey", "left")
    return j.select("c_custkey", F.coalesce("s_name", "n_name").alias("assigned"), F.when(F.col("s_name").isNotNull(), "supplier").when(F.col("n_name").isNotNull(), "nation").alias("method"))


@query("full_anti_check", """SELECT 'no_customer' AS side, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT 'no_supplier', n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def full_anti_check(spark: SparkSession, d: str) -> DataFrame:
    """J-32: what either side lacks."""
    n = t(spark, d, "nation")
    miss = lambda name, other, key: n.join(t(spark, d, other).select(F.col(key).alias("n_nationkey")), "n_nationkey", "left_anti").select(F.lit(name).alias("side"), "n_name")
    return miss("no_customer", "customer", "c_nationkey").unionByName(miss("no_supplier", "supplier", "s_nationkey"))


@query("setop_union", """SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
def setop_union(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(spark, d, "supplier").select("s_nationkey")).distinct()


@query("setop_union_all", """SELECT 'c' AS kind, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY 2""")
def setop_union_all(spark: SparkSession, d: str) -> DataFrame:
    one = lambda kind, name, key: t(spark, d, name).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return one("c", "customer", "c_nationkey").unionByName(one("s", "supplier", "s_nationkey"))


@query("setop_intersect", """SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'""")
def setop_intersect(spark: SparkSession, d: str) -> DataFrame:
    flags = t(spark, d, "lineitem").where("l_returnflag in ('R', 'A')").groupBy(F.col("l_partkey").alias("k")).agg(F.count_distinct("l_returnflag").alias("n"))
    return flags.where("n = 2").select("k")


@query("setop_except", """SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem""")
def setop_except(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("k")).join(t(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), "k", "left_anti").distinct()


@query("set_equality", """SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS only_left, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS only_right""")
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    """U-5: what either of two key sets has alone."""
    a = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    s = a.unionByName(b).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return s.agg(F.coalesce(F.sum(F.when(F.expr("a = 1 and b = 0"), 1)), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.when(F.expr("a = 0 and b = 1"), 1)), F.lit(0)).alias("only_right"))


@query("pivot_panel", """SELECT CAST(year(o_orderdate) AS BIGINT) AS y, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS p FROM orders GROUP BY 1""")
def pivot_panel(spark: SparkSession, d: str) -> DataFrame:
    """R-1: values are named, so that no extra pass looks for them."""
    p = t(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    return p.select("y", *(F.round(c, 2).alias(c.lower()) for c in ("F", "O", "P")))


@query("unpivot_panel", """SELECT l_orderkey, l_linenumber, measure, value FROM (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (value FOR measure IN (quantity, discount, tax))""")
def unpivot_panel(spark: SparkSession, d: str) -> DataFrame:
    """R-2."""
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return x.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "measure", "value")


@query("tags_flatten", """SELECT DISTINCT tag, p_partkey FROM (SELECT p_partkey, unnest(string_split(regexp_replace(lower(trim(p_type || ' ' || p_brand)), '\\s+', ' ', 'g'), ' ')) AS tag FROM part) WHERE length(tag) > 1""")
def tags_flatten(spark: SparkSession, d: str) -> DataFrame:
    """R-3: one row for each tag of a record."""
    words = F.split(F.regexp_replace(F.lower(F.trim(F.concat_ws(" ", "p_type", "p_brand"))), r"\s+", " "), " ")
    return t(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(words)).alias("tag")).where("length(tag) > 1").select("tag", "p_partkey")


@query("page_rows", """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 100""")
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """O-4: the second page of a publisher's listing; the priority stands for the publisher."""
    return t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(100)


@query("related_rows", """SELECT k, o_orderkey FROM (SELECT a.o_orderkey AS k, b.o_orderkey, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey) AS rn
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey) WHERE rn <= 6""")
def related_rows(spark: SparkSession, d: str) -> DataFrame:
    """O-5: the six latest others of the same publisher."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # Seven of each publisher are enough to leave one out.
    top = o.withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))).where("rn <= 7").drop("rn")
    a = o.select(F.col("o_orderkey").alias("k"), "o_custkey")
    j = a.join(top, "o_custkey").where("k <> o_orderkey")
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("o_orderdate"), "o_orderkey"))).where("rn <= 6").select("k", "o_orderkey")


@query("sitemap_chunks", """SELECT CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 250 AS BIGINT) AS page, c_custkey FROM customer""")
def sitemap_chunks(spark: SparkSession, d: str) -> DataFrame:
    """O-6: pages of fixed size in key order; ranks come from counts by key range, so no task sorts all keys."""
    from ledgerlark.operators.ranking import global_rank

    return global_rank(t(spark, d, "customer").select("c_custkey"), "c_custkey", "rank").select(F.floor(F.col("rank") / 250).cast("long").alias("page"), "c_custkey")


@query("letter_groups", """SELECT CASE WHEN regexp_matches(upper(trim(c_mktsegment))[1], '^[A-Z]$') THEN upper(trim(c_mktsegment))[1] ELSE '#' END AS letter, count(*) AS n, count(DISTINCT c_mktsegment) AS names FROM customer GROUP BY 1""")
def letter_groups(spark: SparkSession, d: str) -> DataFrame:
    """O-8."""
    from ledgerlark.functions.normalise import initial

    return t(spark, d, "customer").groupBy(initial(F.col("c_mktsegment")).alias("letter")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("names"))


@query("case_filter_or_and", """SELECT p_partkey FROM part WHERE lower(p_brand) IN ('brand#11', 'brand#12', 'brand#22') AND p_size BETWEEN 5 AND 30""")
def case_filter_or_and(spark: SparkSession, d: str) -> DataFrame:
    """P-4, P-5: any of a list within a field, all fields together."""
    wanted = [w.strip().lower() for w in "Brand#11, Brand#12,,Brand#22".split(",") if w.strip()]
    return t(spark, d, "part").where(F.lower("p_brand").isin(wanted) & F.col("p_size").between(5, 30)).select("p_partkey")


@query("like_nets", """SELECT net, count(*) AS n FROM (SELECT p_name, 'ends_5' AS net FROM part WHERE lower(p_name) LIKE '%5' UNION ALL SELECT p_name, 'has_1' FROM part WHERE lower(p_name) LIKE '%1%') WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 3) GROUP BY 1""")
def like_nets(spark: SparkSession, d: str) -> DataFrame:
    """P-10, P-11: name nets less exact exclusions."""
    p = t(spark, d, "part").select("p_name", "p_size")
    nets = F.array(F.when(F.col("p_name").ilike("%5"), "ends_5"), F.when(F.col("p_name").ilike("%1%"), "has_1"))
    out = p.where("p_size < 3").select("p_name")
    return p.join(out, "p_name", "left_anti").select(F.explode(F.filter(nets, lambda n: n.isNotNull())).alias("net")).groupBy("net").agg(F.count(F.lit(1)).alias("n"))
