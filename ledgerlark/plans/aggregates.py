"""Counts, roll-ups, quality reports, quantiles and panel statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.registry import query
from ledgerlark.session import table as t


def rows() -> Column:
    return F.count(F.lit(1))


@query("stats_counts", """SELECT count(*) AS rows, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders""")
def stats_counts(spark: SparkSession, d: str) -> DataFrame:
    """A-1."""
    return t(spark, d, "orders").agg(rows().alias("rows"), F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query("availability_rollup", """SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'data' WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'api'
WHEN count(*) FILTER (event_type = 'view') > 0 THEN 'webpage' WHEN count(*) = count(value) THEN 'dead' END AS availability FROM events GROUP BY 1""")
def availability_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A-2: the best verdict wins; dead only if everything was seen."""
    any_of = lambda x: F.count_if(F.col("event_type") == x) > 0
    verdict = F.when(any_of("purchase"), "data").when(any_of("click"), "api").when(any_of("view"), "webpage").when(rows() == F.count("value"), "dead")
    return t(spark, d, "events").groupBy("user_id").agg(verdict.alias("availability"))


@query("agg_having_ratio", """SELECT l_suppkey, count(*) AS n, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS share FROM lineitem GROUP BY 1 HAVING count(*) >= 100 AND count(*) FILTER (l_returnflag = 'R') > 0""")
def agg_having_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A-6, A-7."""
    r = F.count_if(F.col("l_returnflag") == "R")
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(rows().alias("n"), F.round(r / rows(), 6).alias("share")).where("n >= 100 and share > 0")


@query("agg_distinct", """SELECT p_type, count(DISTINCT p_brand) AS brands, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2""")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    """A-4, A-9."""
    return t(spark, d, "part").groupBy("p_type").agg(F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_size").alias("sizes")).where("brands >= 2")


@query("agg_rollup_quality", """SELECT source, count(*) AS n, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (lang <> 'en') AS foreign_lang, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY ROLLUP (source)""")
def agg_rollup_quality(spark: SparkSession, d: str) -> DataFrame:
    """A-5: by source, with the total as the null row."""
    x = t(spark, d, "documents").select("source", "n_chars", "lang")
    return x.rollup("source").agg(rows().alias("n"), F.count_if(F.col("n_chars") < 500).alias("short"), F.count_if(F.col("lang") != "en").alias("foreign_lang"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("agg_modal", """SELECT c_nationkey, c_mktsegment AS modal, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS rn FROM customer GROUP BY 1, 2) WHERE rn = 1""")
def agg_modal(spark: SparkSession, d: str) -> DataFrame:
    """A-3: the most common form; the first by name on a tie."""
    n = t(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(rows().alias("n"))
    return n.groupBy("c_nationkey").agg(F.min(F.struct((-F.col("n")).alias("m"), "c_mktsegment")).alias("b")).select("c_nationkey", F.col("b.c_mktsegment").alias("modal"), (-F.col("b.m")).alias("n"))


@query("agg_age_buckets", """SELECT CASE WHEN a IS NULL THEN 'unknown' WHEN a <= 90 THEN '0-90' WHEN a <= 365 THEN '91-365' WHEN a <= 730 THEN '366-730' WHEN a <= 1825 THEN '731-1825' ELSE 'older' END AS bucket, count(*) AS n
FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS a FROM orders) GROUP BY 1""")
def agg_age_buckets(spark: SparkSession, d: str) -> DataFrame:
    a = F.date_diff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    bucket = F.when(a.isNull(), "unknown").when(a <= 90, "0-90").when(a <= 365, "91-365").when(a <= 730, "366-730").when(a <= 1825, "731-1825").otherwise("older")
    return t(spark, d, "orders").groupBy(bucket.alias("bucket")).agg(rows().alias("n"))


@query("top_formats", """SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 15""")
def top_formats(spark: SparkSession, d: str) -> DataFrame:
    """A-5: the report's top list."""
    return t(spark, d, "part").groupBy("p_brand").agg(rows().alias("n")).orderBy(F.desc("n"), "p_brand").limit(15)


@query("document_only", """SELECT source, count(*) AS n, count(*) FILTER (lang IN ('de', 'fr')) AS docs FROM documents GROUP BY 1 HAVING count(*) >= 30 AND count(*) FILTER (lang IN ('de', 'fr')) >= 0.2 * count(*)""")
def document_only(spark: SparkSession, d: str) -> DataFrame:
    """A-8: groups whose entries nearly all lack what is asked."""
    return t(spark, d, "documents").groupBy("source").agg(rows().alias("n"), F.count_if(F.col("lang").isin("de", "fr")).alias("docs")).where("n >= 30 and docs >= 0.2 * n")


@query("host_rollup", """SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS n, min(strlen(html)) AS least, max(strlen(html)) AS most FROM pages GROUP BY 1""")
def host_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A-11, N-47."""
    from ledgerlark.functions.normalise import host

    return t(spark, d, "pages").groupBy(host(F.col("url")).alias("host")).agg(rows().alias("n"), F.min(F.octet_length("html")).cast("long").alias("least"), F.max(F.octet_length("html")).cast("long").alias("most"))


@query("coverage_matrix", """SELECT n_name, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery, count(*) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A-12."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("machinery"), rows().alias("total"))
    return c.join(n, "c_nationkey").select("n_name", "building", "machinery", "total")


@query("year_histogram_filled", """WITH h AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
SELECT r.y, coalesce(h.n, 0) AS n FROM (SELECT CAST(unnest(range(1990, 2000)) AS BIGINT) AS y) r LEFT JOIN h ON h.y = r.y""")
def year_histogram_filled(spark: SparkSession, d: str) -> DataFrame:
    """A-13: every year has a row."""
    h = t(spark, d, "orders").where("o_totalprice > 300000").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(rows().alias("n"))
    return spark.range(1990, 2000).withColumnRenamed("id", "y").join(h, "y", "left").select("y", F.coalesce("n", F.lit(0)).alias("n"))


@query("grouped_frequency", """SELECT replace(lower(o_orderpriority), ' ', '') AS freq, count(*) AS n FROM orders GROUP BY 1""")
def grouped_frequency(spark: SparkSession, d: str) -> DataFrame:
    """A-14."""
    return t(spark, d, "orders").groupBy(F.replace(F.lower("o_orderpriority"), F.lit(" "), F.lit("")).alias("freq")).agg(rows().alias("n"))


@query("grid_density", """SELECT x, y, count(*) AS n FROM (SELECT unnest(range(CAST(w AS BIGINT), CAST(e AS BIGINT) + 1)) AS x, s, n2 FROM (SELECT c_custkey % 20 AS w, c_custkey % 20 + c_custkey % 4 AS e, c_custkey % 7 AS s, c_custkey % 7 + c_custkey % 3 AS n2 FROM customer)), LATERAL (SELECT unnest(range(CAST(s AS BIGINT), CAST(n2 AS BIGINT) + 1)) AS y) GROUP BY 1, 2""")
def grid_density(spark: SparkSession, d: str) -> DataFrame:
    """A-15: how many boxes cover each cell; boxes are counted by shape before they are spread."""
    box = t(spark, d, "customer").select(F.expr("c_custkey % 20").alias("w"), F.expr("c_custkey % 20 + c_custkey % 4").alias("e"), F.expr("c_custkey % 7").alias("s"), F.expr("c_custkey % 7 + c_custkey % 3").alias("n2"))
    box = box.groupBy("w", "e", "s", "n2").agg(rows().alias("m"))
    return box.select(F.explode(F.expr("sequence(w, e)")).alias("x"), "s", "n2", "m").select("x", F.explode(F.expr("sequence(s, n2)")).alias("y"), "m").groupBy("x", "y").agg(F.sum("m").alias("n"))


@query("upper_median", """SELECT l_suppkey, l_extendedprice AS median FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE rn = n // 2 + 1""")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    """A-16: the value at offset n / 2 in order, from counts of equal values."""
    from ledgerlark.operators.statistics import upper_median as median

    return median(t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "median")


@query("quantiles", """SELECT p_brand, round(quantile_cont(p_retailprice, 0.1), 4) AS p10, round(quantile_cont(p_retailprice, 0.25), 4) AS p25, round(quantile_cont(p_retailprice, 0.5), 4) AS p50, round(quantile_cont(p_retailprice, 0.75), 4) AS p75, round(quantile_cont(p_retailprice, 0.9), 4) AS p90 FROM part GROUP BY 1""")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    """A-29: linear interpolation."""
    q = F.percentile("p_retailprice", [0.1, 0.25, 0.5, 0.75, 0.9])
    return t(spark, d, "part").groupBy("p_brand").agg(q.alias("q")).select("p_brand", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))))


@query("weighted_mean", """SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY 1""")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    """A-32."""
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("mean"))


@query("sum_min_count", """SELECT user_id, sum(value) FILTER (event_type = 'purchase') IS NULL AS none, round(sum(value) FILTER (event_type = 'purchase'), 4) AS total FROM events GROUP BY 1""")
def sum_min_count(spark: SparkSession, d: str) -> DataFrame:
    """A-30: the sum of nothing is null."""
    s = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")))
    return t(spark, d, "events").groupBy("user_id").agg(s.isNull().alias("none"), F.round(s, 4).alias("total"))


@query("scale_outliers", """WITH f AS (SELECT l_suppkey, l_partkey % 10 AS file, CASE WHEN l_partkey % 10 = 7 THEN 200 ELSE 1 END * l_extendedprice AS v FROM lineitem),
m AS (SELECT l_suppkey, file, list_sort(list(v))[count(*) // 2 + 1] AS file_median FROM f GROUP BY 1, 2 HAVING count(*) >= 20),
s AS (SELECT l_suppkey, list_sort(list(file_median))[count(*) // 2 + 1] AS series_median FROM m GROUP BY 1 HAVING count(*) >= 3)
SELECT m.l_suppkey, m.file, m.file_median, s.series_median FROM m JOIN s ON s.l_suppkey = m.l_suppkey WHERE series_median > 0 AND file_median >= 100 * series_median""")
def scale_outliers(spark: SparkSession, d: str) -> DataFrame:
    """A-17: files of twenty rows or more whose median is a hundred times their series', as of sums in the wrong unit."""
    from ledgerlark.operators.statistics import upper_median as median

    file = F.col("l_partkey") % 10
    f = t(spark, d, "lineitem").select("l_suppkey", file.alias("file"), (F.when(file == 7, 200).otherwise(1) * F.col("l_extendedprice")).alias("v"))
    m = median(f, ["l_suppkey", "file"], "v", "file_median", least=20)
    s = median(m, ["l_suppkey"], "file_median", "series_median", least=3)
    return m.join(s, "l_suppkey").where("series_median > 0 and file_median >= 100 * series_median").select("l_suppkey", "file", "file_median", "series_median")


@query("reconciliation", """SELECT count(*) AS raw, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_returnflag <> 'R' AND l_discount = 0) AS blank, count(*) FILTER (l_returnflag <> 'R' AND l_discount > 0) AS clean,
round(sum(l_extendedprice) FILTER (l_returnflag <> 'R' AND l_discount > 0), 2) AS gbp, count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') AS out_of_window FROM lineitem""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """A-18: every row is in one class."""
    kept, clean = F.col("l_returnflag") != "R", (F.col("l_returnflag") != "R") & (F.col("l_discount") > 0)
    return t(spark, d, "lineitem").agg(rows().alias("raw"), F.count_if(~kept).alias("returned"), F.count_if(kept & (F.col("l_discount") == 0)).alias("blank"), F.count_if(clean).alias("clean"), F.round(F.sum(F.when(clean, F.col("l_extendedprice"))), 2).alias("gbp"), F.count_if(F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ '1998-01-01'")).alias("out_of_window"))


@query("monthly_totals", """SELECT strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS n, round(sum(o_totalprice), 2) AS gbp FROM orders GROUP BY 1""")
def monthly_totals(spark: SparkSession, d: str) -> DataFrame:
    """A-19."""
    return t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(rows().alias("n"), F.round(F.sum("o_totalprice"), 2).alias("gbp"))


@query("two_stage_rollup", """SELECT l_suppkey, count(*) AS publishers, sum(txns) AS txns, round(sum(gbp), 2) AS gbp FROM (SELECT l_suppkey, o_custkey, count(*) AS txns, sum(l_extendedprice) AS gbp FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1""")
def two_stage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A-20, D-17."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    sp = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice").join(o, "l_orderkey").groupBy("l_suppkey", "o_custkey").agg(rows().alias("txns"), F.sum("l_extendedprice").alias("gbp"))
    return sp.groupBy("l_suppkey").agg(rows().alias("publishers"), F.sum("txns").alias("txns"), F.round(F.sum("gbp"), 2).alias("gbp"))


@query("cross_body_hist", """WITH p AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT b AS at_least, count(*) FILTER (n >= b) AS parts FROM p, (VALUES (2), (3), (5), (10), (20)) v(b) GROUP BY 1""")
def cross_body_hist(spark: SparkSession, d: str) -> DataFrame:
    """A-21: in how many bodies each name is found."""
    n = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"))
    bounds = F.array(*map(F.lit, (2, 3, 5, 10, 20)))
    return n.groupBy("n").agg(rows().alias("m")).select(F.explode(bounds).alias("at_least"), "n", "m").groupBy("at_least").agg(F.sum(F.when(F.col("n") >= F.col("at_least"), F.col("m")).otherwise(0)).alias("parts"))


@query("flows_matrix", """WITH f AS (SELECT s_nationkey AS a, c_nationkey AS b, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT a, b, round(v, 2) AS gbp, round(v / sum(v) OVER (PARTITION BY a), 6) AS share, a = b AS self FROM f""")
def flows_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A-22: flows between bodies with each row's shares."""
    li = t(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("b"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    f = li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").groupBy("a", "b").agg(F.sum("v").alias("v"))
    return f.select("a", "b", F.round("v", 2).alias("gbp"), F.round(F.col("v") / F.sum("v").over(Window.partitionBy("a")), 6).alias("share"), (F.col("a") == F.col("b")).alias("self"))


@query("recurring_amounts", """WITH m AS (SELECT l_suppkey, o_custkey % 20 AS body, round(l_quantity) AS amount, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 10 GROUP BY 1, 2, 3 HAVING count(DISTINCT strftime(o_orderdate, '%Y-%m')) >= 2)
SELECT l_suppkey, amount, count(*) AS bodies, string_agg(CAST(body AS VARCHAR), ',' ORDER BY body) AS who FROM m GROUP BY 1, 2 HAVING count(*) >= 2""")
def recurring_amounts(spark: SparkSession, d: str) -> DataFrame:
    """A-23: an amount that comes back in several months at several bodies."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 20).alias("body"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"))
    m = t(spark, d, "lineitem").where("l_quantity > 10").select("l_orderkey", "l_suppkey", F.round("l_quantity").alias("amount")).join(o, "l_orderkey")
    m = m.groupBy("l_suppkey", "body", "amount").agg(F.count_distinct("ym").alias("months")).where("months >= 2")
    who = F.array_join(F.transform(F.array_sort(F.collect_list("body")), lambda b: b.cast("string")), ",")
    return m.groupBy("l_suppkey", "amount").agg(rows().alias("bodies"), who.alias("who")).where("bodies >= 2")


@query("gross_net_legs", """SELECT c_nationkey, round(sum(c_acctbal) FILTER (c_acctbal > 0), 2) AS gross, round(sum(c_acctbal) FILTER (c_acctbal < 0), 2) AS credits, round(sum(c_acctbal), 2) AS net, count(*) FILTER (c_acctbal < 0) AS n_negative, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer GROUP BY 1""")
def gross_net_legs(spark: SparkSession, d: str) -> DataFrame:
    """A-24."""
    v = F.col("c_acctbal")
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum(F.when(v > 0, v)), 2).alias("gross"), F.round(F.sum(F.when(v < 0, v)), 2).alias("credits"), F.round(F.sum(v), 2).alias("net"), F.count_if(v < 0).alias("n_negative"), F.min(v).alias("least"), F.max(v).alias("most"))


@query("modal_fingerprint", """SELECT l_suppkey, string_agg(CAST(q AS VARCHAR) || 'x' || CAST(n AS VARCHAR), ' ' ORDER BY n DESC, q) AS fingerprint FROM (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS q, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, CAST(l_quantity AS BIGINT)) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn <= 8 GROUP BY 1""")
def modal_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A-25: the eight most common amounts of each supplier."""
    n = t(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("long").alias("q")).agg(rows().alias("n"))
    top = n.withColumn("rn", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "q"))).where("rn <= 8")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rn", "q", "n"))), lambda s: F.concat_ws("x", s["q"].cast("string"), s["n"].cast("string")))
    return top.groupBy("l_suppkey").agg(F.array_join(parts, " ").alias("fingerprint"))


@query("headline_payer", """SELECT s_nationkey, arg_max(o_custkey, (v, o_custkey)) AS top_payer, round(max(v), 2) AS gbp FROM (SELECT s_nationkey, o_custkey, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1""")
def headline_payer(spark: SparkSession, d: str) -> DataFrame:
    """A-26."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    v = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice").join(s, "l_suppkey").join(o, "l_orderkey").groupBy("s_nationkey", "o_custkey").agg(F.sum("l_extendedprice").alias("v"))
    return v.groupBy("s_nationkey").agg(F.max_by("o_custkey", F.struct("v", "o_custkey")).alias("top_payer"), F.round(F.max("v"), 2).alias("gbp"))


@query("fiscal_cube", """SELECT fy, seg, pri, count(*) AS n, round(sum(v), 2) AS gbp FROM (SELECT CASE WHEN month(o_orderdate) >= 4 THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') ELSE CAST(year(o_orderdate) - 1 AS VARCHAR) || '-' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') END AS fy,
c_mktsegment AS seg, o_orderpriority AS pri, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY CUBE (fy, seg, pri)""")
def fiscal_cube(spark: SparkSession, d: str) -> DataFrame:
    """A-27, N-37: category by sector by fiscal year, with all totals."""
    from ledgerlark.functions.normalise import fiscal_year

    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("seg"))
    o = t(spark, d, "orders").select("o_custkey", fiscal_year(F.date_format("o_orderdate", "yyyy-MM")).alias("fy"), F.col("o_orderpriority").alias("pri"), "o_totalprice")
    # Summed at the finest grain first: the cube spreads a few hundred rows, not all orders.
    fine = o.join(c, "o_custkey").groupBy("fy", "seg", "pri").agg(rows().alias("n"), F.sum("o_totalprice").alias("v"))
    return fine.cube("fy", "seg", "pri").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("gbp"))


@query("months_present", """SELECT c_nationkey, CAST(year(o_orderdate) AS BIGINT) AS y, count(DISTINCT month(o_orderdate)) AS months, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def months_present(spark: SparkSession, d: str) -> DataFrame:
    """A-28."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return t(spark, d, "orders").select("o_custkey", "o_orderdate").join(c, "o_custkey").groupBy("c_nationkey", F.year("o_orderdate").cast("long").alias("y")).agg(F.count_distinct(F.month("o_orderdate")).alias("months"), rows().alias("n"))


@query("extremes_ratio", """SELECT n_regionkey, arg_min(k, (v, k)) AS low, arg_max(k, (v, k)) AS high, round(max(v) / min(v), 6) AS ratio FROM (SELECT n_regionkey, n_nationkey AS k, avg(abs(c_acctbal)) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 3""")
def extremes_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A-31: least and most member of each group and their ratio."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    v = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg(F.abs("c_acctbal")).alias("v")).join(n, "k")
    g = v.groupBy("n_regionkey").agg(F.min_by("k", F.struct("v", "k")).alias("low"), F.max_by("k", F.struct("v", "k")).alias("high"), F.round(F.max("v") / F.min("v"), 6).alias("ratio"), rows().alias("m"))
    return g.where("m >= 3").drop("m")


@query("spearman_by_class", """WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS b FROM part) SELECT p_brand, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def spearman_by_class(spark: SparkSession, d: str) -> DataFrame:
    """A-33: correlation of average ranks."""
    from ledgerlark.operators.statistics import average_rank

    p = t(spark, d, "part").select("p_brand", "p_size", "p_retailprice")
    p = p.select("p_brand", average_rank(["p_brand"], "p_size").alias("a"), average_rank(["p_brand"], "p_retailprice").alias("b"))
    return p.groupBy("p_brand").agg(F.round(F.corr("a", "b"), 6).alias("rho"), rows().alias("n"))


@query("spearman_p_values", """WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS b FROM part),
c AS (SELECT p_brand, corr(a, b) AS rho, count(*) AS n FROM r GROUP BY 1), t AS (SELECT *, asin(sqrt(greatest(1 - rho * rho, 0))) AS top, exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0) - lgamma(0.5)) AS c FROM c WHERE n > 2),
i AS (SELECT p_brand, sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * 2 * c * pow(sin(top * k / 4000), n - 3)) * max(top) / 4000 / 3 AS p FROM t, range(4001) s(k) GROUP BY 1)
SELECT c.p_brand, round(rho, 6) AS rho, n, round(p, 6) AS p FROM c LEFT JOIN i ON i.p_brand = c.p_brand""")
def spearman_p_values(spark: SparkSession, d: str) -> DataFrame:
    """A-33: with the two-sided p-value; the oracle integrates."""
    from ledgerlark.operators.statistics import spearman_test

    out = spearman_test(t(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice")
    return out.select("p_brand", F.round("rho", 6).alias("rho"), "n", F.round("p", 6).alias("p"))


@query("decile_table", """SELECT dec, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM (SELECT c_acctbal, ntile(10) OVER (ORDER BY c_acctbal, c_custkey) AS dec FROM customer) GROUP BY 1""")
def decile_table(spark: SparkSession, d: str) -> DataFrame:
    """A-34: deciles from global ranks, which no single task sorts."""
    from ledgerlark.operators.ranking import global_rank

    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    n = c.count()
    big, small = n % 10, n // 10
    r = F.col("rank")
    # The first n mod 10 groups have one row more.
    dec = F.when(r < big * (small + 1), F.floor(r / (small + 1)) + 1).otherwise(big + F.floor((r - big * (small + 1)) / max(1, small)) + 1)
    return global_rank(c, "c_acctbal", "rank").groupBy(dec.cast("int").alias("dec")).agg(rows().alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("fully_filed_panel", """SELECT c_custkey FROM (SELECT o_custkey AS c_custkey, count(DISTINCT year(o_orderdate)) AS y FROM orders WHERE year(o_orderdate) IN (1993, 1995, 1997) GROUP BY 1) WHERE y = 3""")
def fully_filed_panel(spark: SparkSession, d: str) -> DataFrame:
    """A-36: members present in every vintage."""
    return t(spark, d, "orders").where(F.year("o_orderdate").isin(1993, 1995, 1997)).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct(F.year("o_orderdate")).alias("y")).where("y = 3").select("c_custkey")


@query("real_terms_arc", """WITH f(y, x) AS (VALUES (1992, 1.20), (1993, 1.15), (1994, 1.10), (1995, 1.06), (1996, 1.03), (1997, 1.01), (1998, 1.00)) SELECT CAST(y AS BIGINT) AS y, round(sum(o_totalprice) * any_value(x) / count(DISTINCT o_custkey), 4) AS per_head FROM orders JOIN f ON year(o_orderdate) = y GROUP BY 1""")
def real_terms_arc(spark: SparkSession, d: str) -> DataFrame:
    """A-35, J-27: sum by year times deflator per head."""
    f = spark.createDataFrame([(1992, 1.20), (1993, 1.15), (1994, 1.10), (1995, 1.06), (1996, 1.03), (1997, 1.01), (1998, 1.00)], "y long, x double")
    o = t(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.sum("o_totalprice").alias("v"), F.count_distinct("o_custkey").alias("m"))
    return o.join(F.broadcast(f), "y").select("y", F.round(F.col("v") * F.col("x") / F.col("m"), 4).alias("per_head"))


@query("method_disagreement", """SELECT count(*) FILTER (a = b) AS agree, count(*) FILTER (a <> b) AS differ, count(*) FILTER (a IS NULL OR b IS NULL) AS unknown FROM (SELECT c_nationkey % 5 AS a, CASE WHEN c_acctbal > 0 THEN n_regionkey END AS b FROM customer JOIN nation ON n_nationkey = c_nationkey)""")
def method_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """A-37."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    x = t(spark, d, "customer").join(n, "c_nationkey").select((F.col("c_nationkey") % 5).alias("a"), F.when(F.col("c_acctbal") > 0, F.col("n_regionkey")).alias("b"))
    return x.agg(F.count_if(F.expr("a = b")).alias("agree"), F.count_if(F.expr("a <> b")).alias("differ"), F.count_if(F.expr("a is null or b is null")).alias("unknown"))


@query("query_log_report", """SELECT event_type AS confidence, count(*) AS n, round(avg(value), 4) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def query_log_report(spark: SparkSession, d: str) -> DataFrame:
    """A-39."""
    return t(spark, d, "events").groupBy(F.col("event_type").alias("confidence")).agg(rows().alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.count_distinct("user_id").alias("users"))


@query("mode_of_ratio", """SELECT l_suppkey, r AS deflator FROM (SELECT l_suppkey, round(l_extendedprice / (l_quantity * 1000), 1) AS r, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, round(l_extendedprice / (l_quantity * 1000), 1)) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1""")
def mode_of_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A-40."""
    n = t(spark, d, "lineitem").groupBy("l_suppkey", F.round(F.col("l_extendedprice") / (F.col("l_quantity") * 1000), 1).alias("r")).agg(rows().alias("n"))
    return n.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("n")).alias("m"), "r")).alias("b")).select("l_suppkey", F.col("b.r").alias("deflator"))


@query("quintile_means", """SELECT q, round(avg(s_acctbal), 4) AS mean, count(*) AS n FROM (SELECT s_acctbal, least(4, CAST(floor((row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1) / CAST((SELECT count(*) FROM supplier) AS DOUBLE) * 5) AS BIGINT)) AS q FROM supplier) GROUP BY 1""")
def quintile_means(spark: SparkSession, d: str) -> DataFrame:
    """A-42: the bucket is arithmetic on the rank."""
    from ledgerlark.operators.ranking import global_rank

    s = t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    n = s.count()
    q = F.least(F.lit(4), F.floor(F.col("rank") / F.lit(float(n)) * 5)).cast("long")
    return global_rank(s, "s_acctbal", "rank").groupBy(q.alias("q")).agg(F.round(F.avg("s_acctbal"), 4).alias("mean"), rows().alias("n"))


@query("json_props", """SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY 1""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """2.13: a field of JSON text."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t(spark, d, "events").groupBy("event_type").agg(rows().alias("n"), F.sum(k).alias("total"))


@query("two_level_coverage", """SELECT source, sum(n_chars) AS direct, sum(n_chars) FILTER (lang <> 'en') AS aggregated, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1""")
def two_level_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A-41."""
    langs = F.array_join(F.array_sort(F.collect_set("lang")), ",")
    return t(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("direct"), F.sum(F.when(F.col("lang") != "en", F.col("n_chars"))).alias("aggregated"), langs.alias("langs"))
