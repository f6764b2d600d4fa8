"""Composite analyses: findings by tier, panels with witnesses and flags, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.operators import findings as X
from ledgerlark.registry import query
from ledgerlark.session import table as t


@query("finding_registry", """SELECT 1 AS tier, 'licence' AS kind, c_mktsegment AS subject, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 3 UNION ALL SELECT 2, 'rot', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY 3 UNION ALL SELECT 3, 'small', p_brand, count(*) FROM part WHERE p_size = 1 GROUP BY 3""")
def finding_registry(spark: SparkSession, d: str) -> DataFrame:
    """C-17, C-12: named predicates over their tables, as one labelled union."""
    return X.registry(
        {
            (1, "licence"): (t(spark, d, "customer").where("c_acctbal < 0"), "c_mktsegment"),
            (2, "rot"): (t(spark, d, "orders").where("o_orderstatus = 'P'"), "o_orderpriority"),
            (3, "small"): (t(spark, d, "part").where("p_size = 1"), "p_brand"),
        }
    )


@query("abolished_totals", """SELECT v.name, count(p_partkey) AS n, round(sum(p_retailprice), 2) AS total FROM (VALUES ('a'), ('f'), ('part'), ('zz')) v(name) LEFT JOIN part ON starts_with(lower(p_name), v.name) GROUP BY 1""")
def abolished_totals(spark: SparkSession, d: str) -> DataFrame:
    """A-10, J-19: totals of names by prefix, with those that have none."""
    p = t(spark, d, "part").select(F.lower("p_name").alias("n"), "p_retailprice")
    names = ("a", "f", "part", "zz")
    hit = p.agg(*(F.struct(F.lit(v).alias("name"), F.count_if(F.startswith("n", F.lit(v))).alias("n"), F.round(F.sum(F.when(F.startswith("n", F.lit(v)), F.col("p_retailprice"))), 2).alias("total")).alias(f"v{i}") for i, v in enumerate(names)))
    return hit.select(F.explode(F.array(*(F.col(f"v{i}") for i in range(len(names))))).alias("v")).select("v.*")


@query("sign_by_identity", """SELECT c_nationkey, round(abs(sum(c_acctbal) - sum(abs(c_acctbal))), 2) AS as_is, round(abs(-sum(c_acctbal) - sum(abs(c_acctbal))), 2) AS flipped, CASE WHEN abs(sum(c_acctbal) - sum(abs(c_acctbal))) <= abs(-sum(c_acctbal) - sum(abs(c_acctbal))) THEN 1 ELSE -1 END AS sign FROM customer GROUP BY 1""")
def sign_by_identity(spark: SparkSession, d: str) -> DataFrame:
    """C-1: the sign convention that leaves the smaller residual."""
    s, a = F.sum("c_acctbal"), F.sum(F.abs("c_acctbal"))
    g = t(spark, d, "customer").groupBy("c_nationkey").agg(F.abs(s - a).alias("x"), F.abs(-s - a).alias("y"))
    return g.select("c_nationkey", F.round("x", 2).alias("as_is"), F.round("y", 2).alias("flipped"), F.when(F.col("x") <= F.col("y"), 1).otherwise(-1).alias("sign"))


@query("sum_witness", """WITH a AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, sum(o_totalprice) AS parts FROM orders GROUP BY 1), b AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, sum(o_totalprice) + year(o_orderdate) % 2 * 10 AS total FROM orders GROUP BY 1, year(o_orderdate)) SELECT a.y, round(parts, 2) AS parts, round(total, 2) AS total, abs(parts - total) <= 1 AS agrees FROM a JOIN b USING (y)""")
def sum_witness(spark: SparkSession, d: str) -> DataFrame:
    """C-2: sums of members against a stated total, within a tolerance."""
    a = t(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.sum("o_totalprice").alias("parts"))
    return X.witness(a.withColumn("total", F.col("parts") + F.col("y") % 2 * 10), "parts", "total", 1.0).select("y", F.round("parts", 2).alias("parts"), F.round("total", 2).alias("total"), "agrees")


@query("scope_shares", """SELECT coalesce(c_mktsegment, 'all') AS scope, y, round(f / total, 6) AS share FROM (SELECT c_mktsegment, y, sum(v) FILTER (s = 'F') AS f, sum(v) AS total FROM (SELECT c_mktsegment, CAST(year(o_orderdate) AS BIGINT) AS y, o_orderstatus AS s, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY GROUPING SETS ((c_mktsegment, y), (y)))""")
def scope_shares(spark: SparkSession, d: str) -> DataFrame:
    """C-3: shares by scope and year, and of all scopes."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    x = t(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("y"), F.col("o_totalprice").alias("v"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("f")).join(c, "o_custkey")
    fine = x.groupBy("c_mktsegment", "y").agg(F.sum("v").alias("v"), F.sum("f").alias("f"))
    each = fine.select(F.col("c_mktsegment").alias("scope"), "y", "v", "f")
    every = fine.groupBy("y").agg(F.sum("v").alias("v"), F.sum("f").alias("f")).select(F.lit("all").alias("scope"), "y", "v", "f")
    return each.unionByName(every).select("scope", "y", F.round(F.col("f") / F.col("v"), 6).alias("share"))


@query("artefact_flags", """WITH x AS (SELECT s_suppkey, s_nationkey, s_acctbal, concat_ws(';', CASE WHEN s_acctbal <= 0 THEN 'not_positive' END, CASE WHEN s_acctbal > 9000 THEN 'over' END, CASE WHEN s_suppkey % 10 = 0 THEN 'incomplete' END) AS flags FROM supplier)
SELECT s_suppkey, flags, CASE WHEN flags = '' THEN rank() OVER (PARTITION BY s_nationkey, flags = '' ORDER BY s_acctbal DESC) END AS rnk FROM x""")
def artefact_flags(spark: SparkSession, d: str) -> DataFrame:
    """C-4, C-5: rows with flags stay but are not ranked."""
    s = t(spark, d, "supplier")
    flags = F.concat_ws(";", F.when(F.col("s_acctbal") <= 0, "not_positive"), F.when(F.col("s_acctbal") > 9000, "over"), F.when(F.col("s_suppkey") % 10 == 0, "incomplete"))
    x = s.select("s_suppkey", "s_nationkey", "s_acctbal", flags.alias("flags"))
    w = Window.partitionBy("s_nationkey", F.col("flags") == "").orderBy(F.desc("s_acctbal"))
    return x.select("s_suppkey", "flags", F.when(F.col("flags") == "", F.rank().over(w)).alias("rnk"))


@query("extreme_pairs", """WITH c AS (SELECT *, c_custkey % 9 <> 0 AS clean FROM customer) SELECT c_nationkey, arg_min(c_custkey, (c_acctbal, c_custkey)) FILTER (clean) AS low, arg_max(c_custkey, (c_acctbal, c_custkey)) FILTER (clean) AS high, count(*) FILTER (NOT clean) AS skipped FROM c GROUP BY 1""")
def extreme_pairs(spark: SparkSession, d: str) -> DataFrame:
    """C-6: the first clean row from either end."""
    c = t(spark, d, "customer")
    at = F.when(F.col("c_custkey") % 9 != 0, F.struct("c_acctbal", "c_custkey"))
    g = c.groupBy("c_nationkey").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count_if(F.col("c_custkey") % 9 == 0).alias("skipped"))
    return g.select("c_nationkey", F.col("lo.c_custkey").alias("low"), F.col("hi.c_custkey").alias("high"), "skipped")


@query("share_without_parts", """SELECT y, round(f / (total - p), 6) AS share FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0) AS p, sum(o_totalprice) AS total FROM orders GROUP BY 1)""")
def share_without_parts(spark: SparkSession, d: str) -> DataFrame:
    """C-7: a share whose denominator leaves parts out."""
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    g = t(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(part("F").alias("f"), F.coalesce(part("P"), F.lit(0.0)).alias("p"), F.sum("o_totalprice").alias("total"))
    return g.select("y", F.round(F.col("f") / (F.col("total") - F.col("p")), 6).alias("share"))


@query("never_material", """SELECT p_brand, p_type FROM part GROUP BY 1, 2 HAVING max(p_retailprice / p_size) >= 100""")
def never_material(spark: SparkSession, d: str) -> DataFrame:
    """C-8: groups that never reach a bound drop out."""
    return t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.max(F.col("p_retailprice") / F.col("p_size")).alias("m")).where("m >= 100").select("p_brand", "p_type")


@query("seeded_sample", """SELECT c_custkey FROM customer ORDER BY md5('7:' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 300""")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """C-9: the same 300 rows on every run and any cluster."""
    return X.seeded_sample(t(spark, d, "customer").select("c_custkey"), "c_custkey", 300, 7)


@query("dominant_by_month", """SELECT ym, arg_max(s, (v, s)) AS dominant, round(max(v), 2) AS gbp FROM (SELECT strftime(o_orderdate, '%Y-%m') AS ym, o_orderstatus AS s, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) GROUP BY 1""")
def dominant_by_month(spark: SparkSession, d: str) -> DataFrame:
    """C-10."""
    v = t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.col("o_orderstatus").alias("s")).agg(F.sum("o_totalprice").alias("v"))
    return v.groupBy("ym").agg(F.max_by("s", F.struct("v", "s")).alias("dominant"), F.round(F.max("v"), 2).alias("gbp"))


@query("odd_amounts", """SELECT l_suppkey, count(*) FILTER (l_extendedprice < 1500) AS micro, count(*) FILTER (l_extendedprice = floor(l_extendedprice)) AS whole, count(*) FILTER (l_quantity = 1) AS single FROM lineitem GROUP BY 1""")
def odd_amounts(spark: SparkSession, d: str) -> DataFrame:
    """C-11."""
    p = F.col("l_extendedprice")
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(p < 1500).alias("micro"), F.count_if(p == F.floor(p)).alias("whole"), F.count_if(F.col("l_quantity") == 1).alias("single"))


@query("curated_exclusions", """SELECT s_suppkey, CASE WHEN s_suppkey IN (1, 2, 3) THEN 'listed' WHEN s_acctbal < 0 THEN 'negative' ELSE 'kept' END AS reason FROM supplier""")
def curated_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """C-13: why each row is out."""
    return t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey").isin(1, 2, 3), "listed").when(F.col("s_acctbal") < 0, "negative").otherwise("kept").alias("reason"))


@query("company_totals", """SELECT s_nationkey, round(sum(v), 2) AS every, round(sum(v) FILTER (l_returnflag = 'R'), 2) AS returned, round(sum(v) / sum(sum(v)) OVER (), 6) AS share FROM (SELECT s_nationkey, l_returnflag, l_extendedprice AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY 1""")
def company_totals(spark: SparkSession, d: str) -> DataFrame:
    """C-14: totals with each one's share of all."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    by = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("v"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("r"))
    g = by.join(s, "l_suppkey").groupBy("s_nationkey").agg(F.sum("v").alias("v"), F.sum("r").alias("r"))
    total = g.agg(F.sum("v").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("s_nationkey", F.round("v", 2).alias("every"), F.round("r", 2).alias("returned"), F.round(F.col("v") / F.col("total"), 6).alias("share"))


@query("notes_by_rule", """SELECT p_partkey, concat_ws('; ', CASE WHEN p_size < 5 THEN 'small' END, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'first series' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END) AS note FROM part""")
def notes_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """C-15."""
    return t(spark, d, "part").select("p_partkey", F.concat_ws("; ", F.when(F.col("p_size") < 5, "small"), F.when(F.startswith("p_brand", F.lit("Brand#1")), "first series"), F.when(F.col("p_retailprice") > 1500, "dear")).alias("note"))


@query("quartile_witness", """WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM part GROUP BY 1) SELECT p.p_brand, count(*) FILTER (p_retailprice < a) AS below, count(*) FILTER (p_retailprice > b) AS above FROM part p JOIN q ON q.p_brand = p.p_brand GROUP BY 1""")
def quartile_witness(spark: SparkSession, d: str) -> DataFrame:
    """C-16."""
    p = t(spark, d, "part").select("p_brand", "p_retailprice")
    q = p.groupBy("p_brand").agg(F.percentile("p_retailprice", [0.25, 0.75]).alias("q"))
    return p.join(q, "p_brand").groupBy("p_brand").agg(F.count_if(F.col("p_retailprice") < F.col("q")[0]).alias("below"), F.count_if(F.col("p_retailprice") > F.col("q")[1]).alias("above"))


@query("readiness", """SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    """C-18."""
    k = t(spark, d, "documents").select(F.col("doc_id").alias("k"), F.lit(1).alias("d"), F.lit(0).alias("v")).unionByName(t(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.lit(0).alias("d"), F.lit(1).alias("v")))
    s = k.groupBy("k").agg(F.sum("d").alias("d"), F.max("v").alias("v"), F.sum("v").alias("vs"))
    return s.agg(F.sum("d").alias("documents"), F.sum("vs").alias("vectors"), F.sum(F.when(F.col("v") == 0, F.col("d")).otherwise(0)).alias("without_vector"))


@query("host_candidates", """SELECT lower(replace(n_name, ' ', '-')) || p AS host FROM nation, (VALUES ('.gov.example'), ('-data.example'), ('.opendata.example')) v(p) WHERE lower(replace(n_name, ' ', '-')) || p NOT IN (SELECT lower(replace(n_name, ' ', '-')) || '.gov.example' FROM nation WHERE n_nationkey % 2 = 0)""")
def host_candidates(spark: SparkSession, d: str) -> DataFrame:
    """C-20: names by a fixed set of patterns, less what is known."""
    n = t(spark, d, "nation").select("n_nationkey", F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))).alias("slug"))
    every = n.select(F.explode(F.array(*(F.concat("slug", F.lit(p)) for p in (".gov.example", "-data.example", ".opendata.example")))).alias("host"))
    known = n.where("n_nationkey % 2 = 0").select(F.concat("slug", F.lit(".gov.example")).alias("host"))
    return every.join(known, "host", "left_anti")


@query("quantile_bins", """SELECT c_custkey, CASE WHEN c_acctbal <= a[1] THEN 0 WHEN c_acctbal <= a[2] THEN 1 WHEN c_acctbal <= a[3] THEN 2 WHEN c_acctbal <= a[4] THEN 3 ELSE 4 END AS bin FROM customer, (SELECT quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) AS a FROM customer)""")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    """N-53, 2.16: the bins of a map's legend."""
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    from ledgerlark.operators.ranking import quantiles

    cuts = quantiles(c, "c_acctbal", [0.2, 0.4, 0.6, 0.8])
    return c.select("c_custkey", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda q: q < F.col("c_acctbal"))).alias("bin"))


@query("spending_selection", """SELECT doc_id FROM documents d WHERE regexp_matches(lower(text), 'licen|password|token|the') AND lang IN ('en', 'de') AND n_chars > 300 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def spending_selection(spark: SparkSession, d: str) -> DataFrame:
    """P-8, P-1: findable records by several terms."""
    out = t(spark, d, "labels").where("toxic = 1").select("doc_id")
    x = t(spark, d, "documents").where(F.col("lang").isin("en", "de") & (F.col("n_chars") > 300) & F.lower("text").rlike("licen|password|token|the"))
    return x.select("doc_id").join(out, "doc_id", "left_anti")


@query("pattern_dictionary", """SELECT name, count(*) AS docs FROM documents, (VALUES ('email', '[a-z]+[.][0-9]+@'), ('licence', '(?i)licen[sc]e'), ('phone', '[+]1 [(]'), ('secret', 'password=')) v(name, p) WHERE regexp_matches(text, p) GROUP BY 1""")
def pattern_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """P-14: named patterns and how many rows each meets, in one pass."""
    from ledgerlark.operators.findings import pattern_hits

    return pattern_hits(t(spark, d, "documents"), "text", {"email": "[a-z]+[.][0-9]+@", "licence": "(?i)licen[sc]e", "phone": "[+]1 [(]", "secret": "password="}).where("docs > 0")


@query("class_by_second_column", """SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' OR p_type LIKE '%STEEL%' THEN 'metal' WHEN starts_with(p_brand, 'Brand#1') THEN 'one' ELSE 'other' END AS class FROM part""")
def class_by_second_column(spark: SparkSession, d: str) -> DataFrame:
    """P-15: a row's second column overrides the class of its name."""
    from ledgerlark.functions.pages import first_rule

    by = F.coalesce(first_rule(F.col("p_type"), [("BRASS|STEEL", "metal")]), first_rule(F.col("p_brand"), [("^Brand#1", "one")]), F.lit("other"))
    return t(spark, d, "part").select("p_partkey", by.alias("class"))


@query("settlement_league", """WITH w AS (SELECT o_custkey, sum(o_totalprice) FILTER (year(o_orderdate) = 1995) AS a, sum(o_totalprice) FILTER (year(o_orderdate) = 1996) AS b FROM orders GROUP BY 1),
f AS (SELECT o_custkey, round(a, 2) AS y1995, round(b, 2) AS y1996, round(100 * (b - a) / a, 4) AS change, concat_ws(';', CASE WHEN a IS NULL OR b IS NULL THEN 'one year only' END, CASE WHEN b > 3 * a THEN 'more than thrice' END, CASE WHEN a < 1000 THEN 'small base' END) AS checks FROM w)
SELECT o_custkey, y1995, y1996, change, checks, CASE WHEN checks = '' THEN rank() OVER (PARTITION BY checks = '' ORDER BY change DESC) END AS place_no FROM f WHERE y1995 IS NOT NULL OR y1996 IS NOT NULL""")
def settlement_league(spark: SparkSession, d: str) -> DataFrame:
    """C-5: two years side by side, the change, what to check by hand, and a league of the rest."""
    from ledgerlark.operators.ranking import competition_rank

    years = t(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice")
    w = years.groupBy("o_custkey").pivot("y", [1995, 1996]).agg(F.sum("o_totalprice"))
    a, b = F.col("1995"), F.col("1996")
    checks = F.concat_ws(";", F.when(a.isNull() | b.isNull(), "one year only"), F.when(b > 3 * a, "more than thrice"), F.when(a < 1000, "small base"))
    f = w.where(a.isNotNull() | b.isNotNull()).select("o_custkey", F.round(a, 2).alias("y1995"), F.round(b, 2).alias("y1996"), F.round(100 * (b - a) / a, 4).alias("change"), checks.alias("checks"))
    league = competition_rank(f.where("checks = ''"), "change", "place_no")
    return league.unionByName(f.where("checks <> ''").withColumn("place_no", F.lit(None).cast("long")))


@query("candidate_towns", """WITH x AS (SELECT s_suppkey, s_name, (s_suppkey * 53) % 1000 AS x, (s_suppkey * 17) % 1000 AS y FROM supplier), c AS (SELECT n_nationkey, (n_nationkey * 40) % 1000 AS x, (n_nationkey * 90) % 1000 AS y FROM nation),
n AS (SELECT s_suppkey, bool_or(power(x.x - c.x, 2) + power(x.y - c.y, 2) <= 3600) AS near FROM x, c GROUP BY 1)
SELECT s_suppkey, CASE WHEN s_name LIKE '%1' THEN 'listed' WHEN NOT near THEN 'far from the coast' ELSE 'kept' END AS reason FROM x JOIN n USING (s_suppkey)""")
def candidate_towns(spark: SparkSession, d: str) -> DataFrame:
    """C-13: exclusions by a list with its reasons, then by distance; what is left are the candidates."""
    from ledgerlark.operators.spatial import within

    s = t(spark, d, "supplier").select("s_suppkey", "s_name", F.expr("(s_suppkey * 53) % 1000").cast("double").alias("x"), F.expr("(s_suppkey * 17) % 1000").cast("double").alias("y"))
    coast = t(spark, d, "nation").select("n_nationkey", F.expr("(n_nationkey * 40) % 1000").cast("double").alias("x"), F.expr("(n_nationkey * 90) % 1000").cast("double").alias("y"))
    near = within(s, "s_suppkey", coast, "n_nationkey", 60.0).select("s_suppkey").distinct().withColumn("near", F.lit(True))
    listed = s.where(F.endswith("s_name", F.lit("1"))).select("s_suppkey", F.lit("listed").alias("listed"))  # curated, here by name
    x = s.join(listed, "s_suppkey", "left").join(near, "s_suppkey", "left")
    return x.select("s_suppkey", F.coalesce("listed", F.when(F.col("near").isNull(), "far from the coast"), F.lit("kept")).alias("reason"))


@query("compound_pairs", """WITH a AS (SELECT c_custkey AS k, c_acctbal AS v, c_acctbal > 0 AS valid FROM customer), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS w FROM orders GROUP BY 1),
j AS (SELECT a.k, v, w, valid AND w IS NOT NULL AND w < 5000000 AS clean FROM a LEFT JOIN b ON b.k = a.k), q AS (SELECT quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi FROM j WHERE clean)
SELECT count(*) AS every, count(*) FILTER (clean) AS clean, count(*) FILTER (NOT clean AND v <= 0) AS no_base, count(*) FILTER (w IS NULL) AS unpaired, round(sum(w) FILTER (clean AND v < lo) / sum(v) FILTER (clean AND v < lo), 4) AS low_ratio, round(sum(w) FILTER (clean AND v > hi) / sum(v) FILTER (clean AND v > hi), 4) AS high_ratio FROM j, q""")
def compound_pairs(spark: SparkSession, d: str) -> DataFrame:
    """C-16: two measures of a body joined, flags of what is valid in both, and the outer quarters as a witness."""
    from ledgerlark.operators.ranking import quantiles

    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("w"))
    j = a.join(b, "k", "left").withColumn("clean", (F.col("v") > 0) & F.coalesce(F.col("w") < 5_000_000, F.lit(False)))
    lo, hi = quantiles(j.where("clean"), "v", [0.25, 0.75]) or (0.0, 0.0)
    ratio = lambda where: F.round(F.sum(F.when(F.col("clean") & where, F.col("w"))) / F.sum(F.when(F.col("clean") & where, F.col("v"))), 4)
    return j.agg(F.count(F.lit(1)).alias("every"), F.count_if("clean").alias("clean"), F.count_if(~F.col("clean") & (F.col("v") <= 0)).alias("no_base"), F.count_if(F.col("w").isNull()).alias("unpaired"), ratio(F.col("v") < lo).alias("low_ratio"), ratio(F.col("v") > hi).alias("high_ratio"))
