"""Ordered computations: ranks, shares, fills, caps, states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.registry import ORACLE, query
from ledgerlark.session import shared_folder
from ledgerlark.session import table as t


@query("rank_in_group", """SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS rnk, count(*) OVER (PARTITION BY p_brand) AS n FROM part""")
def rank_in_group(spark: SparkSession, d: str) -> DataFrame:
    """W-1."""
    w = Window.partitionBy("p_brand")
    return t(spark, d, "part").select("p_partkey", F.rank().over(w.orderBy(F.desc("p_retailprice"))).alias("rnk"), F.count(F.lit(1)).over(w).alias("n"))


@query("pct_rank_avg", """SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand) * 100, 4) AS pct FROM part""")
def pct_rank_avg(spark: SparkSession, d: str) -> DataFrame:
    """W-2: percentile rank with ties at their mean."""
    from ledgerlark.operators.statistics import share_rank

    return t(spark, d, "part").select("p_partkey", F.round(share_rank(["p_brand"], "p_size") * 100, 4).alias("pct"))


@query("dense_positions", """SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS pos FROM supplier""")
def dense_positions(spark: SparkSession, d: str) -> DataFrame:
    """W-3."""
    return t(spark, d, "supplier").select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("pos"))


@query("topk_bottomk", """SELECT c_nationkey, c_custkey, CASE WHEN hi <= 3 THEN 'top' ELSE 'bottom' END AS side FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS hi, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS lo FROM customer) WHERE hi <= 3 OR lo <= 3""")
def topk_bottomk(spark: SparkSession, d: str) -> DataFrame:
    """W-6: Spark keeps only a group's first rows before the shuffle."""
    c = t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    w = Window.partitionBy("c_nationkey")
    hi = c.withColumn("r", F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey"))).where("r <= 3").select("c_nationkey", "c_custkey", F.lit("top").alias("side"))
    lo = c.withColumn("r", F.row_number().over(w.orderBy("c_acctbal", "c_custkey"))).where("r <= 3").select("c_nationkey", "c_custkey", F.lit("bottom").alias("side"))
    return hi.unionByName(lo.join(hi.select("c_nationkey", "c_custkey"), ["c_nationkey", "c_custkey"], "left_anti"))


@query("ffill", """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events""")
def ffill(spark: SparkSession, d: str) -> DataFrame:
    """W-8."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("filled"))


@query("sliding_count", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events""")
def sliding_count(spark: SparkSession, d: str) -> DataFrame:
    """W-9: the offered load of the last day of each user."""
    e = t(spark, d, "events").select("event_id", "user_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    return e.select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)).alias("n"))


@query("lag_change", """SELECT o_custkey, y, round(v - lag(v) OVER (PARTITION BY o_custkey ORDER BY y), 2) AS change FROM (SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)""")
def lag_change(spark: SparkSession, d: str) -> DataFrame:
    """W-10."""
    v = t(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    return v.select("o_custkey", "y", F.round(F.col("v") - F.lag("v").over(Window.partitionBy("o_custkey").orderBy("y")), 2).alias("change"))


@query("interleave_cap", """SELECT o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 5""")
def interleave_cap(spark: SparkSession, d: str) -> DataFrame:
    """W-11: round robin over hosts, five of each; rn orders the rounds."""
    return t(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("rn")).where("rn <= 5")


@query("running_total_rows", """SELECT l_orderkey, count(*) AS n, count(*) FILTER (abs(total - 2 * l_quantity) < 0.01 AND n > 2) AS totals FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY 1""")
def running_total_rows(spark: SparkSession, d: str) -> DataFrame:
    """W-12: rows that hold the sum of the others of their file."""
    w = Window.partitionBy("l_orderkey")
    x = t(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.sum("l_quantity").over(w).alias("total"), F.count(F.lit(1)).over(w).alias("m"))
    return x.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.abs(F.col("total") - 2 * F.col("l_quantity")) < 0.01) & (F.col("m") > 2)).alias("totals"))


@query("boilerplate_blank", """SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY source, text) >= 3 AND text IS NOT NULL AND source IS NOT NULL THEN NULL ELSE text END AS description FROM documents""")
def boilerplate_blank(spark: SparkSession, d: str) -> DataFrame:
    """W-13: a description that a source repeats is blanked; repeats are counted apart and joined back."""
    x = t(spark, d, "documents").select("doc_id", "source", "text", F.sha2("text", 256).alias("k"))
    often = x.groupBy("source", "k").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n").withColumn("often", F.lit(True))
    return x.join(often, ["source", "k"], "left").select("doc_id", F.when(F.col("often").isNull(), F.col("text")).alias("description"))


@query("salted_keys", """SELECT doc_id, CASE WHEN rn = 1 THEN k ELSE k || '~n' || CAST(rn AS VARCHAR) END AS key FROM (SELECT doc_id, md5(text) AS k, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents)""")
def salted_keys(spark: SparkSession, d: str) -> DataFrame:
    """W-14, X-9: the first record keeps its key, later ones get an ordinal."""
    from ledgerlark.operators.entity import salt_keys

    x = t(spark, d, "documents").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("k"))
    return salt_keys(x, "k", "doc_id").select("doc_id", F.col("salted").alias("key"))


@query("conv_turns", """SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, arg_max(role, turn) AS last_role, sum(length(text)) AS chars, count(*) FILTER (same) AS repeated_roles FROM (SELECT *, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS same FROM conversations) GROUP BY 1""")
def conv_turns(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations")
    c = c.select("conv_id", "turn", "role", F.length("text").alias("n"), F.coalesce(F.col("role") == F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(False)).alias("same"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"), F.max_by("role", "turn").alias("last_role"), F.sum("n").alias("chars"), F.count_if("same").alias("repeated_roles"))


@query("slot_reservation", """SELECT event_id, round(1.5 * rn + max(epoch(ts) - 1.5 * rn) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS slot FROM (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)""")
def slot_reservation(spark: SparkSession, d: str) -> DataFrame:
    """T-2: slots 1.5 s apart for each host, in closed form."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t(spark, d, "events").select("event_id", "user_id", "ts", F.row_number().over(w).alias("rn"), (F.expr("unix_micros(cast(ts as timestamp))") / 1e6).alias("s"))
    late = F.max(F.col("s") - 1.5 * F.col("rn")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", F.round(1.5 * F.col("rn") + late, 3).alias("slot"))


@query("ghost_reap", """WITH r AS (SELECT o_custkey % 40 AS src, max(o_orderdate) AS last, count(*) AS held FROM orders GROUP BY 1) SELECT o_orderkey FROM orders JOIN r ON src = o_custkey % 40 WHERE held >= 100 AND o_orderdate < last - INTERVAL 2000 DAY""")
def ghost_reap(spark: SparkSession, d: str) -> DataFrame:
    """K-5, T-4: rows unseen since long before their source's last full run."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate", F.expr("o_custkey % 40").alias("src"))
    r = o.groupBy("src").agg(F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("held")).where("held >= 100")
    return o.join(r, "src").where("o_orderdate < last - INTERVAL '2000' DAY").select("o_orderkey")


@query("snapshot_cdc", """WITH a AS (SELECT o_orderkey AS k, md5(o_orderstatus || '|' || CAST(o_custkey AS VARCHAR)) AS f FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey AS k, md5(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || '|' || CAST(o_custkey AS VARCHAR)) AS f FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.f <> b.f""")
def snapshot_cdc(spark: SparkSession, d: str) -> DataFrame:
    """T-5: what two snapshots' fingerprints say has changed."""
    from ledgerlark.operators.state import snapshot_changes

    o = t(spark, d, "orders")
    mark = lambda s: F.md5(F.concat_ws("|", s, F.col("o_custkey").cast("string")).cast("binary")).alias("f")
    a = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), mark(F.col("o_orderstatus")))
    b = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), mark(F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))))
    return snapshot_changes(a, b, "k", "f")


@query("upsert_merge", """SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, o.first_seen FROM (SELECT c_custkey AS k, c_acctbal AS v, c_custkey % 5 AS first_seen FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS k, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 2 = 0) n ON n.k = o.k""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """K-1: new rows overwrite, immutable columns stay."""
    from ledgerlark.operators.state import upsert

    c = t(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.expr("c_custkey % 5").alias("first_seen"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 1).alias("v"), F.lit(None).cast("long").alias("first_seen"))
    return upsert(old, new, ["k"], keep=["first_seen"])


@query("replace_children", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0) UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders WHERE o_orderkey % 5 = 0""")
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    """K-2: the children of touched keys are replaced, removed ones vanish."""
    from ledgerlark.operators.state import replace_touched

    old = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = t(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return replace_touched(old, new, ["l_orderkey"])


@query("additive_merge", """SELECT user_id AS host, sum(ok) AS ok, sum(failed) AS failed, sum(ok) = 0 AND sum(failed) >= 3 AS unreachable FROM (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS ok, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS failed FROM events) GROUP BY 1""")
def additive_merge(spark: SparkSession, d: str) -> DataFrame:
    """K-4, T-6: counts add up; three failures without a success make a host unreachable."""
    from ledgerlark.operators.state import add_counts

    e = t(spark, d, "events")
    side = lambda where: e.where(where).groupBy(F.col("user_id").alias("host")).agg(F.count_if(F.col("event_type") == "purchase").alias("ok"), F.count_if(F.col("event_type") != "purchase").alias("failed"))
    both = add_counts(side("event_id % 2 = 0"), side("event_id % 2 = 1"), ["host"], ["ok", "failed"])
    return both.withColumn("unreachable", F.expr("ok = 0 and failed >= 3"))


@query("backfill_changed", """SELECT p_partkey, lower(trim(p_name)) AS name FROM part WHERE lower(trim(p_name)) IS DISTINCT FROM p_name""")
def backfill_changed(spark: SparkSession, d: str) -> DataFrame:
    """K-9: only rows whose normalised value differs are written."""
    return t(spark, d, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("name"), "p_name").where(~F.col("name").eqNullSafe(F.col("p_name"))).drop("p_name")


@query("anti_resume", """SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48)""")
def anti_resume(spark: SparkSession, d: str) -> DataFrame:
    """T-7, U-4: what is still to be done."""
    done = t(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"))
    return t(spark, d, "part").select("p_partkey").join(done, "p_partkey", "left_anti")


@query("rate_limited", """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
r AS (SELECT event_id, user_id, rn, [sec] AS taken, true AS accepted FROM o WHERE rn = 1 UNION ALL
SELECT event_id, user_id, rn, CASE WHEN len(f) < 3 THEN list_append(f, sec) ELSE f END, len(f) < 3 FROM (SELECT o.*, list_filter(r.taken, lambda t: t > o.sec - 86400.0) AS f FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
SELECT event_id, accepted FROM r""")
def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """T-1: 30 accepted requests in 60 s for each key; a rejected request does not count."""
    from ledgerlark.streaming.limiter import rate_limit

    return rate_limit(t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("key"), F.expr("unix_micros(cast(ts as timestamp)) / 1e6").alias("at")), limit=3, window=86_400.0)


@query("rate_limited_stream", ORACLE["rate_limited"])
def rate_limited_stream(spark: SparkSession, d: str) -> DataFrame:
    """T-1 as a stream: requests land in order of time in three files, one a micro-batch, and the query is started anew for the last."""
    from ledgerlark.streaming import limiter

    base = f"{shared_folder(spark)}/limiter-{uuid.uuid4().hex}"
    e = t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("key"), F.expr("unix_micros(cast(ts as timestamp)) / 1e6").alias("at"))
    cuts = e.agg(F.percentile_approx("at", [0.3, 0.7]).alias("p")).first()["p"] or [0.0, 0.0]
    parts = [e.where(F.col("at") <= cuts[0]), e.where((F.col("at") > cuts[0]) & (F.col("at") <= cuts[1])), e.where(F.col("at") > cuts[1])]
    before = spark.conf.get(limiter.STATE_STORE[0])
    spark.conf.set(*limiter.STATE_STORE)
    try:
        for some in (parts[:2], parts[2:]):
            for part in some:
                part.write.mode("append").parquet(f"{base}/in")
            asked = spark.readStream.schema(e.schema).parquet(f"{base}/in")
            out = limiter.rate_limit_stream(asked, 3, 86_400.0).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
            out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(limiter.STATE_STORE[0], before)
    return spark.read.schema("event_id long, accepted boolean").parquet(f"{base}/out")


@query("events_tumbling", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """An extension: hourly windows, in the batch form of the streaming query."""
    from ledgerlark.streaming.events import hourly

    return hourly(t(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("events_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    """An extension: sessions with a gap of half an hour."""
    e = t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
