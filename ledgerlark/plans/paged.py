"""Queries that read sources page by page through the paged data source; the pages are landed first, as a portal would answer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.registry import query
from ledgerlark.session import shared_folder
from ledgerlark.session import table as t
from ledgerlark.sources import catalogue as c
from ledgerlark.sources import paged as P

SRC = c.Source("src", "The Source", "https://w.example", "https://w.example/dataset/{name}")
_wrap = lambda head, tail: lambda n, r: F.concat(F.lit(head), n.cast("string"), F.lit(tail), r, F.lit("]}" + "}" * head.startswith('{"result"')))
CKAN, ODS, GEONODE = _wrap('{"result":{"count":', ',"results":['), _wrap('{"total_count":', ',"results":['), _wrap('{"total":', ',"resources":[')


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    p, k = t(spark, d, "part"), F.col("p_partkey").cast("string")
    rec = F.struct(k.alias("id"), F.concat(F.lit("part-"), k).alias("name"), F.when(F.col("p_partkey") % 10 == 9, "{{title}}").otherwise(F.concat(F.lit("Survey of "), "p_name")).alias("title"), F.struct(F.col("p_brand").alias("title")).alias("organization"))
    return p, F.to_json(rec)


def _customers(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    meta = F.struct(F.struct(F.concat(F.lit("Ledger of "), "c_name").alias("title"), F.col("c_mktsegment").alias("publisher")).alias("default"))
    return t(spark, d, "customer"), F.to_json(F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dataset_id"), F.lit(True).alias("has_records"), meta.alias("metas")))


def _suppliers(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    k = F.col("s_suppkey").cast("string")
    return t(spark, d, "supplier"), F.to_json(F.struct(F.concat(F.lit("s"), k).alias("pk"), F.concat(F.lit("Layer "), "s_name").alias("title"), F.lit("own").alias("workspace")))


def _landed(spark: SparkSession, d: str, lost: int | None = None) -> list[dict]:
    """Three portals of three protocols; of the first, every page whose number leaves 1 divided by ``lost`` is not there."""
    base = f"{shared_folder(spark)}/portals-{uuid.uuid4().hex}"
    out = []
    for name, make, key, rows, wrap in (("ckan", _parts, "p_partkey", 50, CKAN), ("ods", _customers, "c_custkey", 40, ODS), ("geonode", _suppliers, "s_suppkey", 10, GEONODE)):
        table, record = make(spark, d)
        gone = F.col("start") / rows % lost == 1 if lost and name == "ckan" else None
        P.land_pages(table, key, record, f"{base}/{name}", rows, wrap, gone)
        out.append({"id": name, "api": f"{base}/{name}", "protocol": name, "address": P.LANDED, "rows": rows})
    return out


@query("paged_catalogues", """SELECT 'src:' || p_partkey AS key, 'Survey of ' || p_name AS title, p_brand AS publisher FROM part WHERE p_partkey % 10 <> 9 UNION ALL SELECT 'src:c' || c_custkey, 'Ledger of ' || c_name, c_mktsegment FROM customer UNION ALL SELECT 'src:s' || s_suppkey, 'Layer ' || s_name, 'The Source' FROM supplier""")
def paged_catalogues(spark: SparkSession, d: str) -> DataFrame:
    """S-1, S-7, S-13: a scan of each of three portals, its pages planned from their stated counts."""
    rows = {x["id"]: P.read_paged(spark, [x]) for x in _landed(spark, d)}
    of = (c.ckan(P.records_as(rows["ckan"], "ckan", c.CKAN), SRC, 2026), c.ods(P.records_as(rows["ods"], "ods", c.ODS), SRC, 2026), c.geonode(P.records_as(rows["geonode"], "geonode", c.GEONODE), SRC, 2026))
    one, two, three = (x.select("key", "title", "publisher") for x in of)
    return one.unionByName(two).unionByName(three)


@query("harvest_with_failures", """SELECT 'ckan' AS source, count(*) AS total, count(*) FILTER (p_partkey // 50 % 6 <> 1) AS stored, count(DISTINCT p_partkey // 50) FILTER (p_partkey // 50 % 6 = 1) AS errors, count(DISTINCT p_partkey // 50) FILTER (p_partkey // 50 % 6 = 1) >= 3 AS abandoned FROM part
UNION ALL SELECT 'ods', count(*), count(*), 0, false FROM customer UNION ALL SELECT 'geonode', count(*), count(*), 0, false FROM supplier""")
def harvest_with_failures(spark: SparkSession, d: str) -> DataFrame:
    """S-1: what was read of each source where pages fail; a page that fails leaves the others."""
    return P.harvest_runs(P.read_paged(spark, _landed(spark, d, 6), retries=1))


@query("paged_stream", """SELECT place, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part) GROUP BY 1""")
def paged_stream(spark: SparkSession, d: str) -> DataFrame:
    """S-1 as a stream: a portal that grows between two runs; the second goes on from the checkpoint and repeats nothing."""
    base = f"{shared_folder(spark)}/growing-{uuid.uuid4().hex}"
    parts, record = _parts(spark, d)
    seen = parts.agg(F.max("p_partkey").alias("m")).first()["m"] or 0
    for n, most in enumerate((seen // 2 + 7, seen)):
        # Each run finds the whole answers of its time under one address.
        P.land_pages(parts.where(F.col("p_partkey") <= most), "p_partkey", record, f"{base}/at{n}", 50, CKAN)
        rows = P.stream_paged(spark, [{"id": "p", "api": f"{base}/at{n}", "protocol": "ckan", "address": P.LANDED, "rows": 50}], retries=1)
        rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/ck").option("path", f"{base}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows").where("record is not null").groupBy("place").agg(F.count(F.lit(1)).alias("n"))

