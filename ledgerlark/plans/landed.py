"""Queries that read files of the formats of §2.1 and write the sinks of §2.2.

The files are made of the shared tables' rows first, in the session's shared
folder, as whatever lands payloads would leave them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.operators import ledger, probe, sinks
from ledgerlark.registry import query
from ledgerlark.session import shared_folder
from ledgerlark.session import table as t
from ledgerlark.sources import catalogue as c
from ledgerlark.sources import files
from ledgerlark.sources.archives import archive_members

SRC = c.Source("src", "The Source", "https://w.example", "https://w.example/dataset/{name}")
joined = lambda x: F.array_join(x, "|")


def land(spark: SparkSession, rows: DataFrame, each: int | None = None) -> str:
    """The folder of text files that hold the rows (one column): ``each`` of them in a file."""
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    w = rows.write.option("maxRecordsPerFile", each) if each else rows.write
    w.text(path)
    return path


def pages_of(records: DataFrame, record: Column, head: str, tail: str, by: Column) -> DataFrame:
    """Paged answers: a page for each value of ``by`` with its records in a list."""
    return records.groupBy(by.alias("page")).agg(F.array_join(F.array_sort(F.collect_list(F.to_json(record))), ",").alias("r")).select(F.concat(F.lit(head), "r", F.lit(tail)).alias("value"))


def _shown(out: DataFrame) -> DataFrame:
    return out.select("key", "title", "publisher", "license_norm", "modified", "landing_url", joined(F.col("tags")).alias("tags"), joined(F.col("formats_norm")).alias("formats"), "resource_count")


@query("ckan_catalogue", """SELECT 'src:' || p_partkey AS key, 'Survey of ' || p_name AS title, p_brand AS publisher, CASE WHEN p_partkey % 2 = 0 THEN 'OGL-UK-3.0' END AS license_norm, '2020-01-02' AS modified, 'https://w.example/dataset/part-' || p_partkey AS landing_url,
'stock|' || lower(p_type) AS tags, 'CSV|PDF' AS formats, 3 AS resource_count FROM part WHERE p_partkey % 10 <> 9""")
def ckan_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """S-1, S-2: paged answers; records with an unrendered title drop out."""
    p = t(spark, d, "part")
    s = lambda x: F.struct(x.alias("name"))
    link = lambda n, f: F.struct(F.concat(F.lit("http://f/"), F.col("p_partkey").cast("string"), F.lit(n)).alias("url"), F.lit("file").alias("name"), F.lit(f).alias("format"))
    rec = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_partkey") % 10 == 9, "{{title}}").otherwise(F.concat(F.lit("Survey of "), "p_name")).alias("title"),
        F.struct(F.col("p_brand").alias("title")).alias("organization"), F.when(F.col("p_partkey") % 2 == 0, "uk-ogl").otherwise("notspecified").alias("license_id"), F.lit("2020-01-02").alias("metadata_modified"),
        F.array(s(F.lit("stock")), s(F.lower("p_type")), s(F.lit("STOCK"))).alias("tags"), F.array(link("/1", "text/csv"), link("/2", "pdf"), link("/1", "csv")).alias("resources"),
    )
    path = land(spark, pages_of(p, rec, '{"success":true,"result":{"count":1,"results":[', "]}}", F.expr("p_partkey div 500")), 1)
    return _shown(c.ckan(c.read_records(spark, path, c.CKAN, "result.results"), SRC, 2026))


@query("dcat_catalogue", """SELECT 'src:' || CASE WHEN s_suppkey % 3 = 0 THEN 'http://p/' || s_suppkey ELSE 'id-' || s_suppkey END AS key, 'List of ' || s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'Office ' || s_nationkey ELSE 'The Source' END AS publisher,
'CC-BY-4.0' AS license_norm, '2021-05-06' AS modified, 'http://p/' || s_suppkey AS landing_url, 'money' AS tags, 'CSV|HTML' AS formats, 2 AS resource_count FROM supplier""")
def dcat_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """S-3..S-6: one feed; without an identifier the landing page makes the key, and a host's name is no publisher."""
    x = t(spark, d, "supplier")
    page = F.concat(F.lit("http://p/"), F.col("s_suppkey").cast("string"))
    rec = F.struct(
        F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("id-"), F.col("s_suppkey").cast("string"))).alias("identifier"), F.concat(F.lit("List of "), "s_name").alias("title"), F.lit("cc-by").alias("license"), F.lit("2021-05-06").alias("modified"), F.array(F.lit("money")).alias("keyword"),
        F.struct(F.lit("data.example.org").alias("name")).alias("publisher"), F.when(F.col("s_suppkey") % 2 == 0, F.struct(F.concat(F.lit("Office "), F.col("s_nationkey").cast("string")).alias("fn"))).alias("contactPoint"),
        F.array(F.struct(F.lit("f").alias("title"), F.lit("text/csv").alias("mediaType"), F.lit(None).cast("string").alias("accessURL"), F.concat(page, F.lit("/f.csv")).alias("downloadURL"), F.lit(None).cast("string").alias("format")), F.struct(F.lit("Web Page").alias("title"), F.lit(None).cast("string").alias("mediaType"), page.alias("accessURL"), F.lit(None).cast("string").alias("downloadURL"), F.lit("HTML").alias("format"))).alias("distribution"),
    )
    path = land(spark, pages_of(x, rec, '{"dataset":[', "]}", F.lit(0)), 1)
    return _shown(c.dcat(c.read_records(spark, path, c.DCAT, "dataset"), SRC, 2026))


@query("ods_catalogue", """SELECT 'src:c' || c_custkey AS key, 'Ledger of ' || c_name AS title, 'The Source' AS publisher, 'CC-BY-4.0' AS license_norm, '2022-02-03' AS modified, 'https://w.example/explore/dataset/c' || c_custkey || '/' AS landing_url,
'bank|' || lower(c_mktsegment) AS tags, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'CSV|JSON' ELSE 'CSV|JSON|GEOJSON' END AS formats, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 + c_custkey % 3 END AS resource_count FROM customer""")
def ods_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """S-7, S-8: exports follow from whether there are records and shapes."""
    x = t(spark, d, "customer")
    of = F.struct(F.struct(F.concat(F.lit("Ledger of "), "c_name").alias("title"), F.lit("cc-by").alias("license"), F.lit("2022-02-03").alias("modified"), F.array(F.lit("bank")).alias("keyword"), F.array(F.lower("c_mktsegment")).alias("theme"), F.when(F.col("c_custkey") % 3 == 2, F.array(F.lit("Point"))).otherwise(F.array().cast("array<string>")).alias("geometry_types")).alias("default"))
    rec = F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dataset_id"), (F.col("c_custkey") % 3 != 0).alias("has_records"), of.alias("metas"))
    path = land(spark, pages_of(x, rec, '{"total_count":9,"results":[', "]}", F.expr("c_custkey div 100")), 1)
    return _shown(c.ods(c.read_records(spark, path, c.ODS, "results"), SRC, 2026))


@query("csw_catalogue", """SELECT 'src:i' || n_nationkey AS key, 'Rivers of ' || n_name AS title, 'The Source' AS publisher, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'OGL-UK-3.0' END AS license_norm, '2020-01-02' AS modified, 'http://u/' || n_nationkey AS landing_url, 'water' AS tags, '' AS formats, 1 AS resource_count FROM nation""")
def csw_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """S-9, S-10: an XML answer; access codes are no licence."""
    n = t(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    rec = F.concat(F.lit("<csw:Record>"), tag("dc:identifier", F.concat(F.lit("i"), k)), tag("dc:title", F.concat(F.lit("Rivers of "), "n_name")), tag("dc:rights", F.when(F.col("n_nationkey") % 2 == 0, "otherRestrictions").otherwise("uk-ogl")), tag("dc:subject", F.lit("water")), tag("dct:abstract", F.lit("About")), tag("dc:URI", F.concat(F.lit("http://u/"), k)), tag("dc:URI", F.lit("ftp://v")), tag("dct:modified", F.lit("2020-01-02")), F.lit("</csw:Record>"))
    whole = n.groupBy().agg(F.array_join(F.array_sort(F.collect_list(rec)), "").alias("r")).select(F.concat(F.lit('<r xmlns:csw="a" xmlns:dc="b" xmlns:dct="d">'), "r", F.lit("</r>")).alias("value"))
    return _shown(c.csw(c.read_csw(spark, land(spark, whole, 1)), c.Source("src", "The Source", "https://w.example"), 2026))


@query("geonode_catalogue", """SELECT 'src:' || s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'Natural Resources Wales' ELSE 'The Source' END AS publisher, s_nationkey / 10.0 - 5 AS w, 50.0 AS s, s_nationkey / 10.0 - 4 AS e, 51.5 AS n, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 4 END AS resource_count FROM supplier""")
def geonode_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """S-13..S-15, N-18, N-19: the workspace names the publisher; corners with latitude first are turned."""
    x = t(spark, d, "supplier")
    lon = F.col("s_nationkey") / 10.0 - 5
    ring = F.array(F.array(F.lit(50.0), lon), F.array(F.lit(51.5), lon + 1), F.array(F.lit(50.0), lon + 1))
    rec = F.struct(F.col("s_suppkey").cast("string").alias("pk"), F.concat(F.lit("Layer "), "s_name").alias("title"), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("geonode:l"), F.col("s_suppkey").cast("string"))).alias("alternate"), F.when(F.col("s_suppkey") % 2 == 0, "inspire-nrw-x").otherwise("own").alias("workspace"), F.struct(F.array(ring).alias("coordinates")).alias("ll_bbox_polygon"))
    path = land(spark, pages_of(x, rec, '{"total":9,"resources":[', "]}", F.expr("s_suppkey div 200")), 1)
    out = c.geonode(c.read_records(spark, path, c.GEONODE, "resources"), SRC, 2026)
    box = c.geography(out).select(F.col("dataset_key").alias("key"), *(F.round(F.col(x), 6).alias(x) for x in "wsen"))
    return out.select("key", "publisher", "resource_count").join(box, "key").select("key", "publisher", "w", "s", "e", "n", "resource_count")


@query("bespoke_catalogue", """SELECT 'src:' || o_orderkey AS key, 'Order ' || o_orderkey AS title, o_orderpriority AS publisher, NULL::VARCHAR AS license_norm, '2019-03-04' AS modified, 'https://b/' || o_orderkey AS landing_url, 'x|y|z' AS tags, CASE WHEN o_orderkey % 2 = 0 THEN 'CSV' ELSE '' END AS formats, 1 - o_orderkey % 2 AS resource_count FROM orders""")
def bespoke_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """S-11, S-12: records of any shape by the source's paths."""
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    rec = F.struct(F.struct(k.alias("id")).alias("meta"), F.concat(F.lit("Order "), k.cast("string")).alias("t"), F.lit("Other").alias("lic"), F.col("o_orderpriority").alias("by"), F.lit("2019-03-04").alias("m"), F.array(F.lit("x"), F.lit("y")).alias("tags"), F.lit("z").alias("one"), F.struct(F.when(k % 2 == 0, F.concat(F.lit("http://f/"), k.cast("string"))).alias("csv")).alias("links"))
    cfg = {"id": "meta.id", "title": "t", "publisher": "by", "modified": "m", "license": "lic", "tags": ["tags", "one"], "resources": [["links.csv", "=CSV"], ["links.none", "fmt"]], "landing": "https://b/{id}"}
    lines = spark.read.text(land(spark, o.select(F.to_json(rec).alias("value"))))
    return _shown(c.bespoke(lines, c.Source("src", "B", "https://b", fields=cfg), 2026))


@query("registry_scan", """SELECT lower(replace(n_name, ' ', '_')) AS id, n_name AS name, 'ckan' AS kind, CASE WHEN n_nationkey % 2 = 0 THEN 'https://' || n_nationkey || '.example' END AS web FROM nation""")
def registry_scan(spark: SparkSession, d: str) -> DataFrame:
    """S-16: a YAML registry of sources, read from its file."""
    n = t(spark, d, "nation")
    entry = F.concat(F.lit("- id: "), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit('\n  name: "'), "n_name", F.lit('"\n  kind: ckan  # paged\n'), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("  web: https://"), F.col("n_nationkey").cast("string"), F.lit(".example\n"))).otherwise(""))
    whole = n.groupBy().agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("r")).select(F.concat(F.lit("# sources\nsources:\n"), "r").alias("value"))
    return files.read_registry(spark, land(spark, whole, 1), ["id", "name", "kind", "web"])


@query("feature_pages", """SELECT n_nationkey AS id, n_name AS name, 4 AS corners, n_nationkey * 1.0 AS west FROM nation""")
def feature_pages(spark: SparkSession, d: str) -> DataFrame:
    """S-29: landed pages of a feature service: attributes and rings; an id that two pages hold counts once."""
    n = t(spark, d, "nation")
    x = F.col("n_nationkey").cast("double")
    ring = F.array(*(F.array(x + a, F.lit(b)) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))))
    rec = F.struct(F.struct(F.col("n_nationkey").alias("OBJECTID"), F.col("n_name").alias("NAME")).alias("attributes"), F.struct(F.array(ring).alias("rings")).alias("geometry"))
    page = n.withColumn("page", F.explode(F.array(F.expr("n_nationkey div 10"), F.expr("(n_nationkey + 1) div 10"))))
    path = land(spark, pages_of(page, rec, '{"exceededTransferLimit":true,"features":[', "]}", F.col("page")), 1)
    f = files.read_features(spark, path, "OBJECTID bigint, NAME string", "OBJECTID")
    return f.select(F.col("OBJECTID").alias("id"), F.col("NAME").alias("name"), F.size(F.col("rings")[0]).alias("corners"), F.array_min(F.transform(F.col("rings")[0], lambda p: p[0])).alias("west"))


@query("tolerant_csv", """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE round(s_acctbal, 2) END AS balance, CASE WHEN s_suppkey % 4 = 1 THEN 0.0 ELSE 7.0 END AS other FROM supplier""")
def tolerant_csv(spark: SparkSession, d: str) -> DataFrame:
    """S-30: result tables whose numbers may be blank, dashed or have thousands separators."""
    s = t(spark, d, "supplier")
    money = F.when(F.col("s_suppkey") % 4 == 0, "-").otherwise(F.concat(F.lit('"'), F.format_number("s_acctbal", 2), F.lit('"')))
    body = s.select(F.concat_ws(",", F.col("s_suppkey").cast("string"), money, F.when(F.col("s_suppkey") % 4 == 1, "").otherwise("7")).alias("value"))
    path = land(spark, spark.createDataFrame([("id,balance,other",)], "value string").unionByName(body).coalesce(1))
    x = spark.read.option("header", True).csv(path)
    return x.select(F.col("id").cast("long").alias("s_suppkey"), files.number("balance").alias("balance"), files.number("other", 0.0).alias("other"))


@query("fetch_manifest", """SELECT p_partkey, substring(sha1('http://f/' || p_partkey), 1, 40) AS file FROM part WHERE p_partkey % 3 <> 0""")
def fetch_manifest(spark: SparkSession, d: str) -> DataFrame:
    """S-31, T-7: what is still to be fetched: addresses that the manifest has no finished file for, and their file names."""
    p = t(spark, d, "part").select("p_partkey", F.concat(F.lit("http://f/"), F.col("p_partkey").cast("string")).alias("url"))
    held = p.select("url", F.when(F.col("p_partkey") % 3 == 0, "ok").otherwise("error").alias("status"))
    return files.still_to_fetch(p, held).select("p_partkey", "file")


@query("ledger_rows", """SELECT 'f' || o_custkey % 12 AS file, 'Payee ' || o_orderkey AS supplier_raw, round(o_totalprice, 2) AS amount, CAST(o_orderdate AS DATE) AS day FROM orders""")
def ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    """S-19..S-21, N-29..N-32: payment files of three encodings, four delimiters and headers of several spellings to typed rows."""
    o = t(spark, d, "orders").withColumn("f", F.expr("cast(o_custkey % 12 as int)"))
    sep = F.element_at(F.array(*map(F.lit, ",;|\t")), F.col("f") % 4 + 1)
    row = F.concat_ws("\u0001", F.concat(F.lit("Payee "), F.col("o_orderkey").cast("string")), F.date_format("o_orderdate", "dd/MM/yyyy"), F.format_string("%.2f", F.col("o_totalprice")), F.lit("café"))
    text = o.groupBy("f", sep.alias("sep")).agg(F.array_join(F.collect_list(row), "\n").alias("body"))
    head = F.element_at(F.array(*map(F.lit, ("Supplier Name\u0001Payment Date\u0001Amount\u0001Expense Type", "Payee\u0001Date\u0001Net Amount\u0001Category", "Name\u0001Date Paid\u0001Total\u0001Narrative"))), F.col("f") % 3 + 1)
    whole = F.concat(F.lit("Spend over 500\n"), F.replace(F.concat(head, F.lit("\n"), "body"), F.lit("\u0001"), F.col("sep")))
    content = F.when(F.col("f") % 3 == 0, F.encode(whole, "utf-8")).when(F.col("f") % 3 == 1, F.encode(whole, "utf-16")).otherwise(F.encode(whole, "iso-8859-1"))
    landed = text.select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("path"), content.alias("content"))
    x = ledger.transactions(ledger.read_ledgers(landed))
    return x.where("expense_type = 'café'").select("file", "supplier_raw", "amount", "day")


@query("ledger_rows_sql", """SELECT 'c' || o_custkey AS file, 'Payee ' || o_orderkey AS supplier, printf('%.2f', o_totalprice) AS amount, strftime(o_orderdate, '%d/%m/%Y') AS date FROM orders""")
def ledger_rows_sql(spark: SparkSession, d: str) -> DataFrame:
    """2.15, S-19: a payment file for each customer, read by the table function."""
    from ledgerlark.functions.tables import register_tables

    k = F.col("o_custkey")
    sep = F.element_at(F.array(*map(F.lit, ",;|\t")), (k % 4 + 1).cast("int"))
    row = F.concat_ws("\u0001", F.concat(F.lit("Payee "), F.col("o_orderkey").cast("string")), F.date_format("o_orderdate", "dd/MM/yyyy"), F.format_string("%.2f", F.col("o_totalprice")))
    body = t(spark, d, "orders").groupBy(k, sep.alias("sep")).agg(F.array_join(F.collect_list(row), "\n").alias("body"))  # the orders of one customer
    whole = F.replace(F.concat(F.lit("Supplier Name\u0001Payment Date\u0001Amount\n"), "body"), F.lit("\u0001"), F.col("sep"))
    landed = body.select(F.concat(F.lit("c"), k.cast("string")).alias("path"), F.when(k % 2 == 0, F.encode(whole, "utf-16")).otherwise(F.encode(whole, "utf-8")).alias("content"))
    register_tables(spark)
    return spark.sql("SELECT file, supplier, amount, date FROM ledger_rows(TABLE({files}) PARTITION BY path)", files=landed)


@query("probe_files", """SELECT p_partkey, ['CSV', 'JSON', 'GEOJSON', 'PDF', NULL, NULL][p_partkey % 6 + 1] AS format, ['id|name', 'a', 'k' || p_partkey, NULL, NULL, NULL][p_partkey % 6 + 1] AS columns, CASE WHEN p_partkey % 6 = 0 THEN 2 END AS rows, [NULL, NULL, NULL, NULL, 'neither bytes nor name tell', 'no readable archive'][p_partkey % 6 + 1] AS remark FROM part""")
def probe_files(spark: SparkSession, d: str) -> DataFrame:
    """S-20, S-22..S-25: what landed bytes are."""
    p, k = t(spark, d, "part"), F.col("p_partkey").cast("string")
    kinds = [(".csv", F.concat(F.lit("id;name\n1;"), "p_name", F.lit("\n2;x\n"))), ("", F.lit('{"a": 1}')), (".x", F.concat(F.lit('{"type":"FeatureCollection","features":[{"properties":{"k'), k, F.lit('":1}}]}'))), ("", F.lit("%PDF-1.7 words")), ("", F.lit("words")), ("", F.lit("PK\u0003\u0004 no archive"))]
    pick = lambda i: F.element_at(F.array(*(x[i] if isinstance(x[i], Column) else F.lit(x[i]) for x in kinds)), (F.col("p_partkey") % 6 + 1).cast("int"))
    landed = p.select(F.concat(F.lit("d/"), k, pick(0)).alias("path"), F.encode(pick(1), "utf-8").alias("content"))
    return probe.probe(landed).select(F.regexp_extract("path", "d/([0-9]+)", 1).cast("long").alias("p_partkey"), "format", joined(F.col("columns")).alias("columns"), "rows", "remark")


@query("archive_listing", """SELECT 'a' || s_nationkey || '.zip' AS archive, 'supplier/' || s_suppkey || '.txt' AS member, CAST(strlen(s_name || chr(10)) AS BIGINT) AS bytes FROM supplier""")
def archive_listing(spark: SparkSession, d: str) -> DataFrame:
    """S-22: members of archives by their directories; the archives are written by the tasks, one for each nation."""
    base = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"

    def pack(key, rows):  # noqa: ANN001, ANN202
        import io
        import zipfile

        import pandas as pd
        from pyarrow import fs

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, name in zip(rows["s_suppkey"], rows["s_name"]):
                z.writestr(f"supplier/{k}.txt", name + "\n")
        store, path = fs.FileSystem.from_uri(base)
        store.create_dir(path)
        with store.open_output_stream(f"{path}/a{key[0]}.zip") as f:
            f.write(out.getvalue())
        return pd.DataFrame({"path": [f"{base}/a{key[0]}.zip"]})

    landed = t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").groupBy("s_nationkey").applyInPandas(pack, "path string")
    return archive_members(landed).select(F.regexp_extract("path", "[^/]+$", 0).alias("archive"), "member", "bytes")


@query("stream_upsert", """SELECT p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN 200 ELSE 404 END AS status FROM part""")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """K-1, K-3, K-6: checks streamed into a table that a rebuild replaces; later checks of an address win."""
    base = f"{shared_folder(spark)}/checks-{uuid.uuid4().hex}"
    p = t(spark, d, "part").select(F.col("p_partkey").alias("url"))
    sinks.upsert_table(spark, f"{base}/table", p.select("url", F.lit(404).alias("status")), ["url"])
    p.where("url % 2 = 0").select("url", F.lit(200).alias("status")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("url long, status int").parquet(f"{base}/in")
    sinks.upsert_batches(stream, f"{base}/table", ["url"], f"{base}/ck").awaitTermination()
    return spark.read.parquet(f"{base}/table")


@query("files_round_trip", """SELECT n_nationkey, n_name, 'csv' AS kind FROM nation UNION ALL SELECT n_nationkey, n_name, 'json' FROM nation""")
def files_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """K-7: tables as CSV and as JSON lines, read back."""
    base, n = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}", t(spark, d, "nation").select("n_nationkey", "n_name")
    n.write.option("header", True).csv(f"{base}/csv")
    n.write.json(f"{base}/json")
    back = spark.read.schema(n.schema).option("header", True).csv(f"{base}/csv").withColumn("kind", F.lit("csv"))
    return back.unionByName(spark.read.schema(n.schema).json(f"{base}/json").withColumn("kind", F.lit("json")))


@query("vantage_merge", """SELECT 'home' AS vantage, CAST(p_partkey AS VARCHAR) AS url, 'ok' AS verdict, '2020-01-01' AS fetched_at FROM part UNION ALL SELECT 'away', CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END, CASE WHEN p_partkey % 2 = 0 THEN '2020-03-01' ELSE '2020-02-01' END FROM part""")
def vantage_merge(spark: SparkSession, d: str) -> DataFrame:
    """K-8: one vantage's export merged into another's table; of each address the later check."""
    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("url"), (F.col("p_partkey") % 2 == 0).alias("even"))
    checks = lambda v, s, at: p.select(F.lit(v).alias("vantage"), "url", F.lit(s).alias("verdict"), F.lit(at).alias("fetched_at"), "even")
    held = checks("home", "ok", "2020-01-01").unionByName(checks("away", "old", "2020-02-01")).drop("even")
    other = checks("away", "new", "2020-03-01").where("even").drop("even").unionByName(checks("home", "no", "2020-09-01").drop("even"))
    return sinks.import_checks(held, sinks.export_checks(other, "away")).select("vantage", "url", "verdict", "fetched_at")


@query("repair_silent", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 200 END AS status FROM part WHERE NOT (p_partkey % 3 = 0 AND p_partkey % 7 = 1)""")
def repair_silent(spark: SparkSession, d: str) -> DataFrame:
    """K-10: silent checks of hosts that answer after all go."""
    p = t(spark, d, "part")
    checks = p.select("p_partkey", F.concat(F.lit("http://h"), (F.col("p_partkey") % 7).cast("string"), F.lit(".example/"), F.col("p_partkey").cast("string")).alias("url"), F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(200).alias("status"))
    return sinks.repair_checks(checks, spark.createDataFrame([("h1.example",)], "host string")).select("p_partkey", "status")


@query("query_log", """SELECT CAST(c_custkey AS VARCHAR) AS query, 'strong' AS confidence, 0 AS n_results FROM customer""")
def query_log(spark: SparkSession, d: str) -> DataFrame:
    """K-11, T-8: the log of queries, appended and read."""
    from ledgerlark.streaming.events import append_log

    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    x = t(spark, d, "customer").select(F.lit("2026-01-01").alias("ts"), F.col("c_custkey").cast("string").alias("query"), F.lit(10).alias("k"), F.lit("strong").alias("confidence"), F.lit(0.7).alias("top_similarity"), F.lit(0).alias("n_results"), F.lit(None).cast("string").alias("place"), F.lit(0).alias("bbox_matches"), F.lit("").alias("top_key"))
    append_log(spark, x.where("query % 2 = 0"), path)
    append_log(spark, x.where("query % 2 = 1"), path)
    return spark.read.parquet(path).select("query", "confidence", "n_results")


@query("availability_of_datasets", """WITH v AS (SELECT o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'data' WHEN 1 THEN 'dead' WHEN 2 THEN 'webpage' WHEN 3 THEN 'blocked' END AS verdict FROM orders),
a AS (SELECT o_custkey, max(CASE verdict WHEN 'data' THEN 5 WHEN 'webpage' THEN 3 WHEN 'blocked' THEN 2 END) AS best, count(*) = count(verdict) AS seen FROM v GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS key, CASE best WHEN 5 THEN 'data' WHEN 3 THEN 'webpage' WHEN 2 THEN 'blocked' ELSE CASE WHEN seen THEN 'dead' WHEN o_custkey IS NULL AND c_custkey % 2 = 0 THEN 'nofiles' END END AS availability FROM customer LEFT JOIN a ON o_custkey = c_custkey""")
def availability_of_datasets(spark: SparkSession, d: str) -> DataFrame:
    """A-2, J-6: the best verdict of a dataset's resources; dead only if all were checked."""
    o = t(spark, d, "orders")
    resources = o.select(F.col("o_custkey").cast("string").alias("dataset_key"), F.col("o_orderkey").cast("string").alias("url"))
    verdict = F.element_at(F.array(*map(F.lit, ("data", "dead", "webpage", "blocked"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    checks = o.where("o_orderkey % 5 < 4").select(F.col("o_orderkey").cast("string").alias("url"), verdict.alias("verdict"))
    datasets = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), (F.col("c_custkey") % 2).cast("int").alias("resource_count"))
    return sinks.availability(datasets, resources, checks)


@query("clean_rows", """SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS gbp FROM lineitem WHERE l_linestatus = 'O' AND trim(l_returnflag) <> ''""")
def clean_rows(spark: SparkSession, d: str) -> DataFrame:
    """P-9: rows that are no duplicate and have a supplier."""
    x = t(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("is_dup"), F.col("l_returnflag").alias("supplier_raw"), "l_extendedprice")
    return ledger.clean(x).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("gbp"))


@query("topic_page", """SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0 AND l_quantity = 1) ORDER BY p_retailprice DESC, p_partkey LIMIT 100 OFFSET 50""")
def topic_page(spark: SparkSession, d: str) -> DataFrame:
    """J-8: a topic's records without duplicates and retired ones, paged."""
    li = t(spark, d, "lineitem")
    gone = lambda where: li.where(where).select(F.col("l_partkey").alias("p_partkey"))
    p = t(spark, d, "part").where("p_type = 'ECONOMY'").join(gone("l_quantity >= 49"), "p_partkey", "left_anti").join(gone("l_discount = 0 and l_quantity = 1"), "p_partkey", "left_anti")
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").offset(50).limit(100).select("p_partkey")


@query("files_with_rollup", """SELECT * FROM (SELECT s_suppkey, n, gbp FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS gbp FROM lineitem WHERE l_quantity > 45 AND l_suppkey % 2 = 0 GROUP BY 1) ON l_suppkey = s_suppkey ORDER BY gbp DESC NULLS LAST, s_suppkey LIMIT 1000)""")
def files_with_rollup(spark: SparkSession, d: str) -> DataFrame:
    """J-13: files with their rows' totals, those without any last."""
    by = t(spark, d, "lineitem").where("l_quantity > 45 and l_suppkey % 2 = 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("gbp"))
    return t(spark, d, "supplier").select("s_suppkey").join(by, "s_suppkey", "left").orderBy(F.desc_nulls_last("gbp"), "s_suppkey").limit(1000)


@query("in_list", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0)""")
def in_list(spark: SparkSession, d: str) -> DataFrame:
    """J-14: a long list of keys is a semi join."""
    chosen = t(spark, d, "customer").where("c_mktsegment = 'MACHINERY' and c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("probe_order", """SELECT p_partkey, row_number() OVER (ORDER BY p_brand IS NOT NULL AND p_partkey % 3 <> 0, p_name, p_partkey) AS place_no FROM part WHERE p_size > 10 ORDER BY place_no LIMIT 50""")
def probe_order(spark: SparkSession, d: str) -> DataFrame:
    """O-7: addresses without a format first, then by address; more are fetched than needed and filtered after."""
    p = t(spark, d, "part")
    fmt = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))
    first = p.where("p_size > 10").orderBy(fmt.isNotNull(), "p_name", "p_partkey").limit(50)
    return first.select("p_partkey", F.row_number().over(Window.orderBy(fmt.isNotNull(), "p_name", "p_partkey")).cast("long").alias("place_no"))  # of fifty rows


_PTS = "(SELECT c_custkey AS id, (c_custkey * 37) % 1100 + 0.25 AS x, (c_custkey * 91) % 1300 - 100 + 0.25 AS y FROM customer)"
_OUT = "sqrt(power(greatest(greatest(100.0 * i - x, x - 100 * i - 100), 0), 2) + power(greatest(greatest(0.0 - y, y - 1000), 0), 2))"
_IN = "least(least(x - 100.0 * i, 100.0 * i + 100 - x), least(y, 1000 - y))"


def _points_and_strips(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pts = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.expr("(c_custkey * 37) % 1100") + 0.25).alias("x"), (F.expr("(c_custkey * 91) % 1300") - 100 + 0.25).alias("y"))
    ring = lambda i: [[100.0 * i, 0.0], [100.0 * i + 100, 0.0], [100.0 * i + 100, 1000.0], [100.0 * i, 1000.0]]
    return pts, spark.createDataFrame([(i, [ring(i)]) for i in range(10)], "code int, rings array<array<array<double>>>")


@query("polygons_within", f"""SELECT id, CAST(i AS INT) AS code, round({_OUT}, 6) AS distance FROM {_PTS}, range(10) r(i) WHERE {_OUT} <= 60""")
def polygons_within(spark: SparkSession, d: str) -> DataFrame:
    """J-22, J-25: polygons at most sixty away from each point, 0 inside."""
    from ledgerlark.operators.spatial import polygon_distances

    pts, strips = _points_and_strips(spark, d)
    return polygon_distances(pts, "id", strips, "code", 50.0, 60.0).select("id", "code", F.round("distance", 6).alias("distance"))


@query("boundary_distances", f"""WITH b AS (SELECT id, min(CASE WHEN {_OUT} > 0 THEN {_OUT} ELSE {_IN} END) AS far FROM {_PTS}, range(10) r(i) GROUP BY 1)
SELECT count(*) AS n, list_sort(list(far))[count(*) // 2 + 1] AS median, round(100.0 * count(*) FILTER (far <= 25) / count(*), 4) AS within_25, round(100.0 * count(*) FILTER (far <= 50) / count(*), 4) AS within_50 FROM b WHERE far <= 100""")
def boundary_distances(spark: SparkSession, d: str) -> DataFrame:
    """A-38: how far points are from the nearest boundary: the upper median, and shares within bounds."""
    from ledgerlark.operators.spatial import polygon_distances
    from ledgerlark.operators.statistics import upper_median

    pts, strips = _points_and_strips(spark, d)
    far = polygon_distances(pts, "id", strips, "code", 50.0, 100.0, boundary=True).groupBy("id").agg(F.min("distance").alias("far"))
    share = lambda m: F.round(100.0 * F.count_if(F.col("far") <= m) / F.count(F.lit(1)), 4)
    n = far.agg(F.count(F.lit(1)).alias("n"), share(25).alias("within_25"), share(50).alias("within_50"))
    median = upper_median(far.withColumn("all", F.lit(1)), ["all"], "far", "median").select("median")
    return n.crossJoin(median).select("n", "median", "within_25", "within_50")  # one row each


@query("embed_new", """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'kept' ELSE 'made' END AS state FROM embeddings""")
def embed_new(spark: SparkSession, d: str) -> DataFrame:
    """Q-19, S-18: vectors are made for new keys only and appended; the table is whole when every key has one."""
    from ledgerlark.operators.state import append_missing

    e = t(spark, d, "embeddings").select("vec_id")
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    e.where("vec_id % 3 = 0").withColumn("state", F.lit("kept")).write.parquet(path)
    for _ in range(2):  # the second run finds nothing to do
        append_missing(e, path, "vec_id", lambda new: new.withColumn("state", F.lit("made")))
    return spark.read.parquet(path)


@query("workbook_cells", """SELECT n_nationkey AS k, 'Net' AS name, CAST(n_nationkey * 2 AS VARCHAR) AS value FROM nation UNION ALL SELECT n_nationkey, 'Code', n_name FROM nation""")
def workbook_cells(spark: SparkSession, d: str) -> DataFrame:
    """S-27, S-28, R-4: a workbook for each row, its header and cells read back."""
    from ledgerlark.sources import workbooks

    n = t(spark, d, "nation").select(F.concat(F.lit("b/"), F.col("n_nationkey").cast("string")).alias("path"), "n_nationkey", "n_name")
    content = workbooks.sheet()(F.array(F.lit("Code"), F.lit("Net")), F.array(F.col("n_name"), (F.col("n_nationkey") * 2).cast("string")))
    flat = workbooks.flat_table(workbooks.read_cells(n.select("path", content.alias("content"))), 1)
    return flat.select(F.regexp_extract("file", "b/([0-9]+)", 1).cast("int").alias("k"), "name", "value")


@query("sql_functions", """SELECT p_partkey, upper(p_brand) AS supplier, CASE WHEN p_partkey % 2 = 0 THEN 12.5 ELSE -3.0 END AS amount FROM part""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """2.15: the normalisers by name in SQL."""
    from ledgerlark.functions.register import register

    register(spark)
    t(spark, d, "part").createOrReplaceTempView("part_of_sql_functions")
    return spark.sql("SELECT p_partkey, replace(norm_supplier(replace(concat('The ', p_brand, ' Ltd'), '#', '~')), ' ', '#') AS supplier, parse_amount(CASE WHEN p_partkey % 2 = 0 THEN '£12.50' ELSE '(3.00)' END) AS amount FROM part_of_sql_functions")
