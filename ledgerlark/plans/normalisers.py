"""Normalisers over columns of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import normalise as N
from ledgerlark.functions import values as V
from ledgerlark.registry import query
from ledgerlark.session import table as t

_CAP = "upper(w[1]) || lower(w[2:])"


@query("norm_title", f"""WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN replace(upper(p_name), ' ', '_') WHEN 1 THEN '  ' || p_name || ' ' WHEN 2 THEN '{{{{name}}}}' WHEN 3 THEN left(p_name, 2) ELSE replace(lower(p_name), ' ', '_') || '.csv' END AS raw FROM part), y AS (SELECT p_partkey, trim(raw) AS s FROM x)
SELECT p_partkey, CASE WHEN length(s) <= 2 OR contains(s, '{{{{') OR NOT regexp_matches(s, '[A-Za-z]') THEN NULL WHEN contains(s, '_') AND regexp_matches(s, '^[A-Za-z0-9_.]+$')
THEN array_to_string(list_transform(list_filter(regexp_split_to_array(s, '[_.]+'), lambda w: w <> ''), lambda w: CASE WHEN lower(w) <> upper(w) AND ((w = upper(w) AND length(w) > 3) OR w = lower(w)) THEN {_CAP} ELSE w END), ' ') ELSE s END AS title FROM y""")
def norm_title(spark: SparkSession, d: str) -> DataFrame:
    """N-1, N-2."""
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    raw = F.when(k == 0, F.replace(F.upper(n), F.lit(" "), F.lit("_"))).when(k == 1, F.concat(F.lit("  "), n, F.lit(" "))).when(k == 2, "{{name}}").when(k == 3, F.substring(n, 1, 2)).otherwise(F.concat(F.replace(F.lower(n), F.lit(" "), F.lit("_")), F.lit(".csv")))
    return t(spark, d, "part").select("p_partkey", N.title(raw).alias("title"))


@query("norm_tags", """SELECT p_partkey, list_filter(x, lambda a, i: list_position(list_transform(x, lambda b: lower(b)), lower(a)) = i) AS tags FROM (SELECT p_partkey, list_filter(list_transform(CASE WHEN length(raw) > 45 THEN string_split(raw, ',') ELSE [raw] END, lambda y: trim(y)), lambda y: y <> '') || [upper(p_brand)] AS x
FROM (SELECT p_partkey, p_brand, trim(p_brand || ', ' || p_type || ', ' || CASE WHEN p_partkey % 2 = 0 THEN p_name || ', ' || lower(p_type) || ', Education And Schools, ' ELSE '' END) AS raw FROM part))""")
def norm_tags(spark: SparkSession, d: str) -> DataFrame:
    """N-3."""
    raw = F.concat(F.col("p_brand"), F.lit(", "), F.col("p_type"), F.lit(", "), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_name"), F.lit(", "), F.lower("p_type"), F.lit(", Education And Schools, "))).otherwise(""))
    return t(spark, d, "part").select("p_partkey", N.tags(F.array(raw, F.upper("p_brand"))).alias("tags"))


_ENT = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"


@query("strip_html", f"""SELECT page_id, length(s) AS chars, md5(s) AS digest FROM (SELECT page_id, trim(regexp_replace({_ENT.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")}, '[\\s\\x{{A0}}]+', ' ', 'g')) AS s FROM pages)""")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    """N-5."""
    s = N.strip_html(F.col("html"))
    return t(spark, d, "pages").select("page_id", F.length(s).cast("long").alias("chars"), F.md5(F.encode(s, "utf-8")).alias("digest"))


@query("norm_date", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(epoch(o_orderdate) + 1000000000 AS BIGINT) AS VARCHAR) WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m') WHEN 3 THEN '18:15' WHEN 4 THEN '{{modified}}' ELSE CAST(CAST(epoch(o_orderdate) * 1000 + 1000000000000 AS BIGINT) AS VARCHAR) END AS raw, o_orderdate FROM orders),
y AS (SELECT o_orderkey, CASE WHEN regexp_matches(raw, '^-?[0-9]{10}([0-9]{3})?$') THEN strftime(make_timestamp(CAST(CASE WHEN length(raw) = 13 THEN CAST(raw AS BIGINT) // 1000 ELSE CAST(raw AS BIGINT) END AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE raw END AS v FROM x)
SELECT o_orderkey, CASE WHEN TRY_CAST(regexp_extract(v, '^([0-9]{4})([^0-9]|$)', 1) AS INT) BETWEEN 1990 AND 2027 THEN v END AS value FROM y""")
def norm_date(spark: SparkSession, d: str) -> DataFrame:
    """N-6, with the year given."""
    k, when = F.col("o_orderkey") % 6, F.col("o_orderdate")
    s = F.expr("unix_seconds(cast(o_orderdate as timestamp))")
    raw = F.when(k == 0, (s + 1_000_000_000).cast("string")).when(k == 1, F.date_format(when, "yyyy-MM-dd")).when(k == 2, F.date_format(when, "yyyy-MM")).when(k == 3, "18:15").when(k == 4, "{{modified}}").otherwise((s * 1000 + 1_000_000_000_000).cast("string"))
    return t(spark, d, "orders").select("o_orderkey", N.date_text(raw, 2026).alias("value"))


@query("norm_supplier", """SELECT s_suppkey, array_to_string(CASE WHEN w[1] = 'THE' THEN w[2:] ELSE w END, ' ') AS name FROM (SELECT s_suppkey, list_filter(regexp_split_to_array(regexp_replace(upper(CASE s_suppkey % 3 WHEN 0 THEN 'The ' || s_name || ' Ltd.' WHEN 1 THEN s_name || ' & Sons PLC' ELSE s_name END), '[^A-Z0-9 ]+', ' ', 'g'), ' +'), lambda x: x NOT IN ('', 'LTD', 'LIMITED', 'PLC', 'AND')) AS w FROM supplier)""")
def norm_supplier(spark: SparkSession, d: str) -> DataFrame:
    """N-26."""
    k, n = F.col("s_suppkey") % 3, F.col("s_name")
    raw = F.when(k == 0, F.concat(F.lit("The "), n, F.lit(" Ltd."))).when(k == 1, F.concat(n, F.lit(" & Sons PLC"))).otherwise(n)
    return t(spark, d, "supplier").select("s_suppkey", N.supplier_key(raw).alias("name"))


_FMT = "CASE p_partkey % 6 WHEN 0 THEN 'text/csv' WHEN 1 THEN '.XLSX' WHEN 2 THEN 'https://www.iana.org/assignments/media-types/application/pdf' WHEN 3 THEN 'Esri REST' WHEN 4 THEN 'NetCDF' ELSE 'a strange format' END"


@query("norm_format", f"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'CSV' WHEN 1 THEN 'XLSX' WHEN 2 THEN 'PDF' WHEN 3 THEN 'ESRI-REST' WHEN 4 THEN 'NETCDF' END AS format FROM (SELECT p_partkey, {_FMT} AS raw FROM part)")
def norm_format(spark: SparkSession, d: str) -> DataFrame:
    """N-15."""
    return t(spark, d, "part").select("p_partkey", N.file_format(F.expr(_FMT)).alias("format"))


_LIC = """CASE c_custkey % 12 WHEN 0 THEN 'uk-ogl' WHEN 1 THEN 'Open Government Licence v3' WHEN 2 THEN 'CC BY-NC-SA 3.0' WHEN 3 THEN 'https://creativecommons.org/licenses/by-sa/4.0/' WHEN 4 THEN 'none' WHEN 5 THEN '' WHEN 6 THEN 'NSTA Open User Licence NSTA Open User Licence'
WHEN 7 THEN 'Published by the council; see creativecommons.org' WHEN 8 THEN 'PSMA terms' WHEN 9 THEN 'CC0 1.0 Universal, Creative Commons' WHEN 10 THEN repeat('terms of use of the data ', 5) ELSE 'other-open' END"""


@query("norm_license", f"""SELECT c_custkey, CASE c_custkey % 12 WHEN 0 THEN 'OGL-UK-3.0' WHEN 1 THEN 'OGL-UK-3.0' WHEN 2 THEN 'CC-BY-NC-SA-3.0' WHEN 3 THEN 'CC-BY-SA-4.0' WHEN 4 THEN c_mktsegment WHEN 5 THEN c_mktsegment WHEN 6 THEN 'NSTA Open User Licence' WHEN 7 THEN 'Published by the council; see creativecommons.org' WHEN 8 THEN 'OS PSMA Licence' WHEN 9 THEN 'CC0-1.0' WHEN 10 THEN 'terms of use of the data' ELSE 'OTHER-OPEN' END AS license FROM customer""")
def norm_license(spark: SparkSession, d: str) -> DataFrame:
    """N-12..N-14: the id, else the title (here the segment)."""
    return t(spark, d, "customer").select("c_custkey", N.licence(F.expr(_LIC), F.col("c_mktsegment")).alias("license"))


@query("parse_amount", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN -abs(c_acctbal) WHEN 1 THEN c_acctbal WHEN 2 THEN -abs(c_acctbal) WHEN 3 THEN NULL ELSE abs(c_acctbal) END AS amount FROM customer""")
def parse_amount(spark: SparkSession, d: str) -> DataFrame:
    """N-29: five ways of writing a balance."""
    k, b = F.col("c_custkey") % 5, F.col("c_acctbal")
    plain = F.format_string("%.2f", F.abs(b))
    raw = F.when(k == 0, F.concat(F.lit("("), F.format_number(F.abs(b), 2), F.lit(")"))).when(k == 1, F.format_string(" %.2f ", b)).when(k == 2, F.concat(F.lit("£"), plain, F.lit("-"))).when(k == 3, "N/A").otherwise(F.concat(F.lit("£ "), F.format_number(F.abs(b), 2)))
    return t(spark, d, "customer").select("c_custkey", N.amount(raw).alias("amount"))


@query("parse_ledger_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def parse_ledger_date(spark: SparkSession, d: str) -> DataFrame:
    """N-31: seven ways of writing a date."""
    k, x = F.col("o_orderkey") % 7, F.col("o_orderdate").cast("date")
    serial = F.date_diff(x, F.lit("1899-12-30").cast("date")).cast("string")
    raw = F.when(k == 0, F.date_format(x, "yyyy-MM-dd")).when(k == 1, F.date_format(x, "dd/MM/yyyy")).when(k == 2, F.date_format(x, "yyyyMMdd")).when(k == 3, F.date_format(x, "d MMM yyyy")).when(k == 4, serial).when(k == 5, F.date_format(x, "d/M/yy")).otherwise("not a date")
    return t(spark, d, "orders").select("o_orderkey", N.ledger_date(raw, F.lit("dmy")).alias("day"))


@query("date_style", """SELECT o_custkey % 30 AS file, CASE WHEN count(*) FILTER (o_custkey % 30 < 10) > count(*) FILTER (o_custkey % 30 >= 10) THEN 'iso' WHEN count(*) FILTER (o_custkey % 30 >= 20 AND day(o_orderdate) > 12) > 0 THEN 'mdy' ELSE 'dmy' END AS style FROM orders GROUP BY 1""")
def date_style(spark: SparkSession, d: str) -> DataFrame:
    """N-30: one style for each file, by what its cells can only be."""
    from ledgerlark.operators.ledger import date_styles

    f = F.col("o_custkey") % 30
    x = F.col("o_orderdate")
    raw = F.when(f < 10, F.date_format(x, "yyyy-MM-dd")).when(f < 20, F.date_format(x, "dd/MM/yyyy")).otherwise(F.date_format(x, "MM/dd/yyyy"))
    return date_styles(t(spark, d, "orders").select(f.alias("file"), raw.alias("cell")), "file", "cell")


@query("date_style_mixed", """WITH x AS (SELECT l_suppkey % 40 AS file, l_linenumber % 4 AS kind, l_shipdate AS d FROM lineitem), y AS (SELECT file, CASE WHEN file % 5 = 0 OR (file % 5 = 1 AND kind <> 0) THEN 'iso' WHEN file % 5 = 4 THEN 'text' WHEN kind <> 0 OR file % 5 = 1 THEN 'slash' ELSE 'none' END AS kind, file % 5 = 2 AND day(d) > 12 AS late FROM x)
SELECT file, CASE WHEN count(*) FILTER (kind = 'iso') > count(*) FILTER (kind = 'slash') THEN 'iso' WHEN bool_or(late AND kind = 'slash') THEN 'mdy' WHEN count(*) FILTER (kind = 'slash') > 0 THEN 'dmy' ELSE 'text' END AS style FROM y GROUP BY 1""")
def date_style_mixed(spark: SparkSession, d: str) -> DataFrame:
    """N-30: files of compact dates, of compact and slashed ones, of months first with empty cells, of days first with notes after a date, and of words."""
    from ledgerlark.operators.ledger import date_styles

    f, k, x = F.col("l_suppkey") % 40, F.col("l_linenumber") % 4, F.col("l_shipdate")
    slashed = lambda how: F.date_format(x, how)
    raw = (
        F.when(f % 5 == 0, slashed("yyyyMMdd")).when((f % 5 == 1) & (k != 0), F.concat(F.lit(" "), slashed("yyyyMMdd"), F.lit(" "))).when(f % 5 == 1, slashed("dd/MM/yyyy"))
        .when((f % 5 == 2) & (k != 0), slashed("MM/dd/yyyy")).when((f % 5 == 3) & (k != 0), slashed("dd.MM.yy")).when(f % 5 == 3, F.concat(slashed("MM/dd/yyyy"), F.lit(" as stated"))).when(f % 5 == 4, slashed("d MMM yyyy"))
    )
    return date_styles(t(spark, d, "lineitem").select(f.alias("file"), raw.alias("cell")), "file", "cell")


@query("url_parts", """SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page_param, regexp_replace(url, '[0-9]', '9', 'g')[1:24] AS shape FROM pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """N-47, N-50."""
    return t(spark, d, "pages").select("page_id", N.host(F.col("url")).alias("host"), F.regexp_extract("url", "[?&]page=([^&#]*)", 1).alias("page_param"), N.shape(F.col("url")).alias("shape"))


@query("summarise_text", """WITH x AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{A0}]+', ' ', 'g')) AS s FROM documents), y AS (SELECT doc_id, s, left(s, 155) AS cut, strpos(reverse(left(s, 155)), ' ') AS r FROM x)
SELECT doc_id, CASE WHEN length(s) <= 155 THEN s ELSE rtrim(CASE WHEN r > 0 AND 155 - r > 93 THEN left(cut, CAST(155 - r AS BIGINT)) ELSE cut END) || '…' END AS summary FROM y""")
def summarise_text(spark: SparkSession, d: str) -> DataFrame:
    """N-41."""
    return t(spark, d, "documents").select("doc_id", N.summarise(F.col("text")).alias("summary"))


@query("thin_pages", """SELECT doc_id, length(trim(left(text, doc_id % 60))) < 40 AND doc_id % 3 = 0 AND doc_id % 2 = 0 AS thin FROM documents""")
def thin_pages(spark: SparkSession, d: str) -> DataFrame:
    """N-43, P-2."""
    few = lambda k: F.when(F.col("doc_id") % k == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    x = t(spark, d, "documents")
    return x.select("doc_id", N.is_thin(F.expr("substring(text, 1, cast(doc_id % 60 as int))"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1), few(2), few(2)).alias("thin"))


@query("row_fingerprint", """SELECT o_orderkey, left(sha1(CAST(o_custkey AS VARCHAR) || '␟' || o_orderstatus || '␟' || o_orderpriority), 16) AS mark FROM orders""")
def row_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """N-46."""
    return t(spark, d, "orders").select("o_orderkey", N.fingerprint(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("mark"))


_CT = "CASE event_id % 7 WHEN 0 THEN 'text/csv; charset=utf-8' WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/json' WHEN 3 THEN '' WHEN 4 THEN 'application/x-thing' WHEN 5 THEN 'video/mp4' ELSE 'application/pdf' END"
_ST = "CASE event_id % 11 WHEN 0 THEN 403 WHEN 1 THEN 0 WHEN 2 THEN 404 WHEN 3 THEN 422 WHEN 4 THEN 500 ELSE 200 END"
_URL = "'https://h.example.org/' || CASE event_id % 4 WHEN 0 THEN 'geoserver/wms' WHEN 1 THEN 'files/a' WHEN 2 THEN 'api/x' ELSE 'page' END"
_FL = "CASE WHEN event_id % 13 = 0 THEN 'WFS' END"


@query("link_classify", f"""SELECT event_id, CASE WHEN st IN (401, 403, 429, 503, 400, 409, 418, 422, 424, 451) THEN 'blocked' WHEN st = 0 THEN 'unreachable' WHEN st >= 400 THEN 'dead' WHEN base IN ('text/csv', 'application/pdf') THEN 'data'
WHEN regexp_matches(lower(u), '{"|".join(h.replace("/", "/") for h in V.API_HINTS)}') OR coalesce(f, '') IN ('WMS', 'WFS', 'API', 'SPARQL') THEN 'api' WHEN base = 'application/json' THEN 'data' WHEN base IN ('text/html', '') THEN 'webpage' WHEN regexp_matches(base, '^(text|image|application)/') THEN 'data' ELSE 'webpage' END AS verdict
FROM (SELECT event_id, {_ST} AS st, split_part({_CT}, ';', 1) AS base, {_URL} AS u, {_FL} AS f FROM events)""")
def link_classify(spark: SparkSession, d: str) -> DataFrame:
    """N-51."""
    e = t(spark, d, "events").select("event_id", F.expr(_ST).alias("st"), F.expr(_CT).alias("ct"), F.expr(_URL).alias("u"), F.expr(_FL).alias("f"))
    return e.select("event_id", N.link_verdict(F.col("u"), F.col("st"), F.col("ct"), F.col("f")).alias("verdict"))


@query("name_identity", """SELECT n_nationkey, array_to_string(list_sort(list_filter(list_distinct(string_split(trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: w NOT IN ('', 'council', 'city', 'of', 'the', 'open', 'data', 'borough', 'portal'))), ' ') AS who FROM (SELECT n_nationkey, 'The ' || n_name || CASE n_nationkey % 3 WHEN 0 THEN ' City Council' WHEN 1 THEN ' Open Data Portal' ELSE ' Borough of ' || n_name END AS p FROM nation)""")
def name_identity(spark: SparkSession, d: str) -> DataFrame:
    """N-23, N-24: which body a publisher's name says."""
    k, n = F.col("n_nationkey") % 3, F.col("n_name")
    p = F.concat(F.lit("The "), n, F.when(k == 0, " City Council").when(k == 1, " Open Data Portal").otherwise(F.concat(F.lit(" Borough of "), n)))
    return t(spark, d, "nation").select("n_nationkey", F.array_join(N.who(p), " ").alias("who"))


@query("index_text", """SELECT doc_id, md5(left(text, 40) || chr(10) || 'Publisher: ' || source || chr(10) || 'Tags: ' || lang || ', ' || source || chr(10) || left(text, 600)) AS digest FROM documents""")
def index_text(spark: SparkSession, d: str) -> DataFrame:
    """N-52."""
    s = N.index_text(F.substring("text", 1, 40), F.col("source"), F.array("lang", "source"), F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.md5(F.encode(s, "utf-8")).alias("digest"))


@query("geo_extras", """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN c_custkey % 50 - 25.5 END AS w, CASE WHEN c_custkey % 3 <> 2 THEN c_custkey % 50 - 20.0 END AS e, CASE WHEN c_custkey % 4 <> 3 THEN 'annually' END AS freq FROM customer""")
def geo_extras(spark: SparkSession, d: str) -> DataFrame:
    """N-7, N-8, N-10: a box and a frequency out of key-value extras."""
    text = lambda c: c.cast("string")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    w = F.col("c_custkey") % 50 - 25.5
    north = F.when(F.col("c_custkey") % 3 == 2, "far").otherwise("55.5")
    extras = F.array(pair("bbox-west-long", text(w)), pair("bbox-east-long", text(F.col("c_custkey") % 50 - 20.0)), pair("bbox-south-lat", F.lit("50")), pair("bbox-north-lat", F.lit("[]")), pair("bbox-north-lat", north), pair("frequency-of-update", F.when(F.col("c_custkey") % 4 == 3, "").otherwise(" annually ")))
    x = t(spark, d, "customer").select("c_custkey", N.extras_map(extras).alias("m"))
    box = N.bbox(F.col("m"))
    return x.select("c_custkey", box["w"].alias("w"), box["e"].alias("e"), N.update_frequency(F.col("m")).alias("freq"))


@query("haversine", """SELECT c_custkey, round(2 * 6371.0088 * asin(sqrt(power(sin(radians(la2 - la1) / 2), 2) + cos(radians(la1)) * cos(radians(la2)) * power(sin(radians(lo2 - lo1) / 2), 2))), 4) AS km FROM (SELECT c_custkey, c_custkey % 90 - 45.0 AS la1, c_custkey % 120 - 60.0 AS lo1, c_nationkey - 10.0 AS la2, c_nationkey * 2.0 AS lo2 FROM customer)""")
def haversine(spark: SparkSession, d: str) -> DataFrame:
    """N-35."""
    from ledgerlark.operators.spatial import haversine_km

    c = F.col
    return t(spark, d, "customer").select("c_custkey", F.round(haversine_km(c("c_custkey") % 120 - 60.0, c("c_custkey") % 90 - 45.0, c("c_nationkey") * 2.0, c("c_nationkey") - 10.0), 4).alias("km"))


@query("knn_cell", """SELECT c, s FROM (SELECT c.c_custkey AS c, s.s_suppkey AS s, row_number() OVER (PARTITION BY c.c_custkey ORDER BY power(c.x - s.x, 2) + power(c.y - s.y, 2), s.s_suppkey) AS rn FROM (SELECT c_custkey, (c_custkey * 37) % 1000 AS x, (c_custkey * 91) % 1000 AS y FROM customer) c, (SELECT s_suppkey, (s_suppkey * 53) % 1000 AS x, (s_suppkey * 17) % 1000 AS y FROM supplier) s) WHERE rn = 1""")
def knn_cell(spark: SparkSession, d: str) -> DataFrame:
    """J-21, J-24: the nearest site, by rings of grid cells that grow until no nearer one can exist."""
    from ledgerlark.operators.spatial import nearest

    a = t(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.expr("(c_custkey * 37) % 1000").cast("double").alias("x"), F.expr("(c_custkey * 91) % 1000").cast("double").alias("y"))
    b = t(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.expr("(s_suppkey * 53) % 1000").cast("double").alias("x"), F.expr("(s_suppkey * 17) % 1000").cast("double").alias("y"))
    return nearest(a, "c", b, "s", cell=100.0).where("s is not null").select("c", "s")


@query("within_radius", """SELECT c.c_custkey AS a, s.s_suppkey AS b FROM (SELECT c_custkey, (c_custkey * 37) % 1000 AS x, (c_custkey * 91) % 1000 AS y FROM customer) c JOIN (SELECT s_suppkey, (s_suppkey * 53) % 1000 AS x, (s_suppkey * 17) % 1000 AS y FROM supplier) s ON power(c.x - s.x, 2) + power(c.y - s.y, 2) <= 2500""")
def within_radius(spark: SparkSession, d: str) -> DataFrame:
    """J-22, J-23, J-25: pairs within a distance, by equal cells and a residual test."""
    from ledgerlark.operators.spatial import within

    a = t(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.expr("(c_custkey * 37) % 1000").cast("double").alias("x"), F.expr("(c_custkey * 91) % 1000").cast("double").alias("y"))
    b = t(spark, d, "supplier").select(F.col("s_suppkey").alias("b"), F.expr("(s_suppkey * 53) % 1000").cast("double").alias("x"), F.expr("(s_suppkey * 17) % 1000").cast("double").alias("y"))
    return within(a, "a", b, "b", 50.0).select("a", "b")


@query("point_in_polygon", """SELECT c_custkey AS id, CAST(least(9, floor(((c_custkey * 37) % 997 + 0.5) / 100)) AS INT) AS code FROM customer WHERE ((c_custkey * 91) % 997 + 0.5) > ((c_custkey * 37) % 997 + 0.5) - 100 * floor(((c_custkey * 37) % 997 + 0.5) / 100)""")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """J-20: ten polygons side by side, each a square without the triangle under its diagonal."""
    from ledgerlark.operators.spatial import points_in_polygons

    pts = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.expr("(c_custkey * 37) % 997") + 0.5).alias("x"), (F.expr("(c_custkey * 91) % 997") + 0.5).alias("y"))
    ring = lambda i: [[100.0 * i, 0.0], [100.0 * i + 100.0, 100.0], [100.0 * i + 100.0, 1000.0], [100.0 * i, 1000.0]]
    polygons = spark.createDataFrame([(i, [ring(i)]) for i in range(10)], "code int, rings array<array<array<double>>>")
    return points_in_polygons(pts, "id", polygons, "code", cell=50.0).select("id", "code")
