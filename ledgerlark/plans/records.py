"""Functions of single records over the rows of tables; the oracles state each rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import normalise as N
from ledgerlark.functions import pages as P
from ledgerlark.functions import projection, text
from ledgerlark.operators import entity, probe, spatial
from ledgerlark.registry import query
from ledgerlark.session import table as t
from ledgerlark.sources import shapes

joined = lambda c: F.array_join(c, "|")
say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
word = lambda c: F.col(c).cast("string")


def per_row(name: str, table: str, key: str, sql: str | dict[str, str], doc: str, made: Callable[[], Column], of: Callable[[Column], Column | dict[str, Column]]) -> None:
    """Registers ``of`` over the values that ``made`` gives each row of a table; ``sql`` states y, or each column, in terms of the same columns."""
    told = sql if isinstance(sql, dict) else {"y": sql}

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = of(F.col("x"))
        columns = out if isinstance(out, dict) else {"y": out}
        return t(spark, d, table).select(key, made().alias("x")).select(key, *(c.alias(n) for n, c in columns.items()))

    run.__doc__ = doc
    query(name, f"SELECT {key}, {', '.join(f'{x} AS {n}' for n, x in told.items())} FROM {table}")(run)


def turns(key: str, *values: Column | str | None) -> Column:
    """The first value for keys that n divides, the next for those that leave 1, and so on."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, v in enumerate(values):
        out = out.when(F.col(key) % len(values) == i, v if isinstance(v, Column) else F.lit(v))
    return out


per_row("repair_mojibake", "customer", "c_custkey", "c_name || '’s list – ' || c_mktsegment", "N-4: names that were decoded once too often, every second of them.",
        lambda: turns("c_custkey", say(F.col("c_name"), "â€™s list â€“ ", F.col("c_mktsegment")), say(F.col("c_name"), "’s list – ", F.col("c_mktsegment"))), lambda x: text.mojibake()(x))


@query("porter_stems", "SELECT DISTINCT w AS word, CASE WHEN length(w) >= 3 AND NOT regexp_matches(w, '(s|ie|sse)$') THEN true END AS y FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)")
def porter_stems(spark: SparkSession, d: str) -> DataFrame:
    """Q-18: a plural has its word's stem, for every word of the documents; null where the rules do not promise it."""
    words = t(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()
    same = text.stems()(say(F.col("word"), "s")) == text.stems()(F.col("word"))
    return words.select("word", F.when((F.length("word") >= 3) & ~F.col("word").rlike("(s|ie|sse)$"), same).alias("y"))


def _dates() -> Column:
    entry = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    day, other = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 20 - 10).cast("int")), "yyyy-MM-dd")
    every = F.array(entry("revision", F.lit("1900-01-01")), entry("creation", day), entry("publication", other), entry("creation", F.lit("")))
    return F.create_map(F.lit("dataset-reference-date"), F.to_json(F.when(F.col("o_orderkey") % 5 == 0, F.slice(every, 1, 1)).otherwise(every)))


per_row("reference_date", "orders", "o_orderkey", "CASE WHEN o_orderkey % 5 <> 0 THEN strftime(least(o_orderdate, o_orderdate + CAST(o_custkey % 20 - 10 AS INT) * INTERVAL 1 DAY), '%Y-%m-%d') END", "N-9: the earliest creation or publication.", _dates, N.reference_date)


def _licences() -> Column:
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    url = pair("licence_url", say("http://l/", word("c_custkey")))
    k = F.col("c_custkey") % 4
    return F.when(k == 0, F.array(url, pair("licence", say('["", "', F.col("c_mktsegment"), '"]')))).when(k == 1, F.array(url)).when(k == 2, F.array(pair("topic", F.col("c_name")))).otherwise(F.array(pair("License", say(" ", F.col("c_name"), " ")), pair("licence", F.lit("later"))))


per_row("licence_of_extras", "customer", "c_custkey", "CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'http://l/' || c_custkey WHEN 3 THEN c_name END", "N-11.", _licences, N.licence_of_extras)


def _commons() -> Column:
    flavour = F.element_at(F.array(*map(F.lit, ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    version = F.element_at(F.array(*map(F.lit, ("1.0", "2.0", "2.5", "3.0", "4.0"))), (F.col("p_size") % 5 + 1).cast("int"))
    return turns("p_partkey", say("CC ", F.upper(flavour), " ", version), say("https://creativecommons.org/licenses/", flavour, "/", version, "/"), say("cc-", flavour))


per_row("creative_commons", "part", "p_partkey", "'CC-' || upper(['by', 'by-sa', 'by-nc', 'by-nd', 'by-nc-sa'][p_partkey % 5 + 1]) || '-' || CASE WHEN p_partkey % 3 = 2 THEN '4.0' ELSE ['1.0', '2.0', '2.5', '3.0', '4.0'][p_size % 5 + 1] END", "N-13, N-14.", _commons, N.licence)
per_row("file_formats", "orders", "o_orderkey", "CASE WHEN contains(o_orderpriority, ' ') THEN '' ELSE o_orderpriority || '|' END || 'CSV|XLSX'", "N-15, N-16: labels once, in order; what is no single word and no known spelling goes.",
        lambda: F.array(F.col("o_orderpriority"), F.lit("text/csv"), F.lower("o_orderpriority"), F.lit(".xlsx"), F.lit(None)), lambda x: joined(N.file_formats(x)))


def _boxed() -> Column:
    k, w = F.col("s_suppkey"), (F.col("s_nationkey") - 12).cast("double")
    box = F.struct(w.alias("w"), F.lit(50.0).alias("s"), (w + k % 8).alias("e"), (F.lit(50.0) + k % 5).alias("n"))
    return F.struct(box.alias("box"), turns("s_suppkey", say(F.col("s_name"), " County Council"), F.col("s_name"), None).alias("who"))


per_row("plausible_bbox", "supplier", "s_suppkey", "NOT (s_suppkey % 3 = 0 AND (s_suppkey % 8 > 5 OR s_suppkey % 5 > 3))", "N-17.", _boxed, lambda x: N.plausible_bbox(x["box"], x["who"]).isNotNull())


def _corners() -> Column:
    lon, lat = F.col("s_nationkey") / 4.0 - 4, F.col("s_suppkey") % 7 + 50.0
    points = ((lon, lat), (lon + 0.5, lat), (lon + 0.5, lat + 0.25))
    return F.when(F.col("s_suppkey") % 2 == 0, F.array(*(F.array(b, a) for a, b in points))).otherwise(F.array(*(F.array(a, b) for a, b in points)))


per_row("polygon_bbox", "supplier", "s_suppkey", dict(w="CAST(s_nationkey / 4.0 - 4 AS DOUBLE)", s="CAST(s_suppkey % 7 + 50 AS DOUBLE)", e="CAST(s_nationkey / 4.0 - 3.5 AS DOUBLE)", n="CAST(s_suppkey % 7 + 50.25 AS DOUBLE)"), "N-19: corners with latitude first are turned.", _corners, lambda x: {c: N.polygon_bbox(x)[c] for c in "wsen"})
per_row("dig_path", "events", "event_id", "event_type || ':' || json_extract_string(props, '$.k')", "N-20.", lambda: F.struct(F.to_json(F.struct(F.struct(F.col("event_type").alias("b")).alias("a"))).alias("doc"), "props"), lambda x: F.concat(N.dig(x["doc"], "a.b"), F.lit(":"), N.dig(x["props"], "k")))


def _bag() -> Column:
    one = lambda k, v, shown=None: F.struct(F.lit(k).cast("string").alias("key"), v.alias("value"), (F.lit(None).cast("string") if shown is None else shown).alias("shown"))
    return F.array(one("theme", say("theme:", F.col("c_mktsegment"))), one("nation", word("c_nationkey"), say("Nation ", word("c_nationkey"))), one("url", say("http://x/", word("c_custkey"))), one(None, F.col("c_name")), one("theme", say("theme:", F.col("c_mktsegment"), " again")))


per_row("property_bag", "customer", "c_custkey", "'nation=Nation ' || c_nationkey || '|theme=' || c_mktsegment || ' again|url=http://x/' || c_custkey", "N-21: a shown value first, prefixes of vocabularies go, the last of a name counts.", _bag,
        lambda x: joined(F.array_sort(F.transform(F.map_entries(N.bag(x, "key", "value", "shown")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))))
per_row("authority_key", "supplier", "s_suppkey", "lower('St ' || replace(s_name, '#', ' and '))", "N-27.", lambda: say("St. ", F.replace("s_name", F.lit("#"), F.lit(" & ")), turns("s_suppkey", " MBC", " UA", "")), P.authority_key)


def _reference() -> Column:
    e, n = F.lpad((F.col("o_custkey") * 7 % 100_000).cast("string"), 5, "0"), F.lpad((F.col("o_orderkey") * 13 % 100_000).cast("string"), 5, "0")
    return turns("o_orderkey", say("SK ", e, " ", n), say("sk", F.left(e, F.lit(3)), F.left(n, F.lit(3))))


_SQUARE = lambda base, v: f"CAST(CASE WHEN o_orderkey % 2 = 0 THEN {base} + {v} % 100000 + 0.5 ELSE {base} + {v} % 100000 // 100 * 100 + 50 END AS DOUBLE)"
per_row("grid_reference", "orders", "o_orderkey", {"e": _SQUARE(400_000, "o_custkey * 7"), "n": _SQUARE(300_000, "o_orderkey * 13")}, "N-33: centres of squares of one and of a hundred metres.", _reference, lambda x: {c: spatial.grid_reference(x)[c] for c in "en"})


@query("segment_distance", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 10 - 2 AS x, l_discount * 40 - 2 AS y FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN x BETWEEN -1 AND 1 THEN abs(y) ELSE sqrt((abs(x) - 1) * (abs(x) - 1) + y * y) END, 6) AS y FROM p""")
def segment_distance(spark: SparkSession, d: str) -> DataFrame:
    """N-36: from points to a segment."""
    x, y = F.col("l_quantity") / 10 - 2, F.col("l_discount") * 40 - 2
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(spatial.segment_distance(x, y, F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), 6).alias("y"))


per_row("sector_of", "supplier", "s_suppkey", "['nhs', 'central_gov', 'other_local', 'nhs', 'councils'][s_suppkey % 5 + 1]", "N-38.", lambda: turns("s_suppkey", say("NHS ", F.col("s_name")), F.col("s_name"), "Transport for Greater Manchester", say(F.col("s_name"), " Ambulance"), "Plymouth City Council"), P.sector)
per_row("hotel_chain", "supplier", "s_suppkey", "['Travelodge', NULL, 'Premier Inn / Whitbread', NULL, 'Ibis / Novotel / Mercure (Accor)', NULL, 'Holiday Inn / IHG', NULL][s_suppkey % 8 + 1]", "N-40: exclusions first.",
        lambda: turns("s_suppkey", *(say(x, F.upper("s_name")) for x in ("TRAVELODGE ", "", "PREMIER INN ", "IBIS TRADING ", "HOTEL IBIS ", "BRITANNIA ", "THE HOLIDAY INN ", "THE PREMIER INN "))), P.hotel_chain)


def _body(x: Column) -> Column:
    got = P.gated_class(x, "COUNCIL", ("MODEL COUNCIL",), "BRITISH COUNCIL", [("SCHOOL|BRITISH", "education")])
    return F.concat_ws(":", got["included"].cast("string"), got["reason"])


per_row("public_body", "supplier", "s_suppkey", "['', 'true', 'false:education', 'true', 'false:exact exclusion'][s_suppkey % 5 + 1]", "N-39.", lambda: turns("s_suppkey", F.upper("s_name"), say(F.upper("s_name"), " COUNCIL"), say("SCHOOL COUNCIL ", F.upper("s_name")), say("BRITISH COUNCIL ", F.upper("s_name")), "MODEL COUNCIL"), _body)
per_row("meta_description", "customer", "c_custkey", "CASE WHEN c_custkey % 3 = 1 THEN 'Words of ' || c_name || '.' ELSE c_name || ' — open data published by ' || c_mktsegment || '. ' || (c_custkey % 9) || ' file(s), CSV. The publisher gives no description.' END", "N-42: the publisher's words, else the facts.",
        lambda: F.struct(turns("c_custkey", None, say("<p>Words of ", F.col("c_name"), ".</p>"), "").alias("d"), F.col("c_name").alias("t"), F.col("c_mktsegment").alias("p"), (F.col("c_custkey") % 9).alias("n")),
        lambda x: P.meta_description(x["d"], x["t"], x["p"], F.lit(None).cast("string"), x["n"], F.array(F.lit("CSV"), F.lit(""))))
per_row("escapes", "pages", "page_id", "url_encode(url) || ' ' || replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || ' ' || CASE WHEN regexp_matches(lower(trim(url)), '^https?://') THEN trim(url) ELSE '' END", "N-45.",
        lambda: F.col("url"), lambda x: F.concat(P.path_part(x), F.lit(" "), P.escape_html(x), F.lit(" "), F.coalesce(P.safe_url(x), F.lit(""))))
per_row("place_aliases", "supplier", "s_suppkey", "CASE s_suppkey % 3 WHEN 0 THEN 'hove|' || lower(s_name) || '|' || lower(s_name) || ' and hove' WHEN 1 THEN 'city of ' || lower(s_name) || '|of ' || lower(s_name) || '|' || lower(s_name) ELSE lower(s_name) END", "N-49.", lambda: turns("s_suppkey", say(F.col("s_name"), " and Hove"), say("City of ", F.col("s_name")), F.col("s_name")), lambda x: joined(P.place_aliases(x)))
per_row("header_peek", "part", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN 'id|' || p_name || '|' || p_size WHEN 3 THEN 'a, ' || p_name || '|' || p_brand END", "S-26: a first line that is a header.", lambda: turns("p_partkey", say("id,", F.col("p_name"), ",", word("p_size"), "\n1,2,3"), say("1,2,", word("p_size")), F.col("p_name"), say('﻿"a, ', F.col("p_name"), '",', F.col("p_brand"), "\r\nx")), lambda x: joined(probe.header_cells(x)))
per_row("answer_shape", "orders", "o_orderkey", "['ckan:' || o_orderkey, 'dcat:1', 'ods:' || o_orderkey, 'geonode:' || o_orderkey, 'json:2', 'csw'][o_orderkey % 6 + 1]", "S-32: which protocol an answer speaks, and its count.",
        lambda: turns("o_orderkey", say('{"result":{"count":', word("o_orderkey"), ',"results":[]}}'), say('{"dataset":[', word("o_custkey"), "]}"), say('{"total_count":', word("o_orderkey"), ',"results":[1]}'), say('{"total":', word("o_orderkey"), ',"resources":[]}'), say("[", word("o_orderkey"), ",2]"), say("<csw:GetRecordsResponse>", word("o_orderkey"), "</csw:GetRecordsResponse>")),
        lambda x: F.concat_ws(":", shapes.protocol(x), shapes.stated_count(x).cast("string")))


def _publishers() -> Column:
    named = turns("p_partkey", "OpenDataNI", "Greater London Authority", say(F.col("p_name"), " County Council"), None)
    spelled = turns("p_size", "OPENDATANI.", "Marine Environmental Data – Information Network", " greater-london  AUTHORITY")
    return F.struct(named.alias("y"), F.col("p_name").alias("own"), spelled.alias("spelled"))


per_row("platform_labels", "part", "p_partkey",
        dict(y="CASE p_partkey % 4 WHEN 0 THEN 'opendatani|daera_ni|agol_daera_agol|causeway_coast|mid_ulster' WHEN 1 THEN 'london_datastore' ELSE '' END",
             own="CASE trim(regexp_replace(lower(replace(p_name, 'İ', 'i ')), '[^a-z0-9]+', ' ', 'g')) WHEN 'opendatani' THEN 'opendatani|daera_ni|agol_daera_agol|causeway_coast|mid_ulster' WHEN 'marine environmental data information network' THEN 'cefas' WHEN 'greater london authority' THEN 'london_datastore' ELSE '' END",
             spelled="CASE p_size % 3 WHEN 0 THEN 'opendatani|daera_ni|agol_daera_agol|causeway_coast|mid_ulster' WHEN 1 THEN 'cefas' WHEN 2 THEN 'london_datastore' ELSE '' END"),
        "X-7: of a label, a council or no name in turn, of every row's own name, and of all labels in other spellings.", _publishers, lambda x: {c: joined(entity.platform(x[c])) for c in ("y", "own", "spelled")})
per_row("retired_text", "documents", "doc_id", "doc_id % 3 = 1 OR (doc_id % 3 <> 2 AND contains(lower(coalesce(text, '')), 'this record is retired'))", "P-3.", lambda: turns("doc_id", F.col("text"), say(F.coalesce("text", F.lit("")), " NB: THIS DATASET HAS BEEN WITHDRAWN."), None), P.retired)

# The survey's own series in powers of the longitude, which the library does not use.
_GRID = """WITH c AS (SELECT 6377563.396::DOUBLE AS a, 6356256.909::DOUBLE AS b, 0.9996012717::DOUBLE AS f, radians(49) AS p0, radians(-2) AS l0),
x AS (SELECT s_suppkey, radians(50 + s_suppkey % 800 / 100.0) AS p, radians(s_nationkey / 4.0 - 5) AS l FROM supplier),
y AS (SELECT *, (a - b) / (a + b) AS n, (a * a - b * b) / (a * a) AS e2, l - l0 AS d, sin(p) AS s, cos(p) AS k, pow(tan(p), 2) AS t2 FROM x, c),
z AS (SELECT *, a * f / sqrt(1 - e2 * s * s) AS v, a * f * (1 - e2) / pow(1 - e2 * s * s, 1.5) AS r FROM y),
m AS (SELECT *, v / r - 1 AS h, b * f * ((1 + n + 1.25 * n * n + 1.25 * pow(n, 3)) * (p - p0) - (3 * n + 3 * n * n + 21 / 8.0 * pow(n, 3)) * sin(p - p0) * cos(p + p0) + 15 / 8.0 * (n * n + pow(n, 3)) * sin(2 * (p - p0)) * cos(2 * (p + p0)) - 35 / 24.0 * pow(n, 3) * sin(3 * (p - p0)) * cos(3 * (p + p0))) AS m FROM z)
SELECT s_suppkey, round(400000 + v * k * d + v / 6 * pow(k, 3) * (v / r - t2) * pow(d, 3) + v / 120 * pow(k, 5) * (5 - 18 * t2 + t2 * t2 + 14 * h - 58 * t2 * h) * pow(d, 5)) AS e,
round(m - 100000 + v / 2 * s * k * d * d + v / 24 * s * pow(k, 3) * (5 - t2 + 9 * h) * pow(d, 4) + v / 720 * s * pow(k, 5) * (61 - 58 * t2 + t2 * t2) * pow(d, 6)) AS n FROM m"""


@query("to_national_grid", _GRID)
def to_national_grid(spark: SparkSession, d: str) -> DataFrame:
    """N-34: latitude and longitude on the grid's ellipsoid to whole metres."""
    at = projection.project(F.radians(50 + F.col("s_suppkey") % 800 / 100.0), F.radians(F.col("s_nationkey") / 4.0 - 5))
    return t(spark, d, "supplier").select("s_suppkey", at.alias("g")).select("s_suppkey", F.round("g.e").alias("e"), F.round("g.n").alias("n"))


_MARKUP = """'{"@context":"https://schema.org","@type":"Dataset","name":"' || p_name || '","url":"https://s.example/d/' || p_partkey || '","identifier":"src:' || p_partkey || '","description":"' || CASE WHEN p_partkey % 2 = 0 THEN 'About ' || p_name ELSE 'Facts' END || '","keywords":["' || p_brand || '"],'
|| CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '"creator":{"@type":"Organization","name":"' || p_type || '"},' END || '"license":"https://creativecommons.org/licenses/by/4.0/","dateModified":"2020-01-02","isBasedOn":"https://l.example/' || p_partkey || '","includedInDataCatalog":[{"@type":"DataCatalog","name":"The Site"},{"@type":"DataCatalog","name":"The Source","url":"https://w.example"}],'
|| '"distribution":[{"@type":"DataDownload","contentUrl":"https://f.example/' || p_partkey || '.csv","encodingFormat":"CSV"}]}'"""


@query("page_markup", f"SELECT p_partkey, {_MARKUP} AS markup FROM part")
def page_markup(spark: SparkSession, d: str) -> DataFrame:
    """N-44: a record's markup for machines; links that are no web address are left out."""
    k, none = word("p_partkey"), F.lit(None).cast("string")
    link = lambda u, name, f: F.struct(u.alias("url"), name.alias("name"), f.alias("format_norm"))
    c = {
        "url": say("https://s.example/d/", k), "key": say("src:", k), "title": F.col("p_name"), "description": turns("p_partkey", say("<b>About ", F.col("p_name"), "</b>"), ""), "tags": F.array(F.col("p_brand"), F.lit("")), "publisher": turns("p_partkey", none, F.col("p_type"), F.col("p_type")), "license": F.lit("CC-BY-4.0"),
        "modified": F.lit("2020-01-02T03:04:05"), "created": F.lit("soon"), "landing_url": say("https://l.example/", k), "source": F.lit("The Source"), "source_web": F.lit("https://w.example"),
        "resources": F.array(link(say("https://f.example/", k, ".csv"), F.lit(""), F.lit("CSV")), link(say("ftp://f.example/", k), F.lit("x"), F.lit("PDF"))), "meta": F.lit("Facts"),
    }
    return t(spark, d, "part").select("p_partkey", P.dataset_markup(c, "The Site").alias("markup"))
