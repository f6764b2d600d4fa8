"""Tables of values with what they become, and with what must not match."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import normalise as N


def column(spark, expr, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, f"i int, x {kind}").select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in out]


def check(spark, expr, table, kind="string"):
    got = column(spark, expr, [a for a, _ in table], kind)
    assert list(zip([a for a, _ in table], got)) == list(table)


def test_titles(spark):
    check(spark, N.title, [("  Air quality ", "Air quality"), ("GREEN_BELT_TPO_sites", "Green Belt TPO Sites"), ("a_b.csv", "A B Csv"), ("{{name}}", None), ("kj", None), ("1234", None), ("", None), (None, None), ("Mixed_Case words", "Mixed_Case words"), ("É_x", "É_x")])


def test_licences(spark):
    check(
        spark, N.licence,
        [("uk-ogl", "OGL-UK-3.0"), ("Open Government Licence", "OGL-UK-3.0"), ("UK Open Government License v2", "OGL-UK-3.0"), ("CC BY 4.0", "CC-BY-4.0"), ("cc-by-nc-sa", "CC-BY-NC-SA-4.0"), ("Creative Commons Attribution Share-Alike 3.0", "CC-BY-SA-3.0"),
         ("https://creativecommons.org/licenses/by-nd/4.0/", "CC-BY-ND-4.0"), ("https://creativecommons.org/publicdomain/zero/1.0/", "CC0-1.0"), ("Creative Commons Attribution Non-Commercial No Derivatives", "CC-BY-NC-ND-4.0"), ("notspecified", None), (" ", None), (None, None),
         ("See creativecommons.org, published by us", "See creativecommons.org, published by us"), ("OS OpenData terms", "OS OpenData Licence"), ("PSMA", "OS PSMA Licence"), ("https://www.parliament.scot/about/copyright/", "Scottish Parliament Copyright"), ("x" * 61, "Custom licence"), ("NSTA Licence NSTA Licence", "NSTA Licence"), ("custom", "Custom licence"), ("A &amp; B terms", "A & B terms")],
    )
    two = spark.createDataFrame([("none", "CC0"), ("", "odc-by"), (None, None), ("cc-by", "none")], "a string, b string").select(N.licence(F.col("a"), F.col("b")).alias("y")).collect()
    assert [r["y"] for r in two] == ["CC0-1.0", "ODC-BY-1.0", None, "CC-BY-4.0"]


def test_formats(spark):
    check(spark, N.file_format, [("text/csv", "CSV"), (".XLSX", "XLSX"), ("Esri REST", "ESRI-REST"), ("https://www.iana.org/assignments/media-types/application/pdf", "PDF"), ("NetCDF", "NETCDF"), ("no such format", None), ("", None), (None, None), ("csv file", "CSV")])


def test_dates(spark):
    check(spark, lambda c: N.date_text(c, 2026), [("1786367211609", "2026-08-10T13:06:51Z"), ("1577836800", "2020-01-01T00:00:00Z"), ("2018-12", "2018-12"), ("2023-09-29", "2023-09-29"), ("18:15", None), ("{{modified}}", None), ("1902-01-01", None), ("2027", "2027"), ("2028-01-01", None), ("20231", None), ("", None), (None, None), (" 2020-05 ", "2020-05")])


def test_html(spark):
    check(spark, N.strip_html, [("<p>a&nbsp;&amp; b</p>\n c", "a & b c"), ("&lt;b&gt;", "<b>"), ("&amp;lt;", "&lt;"), ("{{description}}", None), ("", ""), (None, None)])


def test_amounts(spark):
    check(spark, N.amount, [("£1,234.50", 1234.5), ("(12.00)", -12.0), ("7.5-", -7.5), ("-3", -3.0), ("N/A", None), ("-", None), ("", None), (None, None), ("1 000", 1000.0), ("(£5)", -5.0), ("12a", None)])


@pytest.mark.parametrize(("style", "cell", "day"), [("dmy", "03/04/2020", "2020-04-03"), ("mdy", "03/04/2020", "2020-03-04"), ("mdy", "25/12/2020", "2020-12-25"), ("dmy", "2020-02-30", None), ("dmy", "20200229", "2020-02-29"), ("dmy", "1 January 2020", "2020-01-01"), ("dmy", "1/2/69", "2069-02-01"), ("dmy", "1/2/71", None), ("dmy", "43831", "2020-01-01"), ("dmy", "soon", None), ("dmy", "2020-01-02 10:00", "2020-01-02")])
def test_ledger_dates(spark, style, cell, day):
    got = spark.createDataFrame([(cell,)], "x string").select(N.ledger_date(F.col("x"), F.lit(style)).cast("string").alias("y")).first()["y"]
    assert got == day


def test_tags_and_extras(spark):
    long = "education, Schools, schools, catchment areas and more things"
    assert column(spark, N.tags, [["a, b", "A, B", " "], [long], None], "array<string>") == [["a, b"], ["education", "Schools", "catchment areas and more things"], []]
    kind = "array<struct<key:string,value:string>>"
    extras = [("bbox-west-long", "-3"), ("bbox-east-long", "1"), ("bbox-south-lat", "50"), ("bbox-north-lat", "49"), ("bbox-north-lat", "51"), ("licence_url", "http://l"), ("licence", '["", "OGL"]'), ("dataset-reference-date", '[{"type":"revision","value":"2001"},{"type":"creation","value":"2005"},{"type":"publication","value":"2004"}]')]
    got = spark.createDataFrame([(extras,)], f"x {kind}").select(N.bbox(N.extras_map(F.col("x"))).alias("b"), N.licence_of_extras(F.col("x")).alias("l"), N.reference_date(N.extras_map(F.col("x"))).alias("r")).first()
    assert tuple(got["b"]) == (-3.0, 50.0, 1.0, 51.0) and got["l"] == "OGL" and got["r"] == "2004"
    box = spark.sql("select named_struct('w', -6.0D, 's', 50.0D, 'e', 1.0D, 'n', 52.0D) as b")
    assert box.select(N.plausible_bbox(F.col("b"), F.lit("Kent County Council")).alias("y")).first()["y"] is None
    assert box.select(N.plausible_bbox(F.col("b"), F.lit("Natural England")).alias("y")).first()["y"] is not None


def test_names(spark):
    check(spark, lambda c: F.array_join(N.who(c), " "), [("Leeds City Council", "leeds"), ("Leeds", "leeds"), ("Rochdale Borough Council", "rochdale"), ("Nottingham City Council Open Data", "nottingham"), (None, ""), ("The Council", "")])
    check(spark, lambda c: F.array_join(N.identity(c), " "), [("City of London Corporation", "city corporation london of"), ("Bath Council", "bath")])
    check(spark, N.supplier_key, [("The Acme Co. Ltd", "ACME CO"), ("A & B PLC", "A B"), ("THE", ""), ("", "")])
    check(spark, N.fiscal_year, [("2023-04", "2023-24"), ("2023-03", "2022-23"), ("1999-12", "1999-00"), ("bad", None)])
    check(spark, N.host, [("HTTPS://User@Ex.org:80/x", "ex.org:80"), ("no url", None)])
    check(spark, N.initial, [(" apple", "A"), ("9", "#"), ("É", "#")])


@pytest.mark.parametrize("f", [N.title, N.licence, N.file_format, lambda c: N.date_text(c, 2026), N.name_key, N.supplier_key])
def test_normalisers_are_idempotent(spark, sf, f):
    values = [r[0] for r in spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_name").union(spark.read.parquet(f"{sf}/pages.parquet").selectExpr("url")).limit(200).collect()] + ["GREEN_BELT", "CC BY 4.0", ".csv", "1577836800", "The Acme Ltd"]
    once = column(spark, f, values)
    assert column(spark, f, once) == once


def test_link_verdicts(spark):
    rows = [("http://x/a", 403, "text/csv", None, "blocked"), ("http://x/a", 422, "", None, "blocked"), ("http://x/a", 0, "", None, "unreachable"), ("http://x/a", 404, "", None, "dead"), ("http://x/arcgis/rest/1", 200, "text/csv; charset=x", None, "data"), ("http://x/arcgis/1", 200, "application/json", None, "api"), ("http://x/f", 200, "application/json", None, "data"), ("http://x", 200, "text/html", "WMS", "api"), ("http://x", 200, None, None, "webpage"), ("http://x", 200, "image/png", None, "data"), ("http://x", 200, "video/mp4", None, "webpage")]
    got = spark.createDataFrame([(*r[:4], i) for i, r in enumerate(rows)], "u string, s int, c string, f string, i int").select("i", N.link_verdict(F.col("u"), F.col("s"), F.col("c"), F.col("f")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [r[4] for r in rows]


def test_tags_work_out_their_source_once(spark):
    """What stands in a lambda's body is worked out again for each item."""
    assert str(N.distinct_folded(F.reverse("t"))).count("reverse") == 1
    assert str(N.tags(F.reverse("t"))).count("reverse") == 1
    got = spark.createDataFrame([("b,A,a,B,c",), ("",), (None,)], "t string").select(N.distinct_folded(F.split("t", ",")).alias("x")).collect()
    assert [r["x"] for r in got] == [["b", "A", "c"], [""], None]


def test_bespoke_tags_of_any_shape(spark):
    from ledgerlark.sources import catalogue as C

    rows = ['{"id":"1","title":"Some title","tags":["x","y","X"]}', '{"id":"2","title":"Some title","tags":"z"}', '{"id":"3","title":"Some title","tags":" [\\"p\\"]"}', '{"id":"4","title":"Some title","tags":{"a":1}}', '{"id":"5","title":"Some title"}', '{"id":"6","title":"Some title","tags":"[broken"}']
    cfg = {"id": "id", "title": "title", "tags": "tags"}
    out = C.bespoke(spark.createDataFrame([(r,) for r in rows], "value string"), C.Source("s", "S", "https://s", fields=cfg), 2026)
    assert {r["key"]: r["tags"] for r in out.select("key", "tags").collect()} == {"s:1": ["x", "y"], "s:2": ["z"], "s:3": ["p"], "s:4": ['{"a":1}'], "s:5": [], "s:6": ["[broken"]}
