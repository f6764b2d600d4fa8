"""Projection, stems, repairs, page texts, rules and probes."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import pages, projection, text
from ledgerlark.operators import probe


def one(spark, expr):
    return spark.range(1).select(expr.alias("y")).first()["y"]


def test_projection_worked_example_and_round_trip(spark):
    lat, lon = F.radians(F.lit(52 + 39 / 60 + 27.2531 / 3600)), F.radians(F.lit(1 + 43 / 60 + 4.5177 / 3600))
    p = one(spark, projection.project(lat, lon))
    assert p["e"] == pytest.approx(651409.903, abs=0.01) and p["n"] == pytest.approx(313177.270, abs=0.01)
    w = one(spark, projection.from_grid(F.lit(530000.0), F.lit(180000.0)))
    assert w["lat"] == pytest.approx(51.503, abs=0.01) and w["lon"] == pytest.approx(-0.128, abs=0.02)
    back = one(spark, projection.to_grid(F.lit(w["lon"]), F.lit(w["lat"])))
    assert back["e"] == pytest.approx(530000, abs=1) and back["n"] == pytest.approx(180000, abs=1)


def test_stems():
    table = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adoption": "adopt", "replacement": "replac", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "sky": "sky", "allotments": "allot", "be": "be"}
    assert {w: text.stem(w) for w in table} == table


def test_repairs(spark):
    broken = "Mayor" + "’".encode().decode("cp1252") + "s"
    rows = spark.createDataFrame([(broken,), ("café",), (None,)], "x string")
    assert [r[0] for r in rows.select(text.mojibake()("x")).collect()] == ["Mayor’s", "café", None]
    assert [r[0] for r in spark.createDataFrame([("a &eacute; &#233; &amp;lt;",)], "x string").select(text.entities()("x")).collect()] == ["a é é &lt;"]
    assert [r[0] for r in spark.createDataFrame([("cats",), ("cats",)], "x string").select(text.stems()("x")).collect()] == ["cat", "cat"]


def test_page_texts(spark):
    null = F.lit(None).cast("string")
    assert one(spark, pages.path_part(F.lit("a b/é"))) == "a%20b%2F%C3%A9"
    assert one(spark, pages.safe_url(F.lit("javascript:x"))) is None
    assert one(spark, pages.escape_html(F.lit("<a href='x'>&"))) == "&lt;a href=&#x27;x&#x27;&gt;&amp;"
    assert one(spark, pages.meta_description(null, F.lit("T"), F.lit("P"), null, F.lit(2), F.array(F.lit("CSV"), F.lit("")))) == "T — open data published by P. 2 file(s), CSV. The publisher gives no description."
    assert one(spark, pages.retired(F.lit("NB: This dataset has been withdrawn."))) is True
    resources = F.array(F.struct(F.lit("http://f").alias("url"), F.lit("").alias("name"), F.lit("CSV").alias("format_norm")), F.struct(F.lit("ftp://g").alias("url"), F.lit("g").alias("name"), null.alias("format_norm")))
    doc = one(spark, pages.dataset_markup({"url": F.lit("https://s/1"), "key": F.lit("k"), "title": F.lit("</script>"), "description": F.lit(""), "tags": F.array(F.lit("a"), F.lit("")), "publisher": null, "license": F.lit("CC0-1.0"), "modified": F.lit("2020-01-02T00"), "created": F.lit("2020"), "landing_url": null, "source": F.lit("S"), "source_web": null, "resources": resources, "meta": F.lit("m")}, "Site"))
    assert "<" not in doc
    d = json.loads(doc)
    assert d["name"] == "</script>" and d["description"] == "m" and d["keywords"] == ["a"] and d["license"].endswith("/zero/1.0/") and d["dateModified"] == "2020-01-02" and "dateCreated" not in d and [x["contentUrl"] for x in d["distribution"]] == ["http://f"] and len(d["includedInDataCatalog"]) == 2


def test_names_and_rules(spark):
    assert one(spark, pages.slug_of_host(F.lit("ws-data.nisra.gov.uk"))) == "nisra" and one(spark, pages.slug_of_host(F.lit("data.gov.uk"))) == "data"
    assert one(spark, pages.place_aliases(F.lit("Brighton and Hove"))) == ["brighton", "brighton and hove", "hove"]
    assert one(spark, pages.place_aliases(F.lit("County Durham"))) == ["county durham", "durham"]
    assert one(spark, pages.gazetteer_key(F.lit("of London"))) is None and one(spark, pages.gazetteer_key(F.lit("Armagh City, X"))) == "armagh city x"
    assert one(spark, pages.authority_key(F.lit("St. Helens MBC"))) == "st helens" and one(spark, pages.authority_key(F.lit("Durham UA"))) == "county durham"
    assert [one(spark, pages.hotel_chain(F.lit(s))) for s in ("TRAVELODGE X", "BRITANNIA INN", "IBIS TRADING", "IBIS HOTEL", "OTHER")] == ["Travelodge", None, None, "Ibis / Novotel / Mercure (Accor)", None]
    assert [one(spark, pages.sector(F.lit(s))) for s in ("Plymouth City Council", "Kent ICB", "Home Office")] == ["councils", "nhs", "central_gov"]
    g = lambda s: tuple(one(spark, pages.gated_class(F.lit(s), "COUNCIL", ("MODEL COUNCIL",), "BRITISH COUNCIL", [("SCHOOL|BRITISH", "education")])))
    assert [g(s) for s in ("SHOP", "MODEL COUNCIL", "BRITISH COUNCIL", "SCHOOL COUNCIL", "KENT COUNCIL")] == [(None, None), (False, "exact exclusion"), (True, None), (False, "education"), (True, None)]


def test_probes(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/b.csv", "x")
        f.writestr("c.shp", "x")
    files = [("u/a.zip", z.getvalue()), ("u/t.csv", b"id;name\n1;a\n2;b\n"), ("u/g", b'{"type":"FeatureCollection","features":[{"properties":{"p":1}}]}'), ("u/p", b"%PDF-1.7"), ("u/x", b"words"), ("u/bad.zip", b"PK\x03\x04junk"), ("u/e.csv", b""), ("u/l.json", b'{"a":"' + b"x" * 40_000 + b'"}')]
    got = {r["path"]: r for r in probe.probe(spark.createDataFrame([(p, bytearray(b)) for p, b in files], "path string, content binary")).collect()}
    assert (got["u/a.zip"]["kind"], got["u/a.zip"]["format"], got["u/a.zip"]["members"]) == ("zip", "CSV,SHP", ["a/b.csv", "c.shp"])
    assert got["u/t.csv"]["columns"] == ["id", "name"] and got["u/t.csv"]["rows"] == 2 and got["u/g"]["columns"] == ["p"] and got["u/g"]["format"] == "GEOJSON"
    assert got["u/p"]["format"] == "PDF" and got["u/x"]["kind"] == "unknown" and got["u/bad.zip"]["remark"] == "no readable archive" and got["u/e.csv"]["remark"] == "no bytes"
    assert got["u/l.json"]["remark"] == "only the first bytes were read" and got["u/l.json"]["format"] == "JSON"
    cells = lambda x: spark.range(1).select(probe.header_cells(F.lit(x)).alias("c")).first()["c"]
    assert cells("id,name,1\n2") == ["id", "name", "1"] and cells('"a, b",c') == ["a, b", "c"] and cells("1,2,3") is None and cells("one") is None
