"""Functions of single records on set texts: what each must become."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import normalise as N
from ledgerlark.functions import pages as P
from ledgerlark.functions import projection, text
from ledgerlark.operators import entity, probe, spatial
from ledgerlark.sources import shapes

CASES = {}


def cases(name, doc, made, rows, kind="string", out=None):
    CASES[name] = made, rows, kind


joined = lambda c: F.array_join(c, "|")
EXTRAS = "map<string,string>"
PAIRS = "array<struct<key:string,value:string>>"

cases("repair_mojibake", "N-4.", lambda x: text.mojibake()(x), [("Mayor" + "’".encode().decode("cp1252") + "s", "Mayor’s"), ("â€ without a way back Δ", "â€ without a way back Δ"), ("café", "café"), (None, None), ("", "")])
cases("porter_stems", "Q-18.", lambda x: text.stems()(x), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("vietnamization", "vietnam"), ("adoption", "adopt"), ("sky", "sky"), ("by", "by")])
cases("reference_date", "N-9.", N.reference_date, [({"dataset-reference-date": '[{"type":"revision","value":"2001"},{"type":"creation","value":"2005"},{"type":"publication","value":"2004"}]'}, "2004"), ({"dataset-reference-date": "[]"}, None), ({"other": "x"}, None), ({"dataset-reference-date": '[{"type":"creation","value":""}]'}, None)], EXTRAS)
cases("licence_of_extras", "N-11.", N.licence_of_extras, [([("licence_url", "http://l"), ("licence", '["", "OGL"]')], "OGL"), ([("licence_url", "http://l")], "http://l"), ([("topic", "x")], None), ([("License", " cc-by "), ("licence", "later")], "cc-by")], PAIRS)
cases("creative_commons", "N-13, N-14.", N.licence, [("CC BY 4.0", "CC-BY-4.0"), ("cc-by-nc-sa", "CC-BY-NC-SA-4.0"), ("Creative Commons Attribution Share-Alike 3.0", "CC-BY-SA-3.0"), ("https://creativecommons.org/licenses/by-nd/4.0/", "CC-BY-ND-4.0"), ("https://creativecommons.org/publicdomain/zero/1.0/", "CC0-1.0"), ("See creativecommons.org, published by us", "See creativecommons.org, published by us"), ("notspecified", None)])
cases("file_formats", "N-15, N-16.", lambda x: joined(N.file_formats(x)), [(["text/csv", "csv", ".XLSX", None], "CSV|XLSX"), (["Esri REST", "no such format", "NetCDF"], "ESRI-REST|NETCDF"), ([], ""), (["", "pdf"], "PDF")], "array<string>")
cases("plausible_bbox", "N-17.", lambda x: N.plausible_bbox(x["box"], x["who"]).isNotNull(), [(((-6.0, 50.0, 1.0, 52.0), "Kent County Council"), False), (((-6.0, 50.0, 1.0, 52.0), "Natural England"), True), (((-1.0, 50.0, 1.0, 51.0), "Kent County Council"), True), (((-1.0, 50.0, 1.0, 54.0), "Royal Borough"), False), (((-9.0, 50.0, 1.0, 54.0), None), True)], "struct<box:struct<w:double,s:double,e:double,n:double>,who:string>", "BOOLEAN")
cases("polygon_bbox", "N-19.", lambda x: F.concat_ws(",", *(N.polygon_bbox(x)[c].cast("string") for c in "wsen")), [([[50.1, -3.5], [50.2, -3.4], [50.1, -3.4]], "-3.5,50.1,-3.4,50.2"), ([[-3.5, 50.1], [-3.4, 50.2]], "-3.5,50.1,-3.4,50.2"), ([[100.0, 0.5], [101.0, 1.5]], ""), ([[1.0, 51.0]], "")], "array<array<double>>")
cases("dig_path", "N-20.", lambda x: N.dig(x, "a.b"), [('{"a":{"b":1}}', "1"), ('{"a":{"b":"x"}}', "x"), ('{"a":[1]}', None), ("", None), (None, None)])
cases("property_bag", "N-21.", lambda x: F.array_join(F.array_sort(F.transform(F.map_entries(N.bag(x, "key", "value", "shown")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|"), [([("a", "theme:Water", None), ("b", "v", "Seen")], "a=Water|b=Seen"), ([("a", "1", None), ("a", "2", None)], "a=2"), ([("u", "http://x", None), (None, "x", None)], "u=http://x"), ([], "")], "array<struct<key:string,value:string,shown:string>>")
cases("authority_key", "N-27.", P.authority_key, [("St. Helens MBC", "st helens"), ("Durham UA", "county durham"), ("Bath & North East Somerset", "bath and north east somerset"), ("Newcastle", "newcastle upon tyne"), ("King's Lynn-West", "kings lynn west")])
cases("grid_reference", "N-33.", lambda x: F.concat_ws(",", spatial.grid_reference(x)["e"].cast("string"), spatial.grid_reference(x)["n"].cast("string")), [("TG 51409 13177", "651409.5,313177.5"), ("SU42", "445000.0,125000.0"), ("T1", ""), (None, ""), ("tq 30 80", "530500.0,180500.0")])
cases("to_national_grid", "N-34.", lambda x: F.concat_ws(",", F.round(projection.project(F.radians(x["lat"]), F.radians(x["lon"]))["e"], 2).cast("string"), F.round(projection.project(F.radians(x["lat"]), F.radians(x["lon"]))["n"], 2).cast("string")), [((52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600), "651409.9,313177.27"), ((49.0, -2.0), "400000.0,-100000.0")], "struct<lat:double,lon:double>")
cases("segment_distance", "N-36.", lambda x: F.round(spatial.segment_distance(x["x"], x["y"], F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), 6), [((0.0, 3.0), 3.0), ((4.0, 4.0), 5.0), ((-1.0, -2.0), 2.0), ((0.5, 0.0), 0.0)], "struct<x:double,y:double>", "DOUBLE")
cases("sector_of", "N-38.", P.sector, [("Plymouth City Council", "councils"), ("Kent ICB", "nhs"), ("Home Office", "central_gov"), ("Transport for Greater Manchester", "other_local")])
cases("public_body", "N-39.", lambda x: F.concat_ws(":", P.gated_class(x, "COUNCIL", ("MODEL COUNCIL",), "BRITISH COUNCIL", [("SCHOOL|BRITISH", "education")])["included"].cast("string"), P.gated_class(x, "COUNCIL", ("MODEL COUNCIL",), "BRITISH COUNCIL", [("SCHOOL|BRITISH", "education")])["reason"]), [("SHOP", ""), ("MODEL COUNCIL", "false:exact exclusion"), ("BRITISH COUNCIL", "true"), ("SCHOOL COUNCIL", "false:education"), ("KENT COUNCIL", "true")])
cases("hotel_chain", "N-40.", P.hotel_chain, [("TRAVELODGE X", "Travelodge"), ("BRITANNIA INN", None), ("IBIS TRADING", None), ("IBIS HOTEL", "Ibis / Novotel / Mercure (Accor)"), ("WHITBREAD PLC", "Premier Inn / Whitbread")])
cases("meta_description", "N-42.", lambda x: P.meta_description(x["d"], x["t"], x["p"], F.lit(None).cast("string"), F.lit(2), F.array(F.lit("CSV"), F.lit(""))), [((None, "T", "P"), "T — open data published by P. 2 file(s), CSV. The publisher gives no description."), (("<p>Words of it.</p>", "T", "P"), "Words of it."), (("", None, None), "Dataset — open data. 2 file(s), CSV. The publisher gives no description.")], "struct<d:string,t:string,p:string>")
cases("escapes", "N-45.", lambda x: F.concat_ws(" ", P.path_part(x), P.escape_html(x), P.safe_url(x)), [("a b/é", "a%20b%2F%C3%A9 a b/é"), ("<a href='x'>&", "%3Ca%20href%3D%27x%27%3E%26 &lt;a href=&#x27;x&#x27;&gt;&amp;"), ("http://x", "http%3A%2F%2Fx http://x http://x")])
cases("place_aliases", "N-49.", lambda x: joined(P.place_aliases(x)), [("Brighton and Hove", "brighton|brighton and hove|hove"), ("County Durham", "county durham|durham"), ("Bristol, City of", "bristol|bristol of|bristol, city of"), ("The Vale", "the vale|vale"), ("Bath and North East Somerset", "bath|bath and north east somerset"), ("City of London", "city of london|london|of london")])
cases("header_peek", "S-26.", lambda x: joined(probe.header_cells(x)), [("id,name,1\n2", "id|name|1"), ('"a, b",c', "a, b|c"), ("1,2,3", None), ("one", None), ("", None), ("﻿a,b\r\nc,d", "a|b")])
cases("answer_shape", "S-32.", lambda x: F.concat_ws(":", shapes.protocol(x), shapes.stated_count(x).cast("string")), [('{"result":{"count":7,"results":[]}}', "ckan:7"), ('{"dataset":[1,2]}', "dcat:2"), ('{"total_count":3,"results":[1]}', "ods:3"), ('{"total":4,"resources":[]}', "geonode:4"), ("[1,2,3]", "json:3")])
cases("platform_labels", "X-7.", lambda x: joined(entity.platform(x)), [("OpenDataNI", "opendatani|daera_ni|agol_daera_agol|causeway_coast|mid_ulster"), ("Greater London Authority", "london_datastore"), ("Kent County Council", ""), (None, "")])
cases("retired_text", "P-3.", P.retired, [("NB: This dataset has been withdrawn.", True), ("Fresh counts.", False), (None, False)])


@pytest.mark.parametrize("name", CASES)
def test_set_texts(spark, name):
    made, rows, kind = CASES[name]
    frame = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], f"i int, x {kind}")
    got = [r["y"] for r in frame.select("i", made(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [y for _, y in rows]
