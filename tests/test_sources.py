"""Landed payloads of every protocol, and ledger files."""

import json

from ledgerlark.operators import ledger
from ledgerlark.sources import catalogue as c

SRC = c.Source("src", "The Source", "https://w.example", "https://w.example/dataset/{name}")


def records(spark, tmp_path, schema, rows):
    path = tmp_path / "rows.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return c.read_records(spark, str(path), schema)


def test_ckan(spark, tmp_path):
    rows = [
        {"id": "1", "name": "air", "title": "Air", "notes": "<b>x</b>", "organization": {"title": "Kent County Council"}, "license_id": "", "license_title": None, "metadata_created": "2020-01-01", "metadata_modified": "18:15", "tags": [{"name": "a"}, {"name": "A"}, {"name": ""}],
         "extras": [{"key": "licence", "value": "uk-ogl"}, {"key": "frequency-of-update", "value": "annually"}], "resources": [{"url": "http://x/1", "name": "one", "format": "CSV"}, {"url": "http://x/1", "name": "again", "format": "csv"}, {"url": "ftp://x", "name": "no", "format": None}]},
        {"id": "2", "title": "{{name}}"},
    ]
    got = c.ckan(records(spark, tmp_path, c.CKAN, rows), SRC, 2026).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["key"], r["license_raw"], r["license_norm"], r["created"], r["modified"], r["tags"], r["formats_norm"], r["resource_count"]) == ("src:1", "uk-ogl", "OGL-UK-3.0", "2020-01-01", None, ["a"], ["CSV"], 3)
    assert [(x["url"], x["name"], x["format_norm"]) for x in r["resources"]] == [("http://x/1", "one", "CSV")] and r["landing_url"] == "https://w.example/dataset/air"


def test_dcat_and_collisions(spark, tmp_path):
    d = lambda u: {"title": "Web Page", "format": "HTML", "accessURL": u}
    rows = [
        {"title": "One", "publisher": {"name": "data.example.org"}, "contactPoint": {"fn": "Fife Council"}, "distribution": [{"title": "f", "downloadURL": "http://x/f.csv", "mediaType": "text/csv"}, d("http://x/page/")], "keyword": ["k"], "license": "<a>OGL</a>"},
        {"title": "Two", "publisher": {"name": "{{source}}"}}, {"title": "Two", "publisher": {"name": ""}, "distribution": [{"downloadURL": "http://y"}]}, {"title": "Two", "distribution": [{"downloadURL": "http://y"}]},
    ]
    out = c.dcat(records(spark, tmp_path, c.DCAT, rows[:1]), SRC, 2026).first()
    assert (out["ckan_id"], out["name"], out["publisher"], out["landing_url"], out["license_norm"], out["formats_norm"]) == ("http://x/page/", "page", "Fife Council", "http://x/page/", "OGL-UK-3.0", ["CSV", "HTML"])
    from pyspark.sql import functions as F

    two = c.dcat(records(spark, tmp_path, c.DCAT, [{**r, "identifier": "same"} for r in rows[1:]]), SRC, 2026)
    keys = [r["key"] for r in c.salt_collisions(two, F.coalesce(F.size("resources"), F.lit(0))).orderBy("key").collect()]
    assert keys[0] == "src:same" and len(set(keys)) == 3 and keys[1].startswith("src:same~")
    seed = c.dcat(records(spark, tmp_path, c.DCAT, rows[1:2]), SRC, 2026).first()
    assert seed["ckan_id"].startswith("sha1:") and seed["landing_url"] is None


def test_ods_geonode_csw_and_bespoke(spark, tmp_path):
    o = c.ods(records(spark, tmp_path, c.ODS, [{"dataset_id": "d", "has_records": True, "metas": {"default": {"title": "T rows", "keyword": ["a"], "theme": ["b"], "geometry_types": ["Point"], "license": "x", "license_url": None}}}, {"dataset_id": "e", "has_records": False, "metas": {"default": {"title": "No rows"}}}]), SRC, 2026).orderBy("key").collect()
    assert o[0]["formats_norm"] == ["CSV", "JSON", "GEOJSON"] and o[0]["tags"] == ["a", "b"] and o[0]["publisher"] == "The Source" and o[0]["resources"][0]["url"].endswith("/datasets/d/exports/csv") and o[1]["resource_count"] == 0
    ring = [[[50.1, -3.5], [50.2, -3.4], [50.1, -3.4], [50.1, -3.5]]]
    g = c.geonode(records(spark, tmp_path, c.GEONODE, [{"pk": "7", "title": "Layer", "alternate": "geonode:l", "workspace": "inspire-nrw-x", "license": {"identifier": "not_specified"}, "keywords": [{"name": "k"}], "category": {"identifier": "c"}, "ll_bbox_polygon": {"coordinates": ring}}]), SRC, 2026).first()
    assert (g["ckan_id"], g["publisher"], g["license_norm"], g["tags"], g["resource_count"]) == ("7", "Natural Resources Wales", None, ["k", "c"], 4) and tuple(g["bbox"]) == (-3.5, 50.1, -3.4, 50.2)
    x = tmp_path / "csw.xml"
    x.write_text('<r xmlns:csw="a" xmlns:dc="b" xmlns:dct="d"><csw:Record><dc:identifier>i1</dc:identifier><dc:title>Rivers</dc:title><dc:rights>otherRestrictions</dc:rights><dc:subject>s</dc:subject><dct:abstract>About</dct:abstract><dc:URI>http://u</dc:URI><dc:URI>ftp://v</dc:URI><dct:modified>2020-01-02</dct:modified></csw:Record></r>')
    w = c.csw(c.read_csw(spark, str(x)), c.Source("src", "The Source", "https://w"), 2026).first()
    assert (w["ckan_id"], w["license_norm"], w["landing_url"], w["tags"], w["resource_count"], w["modified"], w["description"]) == ("i1", None, "http://u", ["s"], 1, "2020-01-02", "About")
    cfg = {"id": "meta.id", "title": "t", "description": "d", "license": "lic", "tags": ["tags", "one"], "resources": [["links.csv", "=CSV"], ["links.none", "fmt"]], "landing": "https://b/{id}"}
    rec = [(json.dumps({"meta": {"id": 5}, "t": "Bespoke", "lic": "Other", "tags": ["x", "y"], "one": "z", "links": {"csv": "http://f"}}),)]
    b = c.bespoke(spark.createDataFrame(rec, "value string"), c.Source("b", "B", "https://b", fields=cfg), 2026).first()
    assert (b["key"], b["license_norm"], b["tags"], b["formats_norm"], b["landing_url"]) == ("b:5", None, ["x", "y", "z"], ["CSV"], "https://b/5")


def test_pages_with_a_list(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"result": {"results": [{"id": "1", "title": "Abc"}, {"id": "2", "title": "Def"}]}}, indent=1))  # of many lines
    assert [r["key"] for r in c.ckan(c.read_records(spark, str(p), c.CKAN, "result.results"), SRC, 2026).orderBy("key").collect()] == ["src:1", "src:2"]


def test_ledger_files(spark):
    one = "Council spend,,,\nSupplier Name,Net Amount,Payment Date,Ref\nAcme Ltd,\"1,000.50\",25/12/2020,1\nBeta,(20.00),26/12/2020,2\n,1961.00,,\n"
    two = one.replace(",Ref", ",Ref").encode("utf-16")
    files = [("a.csv", one.encode()), ("b.csv", two), ("c.pdf", b"%PDF-1"), ("d.csv", b""), ("e.csv", b"x\ny\n"), ("f.csv", "Supplier,Amount,Date\nCaf\xe9,5,2020-01-01\n".encode("cp1252"))]
    raw = ledger.read_ledgers(spark.createDataFrame([(p, bytearray(b)) for p, b in files], "path string, content binary")).cache()
    status = {r["file"]: r["status"] for r in raw.collect()}
    assert status == {"a.csv": "parsed", "b.csv": "parsed", "c.pdf": "not-csv-pdf", "d.csv": "empty", "e.csv": "no-header", "f.csv": "parsed"}
    rows = {(r["file"], r["supplier_raw"]): r for r in ledger.transactions(raw).collect()}
    assert rows["a.csv", "Acme Ltd"]["amount"] == 1000.5 and str(rows["a.csv", "Acme Ltd"]["day"]) == "2020-12-25" and rows["a.csv", "Beta"]["amount"] == -20.0
    assert ("a.csv", "") not in rows or rows["a.csv", ""]["amount"] == 1961.0
    assert rows["a.csv", "Acme Ltd"]["is_dup"] == 0 and rows["b.csv", "Acme Ltd"]["is_dup"] == 1 and ("f.csv", "Café") in rows


def test_header_and_roles():
    assert ledger.find_header(["title", "Date;Vendor;Total amount", "x"]) == (1, ";")
    pick = lambda header, *rows: ledger.pick_roles(header.split(","), [r.split(",") for r in rows])
    assert pick("Total,Net Amount,Supplier,Date", "5,6,x,y")["amount"] == 1
    # better names first, then equal cells; numbers decide between amounts
    assert pick("Invoice Amount,Amount,Vendor", "1,2,x")["amount"] == 0 and pick("Amount,Total,Supplier", "0050037090,1.50,x")["amount"] == 1
    assert pick("Organisation Name,Amount", "x,1").get("supplier") is None and pick("Name,Amount", "x,1")["supplier"] == 0
    assert pick("Supplier,£,Category", "x,1.50,a", "y,2.50,b", "z,3.00,c") == {"supplier": 0, "amount": 1, "expense_type": 2}
    assert pick("Payment Date,Supplier Name,Description,Service Area,Amount,Invoice No", "a,b,c,d,1,e") == {"date": 0, "supplier": 1, "expense_type": 2, "expense_area": 3, "amount": 4, "txn": 5}
    assert ledger.sniff(b"PK\x03\x04") == "xlsx-zip" and ledger.sniff(b"  <html>") == "html-or-xml"
