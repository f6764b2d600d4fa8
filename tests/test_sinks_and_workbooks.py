"""Workbooks, answers' shapes, and tables that are rebuilt, merged and repaired."""

import io
import zipfile

from pyspark.sql import functions as F

from ledgerlark.operators import sinks
from ledgerlark.sources import shapes, workbooks


def workbook(rows):
    shared, body = [], ""
    for r, row in rows.items():
        body += f'<row r="{r}">'
        for ref, v in row.items():
            if isinstance(v, str):
                shared.append(v)
                body += f'<c r="{ref}{r}" t="s"><v>{len(shared) - 1}</v></c>'
            else:
                body += f'<c r="{ref}{r}"><v>{v}</v></c>'
        body += "</row>"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="One"/></sheets></workbook>')
        f.writestr("xl/sharedStrings.xml", '<sst xmlns="m">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        f.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{body}</sheetData></worksheet>')
    return z.getvalue()


def test_workbooks(spark):
    data = workbook({1: {"B": "Education", "D": "Transport"}, 2: {"A": "Code", "B": "Net", "C": "Gross", "D": "Net"}, 3: {"A": "E1", "B": 5, "C": 7.5, "D": 9}})
    cells = workbooks.read_cells(spark.createDataFrame([("a.xlsx", bytearray(data)), ("b.xlsx", bytearray(b"no"))], "path string, content binary")).cache()
    flat = sorted((r["row"], r["name"], r["value"]) for r in workbooks.flat_table(cells, 2).collect())
    assert flat == [(3, "Code", "E1"), (3, "Gross", "7.5"), (3, "Net", "5"), (3, "Net", "9")]
    two = sorted(((r["upper"], r["lower"], r["value"]) for r in workbooks.two_level_table(cells, 1, 2).collect()), key=str)
    assert two == [("Education", "Gross", "7.5"), ("Education", "Net", "5"), ("Transport", "Net", "9"), (None, "Code", "E1")]
    assert workbooks.column_number("A1") == 0 and workbooks.column_number("AA10") == 26
    h = spark.createDataFrame([("12:30",), ("1 day, 01:00:00",), ("0.5",), ("x",)], "x string").select(workbooks.hours(F.col("x"))).collect()
    assert [r[0] for r in h] == [12.5, 25.0, 12.0, None]


def test_shapes(spark):
    rows = [('{"result":{"count":7,"results":[]}}', "ckan", 7), ('{"dataset":[1,2]}', "dcat", 2), ('{"total_count":3,"results":[1]}', "ods", 3), ('{"total":4,"resources":[]}', "geonode", 4), ("<csw:GetRecordsResponse/>", "csw", None), ("[1,2,3]", "json", 3), ("words", None, None)]
    got = spark.createDataFrame([(r[0], i) for i, r in enumerate(rows)], "x string, i int").orderBy("i").select(shapes.protocol(F.col("x")), shapes.stated_count(F.col("x"))).collect()
    assert [tuple(g) for g in got] == [r[1:] for r in rows]


def test_tables_are_merged_and_rebuilt(spark, tmp_path):
    path = str(tmp_path / "table")
    make = lambda rows: spark.createDataFrame(rows, "url string, status int")
    sinks.upsert_table(spark, path, make([("a", 1), ("b", 2)]), ["url"])
    make([("b", 3), ("c", 4)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, status int").parquet(str(tmp_path / "in"))
    sinks.upsert_batches(stream, path, ["url"], str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_checks_travel_and_are_repaired(spark):
    c = "vantage string, url string, kind string, fetched_at string"
    held, other = spark.createDataFrame([("uk", "u1", "table", "1")], c), spark.createDataFrame([("us", "u1", "json", "2"), ("uk", "u1", "json", "0")], c)
    assert sorted(map(tuple, sinks.import_checks(held, other).collect())) == [("uk", "u1", "table", "1"), ("us", "u1", "json", "2")]
    assert sinks.export_checks(other, "us").count() == 1
    reach = spark.createDataFrame([("h", "uk", 0, 3), ("h", "us", 1, 0), ("g", "uk", 0, 9)], "host string, vantage string, ok long, failed long")
    assert [r["host"] for r in sinks.reachable_elsewhere(reach, "uk").collect()] == ["h"]
    assert sorted(map(tuple, sinks.merge_reach(reach, reach).collect()))[0] == ("g", "uk", 0, 18)
    checks = spark.createDataFrame([("http://h/1", 0), ("http://h/2", 200), ("http://g/1", 0)], "url string, status int")
    assert sorted(r["url"] for r in sinks.repair_checks(checks, spark.createDataFrame([("h",)], "host string")).collect()) == ["http://g/1", "http://h/2"]


def test_availability(spark):
    ds = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0), ("d", 2), ("e", 3)], "key string, resource_count int")
    rs = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("d", "4"), ("d", "5")], "dataset_key string, url string")
    ch = spark.createDataFrame([("1", "dead"), ("2", "data"), ("3", "dead"), ("4", "dead")], "url string, verdict string")
    assert {r["key"]: r["availability"] for r in sinks.availability(ds, rs, ch).collect()} == {"a": "data", "b": "dead", "c": "nofiles", "d": None, "e": None}
