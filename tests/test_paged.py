"""The paged data source against a server on this machine, and landed pages."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from ledgerlark.sources import paged as P


class Portal(BaseHTTPRequestHandler):
    """/<name>/package_search and so on over ``data``; ``bad`` starts fail always, ``shaky`` ones the first two times."""

    data: dict = {}
    bad: set = set()
    shaky: Counter = Counter()
    cap = 1000
    asked: Counter = Counter()

    def log_message(self, *_):
        pass

    def do_GET(self):
        url = urlparse(self.path)
        name, q = url.path.split("/")[1], {k: v[0] for k, v in parse_qs(url.query).items()}
        rows = min(self.cap, int(q.get("rows", q.get("limit", q.get("page_size", q.get("resultRecordCount", q.get("maxRecords", 10)))))))
        start = int(q["start"]) if "start" in q else int(q["offset"]) if "offset" in q else (int(q["page"]) - 1) * rows if "page" in q else int(q["startPosition"]) - 1 if "startPosition" in q else int(q.get("resultOffset", 0))
        self.asked[name, start] += 1
        every = self.data[name]
        own = every[start : start + rows]
        if (name, start) in self.bad or self.shaky[name, start] > 0:
            self.shaky[name, start] -= 1
            self.send_response(500)
            self.end_headers()
            return
        if "page" in q and start and not own:
            self.send_response(404)
            self.end_headers()
            return
        if "startPosition" in q:
            body = f'<r xmlns="http://x"><s numberOfRecordsMatched="{len(every)}"/>' + "".join(f'<Record xmlns="http://y"><id>{r["id"]}</id></Record>' for r in own) + "</r>"
        elif "resultOffset" in q:
            body = json.dumps({"features": own})
        elif "page" in q:
            body = json.dumps({"total": len(every) + 5, "resources": own})
        elif "offset" in q:
            body = json.dumps({"total_count": len(every), "results": own})
        else:
            body = json.dumps({"result": {"count": len(every), "results" if name != "nested" else "result": own}})
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())


@pytest.fixture
def portal():
    Portal.data, Portal.bad, Portal.shaky, Portal.cap, Portal.asked = {}, set(), Counter(), 1000, Counter()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Portal)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def records(n):
    return [{"id": f"é{i}", "title": f"Record {i}"} for i in range(n)]


def ids(rows):
    return sorted((r["source"], r["place"], json.loads(r["record"])["id"]) for r in rows.where("record is not null").collect())


def test_every_protocol_reads_all_records_once(spark, portal):
    Portal.data = {"a": records(1203), "nested": records(7), "o": records(230), "g": records(400), "arc": records(2500), "empty": []}
    sources = [{"id": n, "api": f"{portal}/{n}", "protocol": p} for n, p in (("a", "ckan"), ("nested", "ckan"), ("o", "ods"), ("g", "geonode"), ("arc", "arcgis"), ("empty", "ckan"))]
    rows = P.read_paged(spark, sources, pause=0, pages_of_task=2)
    got = ids(rows)
    assert got == sorted((n, i, f"é{i}") for n, own in Portal.data.items() for i in range(len(own)))
    assert rows.where("error is not null").count() == 0
    runs = {r["source"]: (r["total"], r["stored"], r["errors"], r["abandoned"]) for r in P.harvest_runs(rows).collect()}
    assert runs["a"] == (1203, 1203, 0, False) and runs["empty"] == (0, 0, 0, False) and runs["arc"][0] is None


def test_csw_records(spark, portal):
    Portal.data = {"c": records(250)}
    rows = P.read_paged(spark, [{"id": "c", "api": f"{portal}/c", "protocol": "csw"}], pause=0)
    assert rows.where("record like '%<%Record%'").select("place").distinct().count() == 250


def test_a_server_that_gives_shorter_pages_than_asked(spark, portal):
    Portal.data, Portal.cap = {"a": records(333)}, 100
    assert len(ids(P.read_paged(spark, [{"id": "a", "api": f"{portal}/a", "protocol": "ckan"}], pause=0))) == 333


def test_failing_pages_leave_the_others_and_are_read_again(spark, portal):
    Portal.data = {"a": records(1000), "b": records(30)}
    Portal.bad = {("a", 200), ("a", 900)}
    Portal.shaky = Counter({("a", 300): 2})
    sources = [{"id": n, "api": f"{portal}/{n}", "protocol": "ckan", "rows": 100} for n in "ab"]
    rows = P.read_paged(spark, sources, pause=0)
    assert [r["start"] for r in rows.where("error is not null").orderBy("start").collect()] == [200, 900]
    assert rows.where("record is not null").count() == 830
    runs = {r["source"]: (r["stored"], r["errors"], r["abandoned"]) for r in P.harvest_runs(rows).collect()}
    assert runs == {"a": (800, 2, False), "b": (30, 0, False)}
    again = P.failed_pages(rows, sources)
    Portal.bad = set()
    more = P.read_paged(spark, again, pause=0)
    assert ids(more) == sorted(("a", i, f"é{i}") for i in [*range(200, 300), *range(900, 1000)])


def test_a_source_that_does_not_answer_is_one_error(spark, portal):
    Portal.data = {"a": records(5)}
    rows = P.read_paged(spark, [{"id": "a", "api": f"{portal}/a", "protocol": "ckan"}, {"id": "dead", "api": "http://127.0.0.1:9/none", "protocol": "ods"}], retries=1, timeout=2)
    assert {(r["source"], r["error"] is None) for r in rows.collect()} == {("a", True), ("dead", False)}


def test_limit(spark, portal):
    Portal.data = {"a": records(950)}
    assert len(ids(P.read_paged(spark, [{"id": "a", "api": f"{portal}/a", "protocol": "ckan", "rows": 100}], pause=0, limit=250))) == 250


def test_stream_takes_what_was_added_and_restarts_repeat_nothing(spark, portal, tmp_path):
    sources = [{"id": n, "api": f"{portal}/{n}", "protocol": "ckan", "rows": 40} for n in "ab"]
    Portal.data = {"a": [], "b": records(5)}
    for a, b in ((95, 5), (95, 5), (130, 90)):
        Portal.data = {"a": records(a), "b": records(b)}
        q = P.stream_paged(spark, sources, pause=0).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.schema(P.SCHEMA).parquet(f"{tmp_path}/out")
        assert ids(rows) == sorted((n, i, f"é{i}") for n, m in (("a", a), ("b", b)) for i in range(m))
    batch = P.read_paged(spark, sources, pause=0)
    assert ids(batch) == ids(rows)


def test_landed_pages(spark, tmp_path):
    df = spark.range(105).select("id", F.concat(F.lit("r"), F.col("id").cast("string")).alias("v"))
    P.land_pages(df, "id", F.to_json(F.struct(F.col("v").alias("id"))), f"file://{tmp_path}/p", 10, lambda n, r: F.concat(F.lit('{"result":{"count":'), n.cast("string"), F.lit(',"results":['), r, F.lit("]}}")))
    rows = P.read_paged(spark, [{"id": "x", "api": f"file://{tmp_path}/p", "protocol": "ckan", "address": P.LANDED, "rows": 10}])
    assert ids(rows) == sorted(("x", i, f"r{i}") for i in range(105))
