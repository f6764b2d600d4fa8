"""Entity resolution, state, streaming and spatial operators; every registered query against its oracle."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark import plans, registry  # noqa: F401
from ledgerlark.operators import entity, retrieval, spatial, state, statistics
from ledgerlark.session import TABLES
from ledgerlark.streaming import events, limiter


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = con.sql(registry.ORACLE[name])
    df = registry.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(r.columns)
    want = [tuple(plain(row[r.columns.index(c)]) for c in sorted(r.columns)) for row in r.fetchall()]
    got = [tuple(plain(row[c]) for c in sorted(df.columns)) for row in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


PAIRS = [
    ("data_gov_uk", "Leeds City Council", "leeds", "Leeds", True), ("data_gov_uk", "North Yorkshire", "ns", "North Somerset", False), ("a", "Kent", "b", "kent!", True), ("a", "NBN Atlas", "a", "NBN Atlas", False),
    ("data_gov_uk", "Department for Transport", "tfl", "Transport for London", False), ("data_gov_uk", "OpenDataNI", "daera_ni", "NI Water", True), ("data_gov_uk", "Green Action Trust", "x", "Green Action Trust Scotland", True), ("a", "Leeds Council", "b", "Leeds", False), ("a", None, "b", None, True),
]


@pytest.mark.parametrize("pair", PAIRS)
def test_pairs_merge_both_ways(spark, pair):
    sa, pa, sb, pb, want = pair
    row = lambda s, p: spark.createDataFrame([(s, p, "nbn atlas" if s == "a" else None)], "source_id string, publisher string, source_label string")
    for x, y in ((row(sa, pa), row(sb, pb)), (row(sb, pb), row(sa, pa))):
        assert x.alias("a").join(y.alias("b"), how="cross").select(entity.mergeable("a", "b").alias("m")).first()["m"] is want


def test_clusters_do_not_chain_and_elect(spark):
    rows = [("k1", "Fraud", "bristol", "Bristol City Council"), ("k2", "fraud!", "data_gov_uk", "Bristol"), ("k3", "Fraud", "calder", "Calderdale Council"), ("k4", "Other", "x", "Y")]
    r = spark.createDataFrame([(*x, None) for x in rows], "key string, title string, source_id string, publisher string, source_label string")
    got = {x["key"]: x["cluster"] for x in entity.cluster_titles(r).collect()}
    assert got == {"k1": "k1", "k2": "k1", "k3": "k3", "k4": "k4"}
    e = spark.createDataFrame([("g", "a", "data_gov_uk", 3, "2020", False), ("g", "b", "own", 1, "2019", False), ("g", "c", "own", 9, "2021", True), ("h", "z", "own", 0, None, None), ("h", "y", "own", 0, None, None)], "grp string, key string, source_id string, resource_count int, modified string, retired boolean")
    assert {x["grp"]: x["canonical"] for x in entity.elect(e, "grp").collect()} == {"g": "b", "h": "y"}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 31), 40, 45, 50, 99]], "node long")
    got = {r["node"]: r["component"] for r in entity.components(edges, nodes).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[50] == got[45] == 40 and got[99] == 99


def test_state(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, first int")
    new = spark.createDataFrame([(2, "B", 99), (3, "C", 30)], "k int, v string, first int")
    assert sorted(map(tuple, state.upsert(old, new, ["k"], keep=["first"]).collect())) == [(1, "a", 10), (2, "B", 20), (3, "C", 30)]


def test_limiter_counts_only_accepted(spark):
    assert limiter.accept([0, 1, 2, 61, 61.5, 62.5], __import__("collections").deque(), 2, 60) == [True, True, False, True, True, False]
    rows = spark.createDataFrame([(i, "k", float(t)) for i, t in enumerate([0, 1, 2, 61, 61.5, 62.5])], "event_id long, key string, at double")
    got = {r["event_id"]: r["accepted"] for r in limiter.rate_limit(rows, 2, 60.0).collect()}
    assert [got[i] for i in range(6)] == [True, True, False, True, True, False]


def test_streams_equal_batches(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events.drain(events.hourly(stream, "100000 days"), "hourly_out", "complete")
    key = lambda rows: sorted((str(r["start"]), r["event_type"], r["n"], round(r["total"], 6)) for r in rows)
    assert key(spark.table("hourly_out").collect()) == key(events.hourly(e).collect())
    events.drain(events.once_each(stream.unionByName(stream), late="100000 days"), "once_out")
    assert spark.table("once_out").count() == e.count()
    checks = lambda d: d.select(F.col("user_id").alias("host"), (F.col("event_type") == "purchase").alias("ok"), "ts")
    events.drain(events.host_reach(checks(stream)), "reach_out", "complete")
    assert sorted(map(str, spark.table("reach_out").collect())) == sorted(map(str, events.host_reach(checks(e)).collect()))
    asked = stream.select("event_id", F.col("user_id").cast("string").alias("key"), F.col("value").alias("at"))
    spark.conf.set(*limiter.STATE_STORE)
    events.drain(limiter.rate_limit_stream(asked, 5, 1e9, late="100000 days"), "limit_out")
    spark.conf.unset(limiter.STATE_STORE[0])
    n = spark.table("limit_out").where("accepted").count()
    assert spark.table("limit_out").count() == e.count() and n == e.groupBy("user_id").count().selectExpr("sum(least(count, 5)) s").first()["s"]


def test_spatial(spark):
    g = spark.createDataFrame([("TG 51409 13177",), ("SU42",), ("XX",), (None,)], "r string").select(spatial.grid_reference(F.col("r")).alias("g")).collect()
    assert (g[0]["g"]["e"], g[0]["g"]["n"]) == (651409.5, 313177.5) and (g[1]["g"]["e"], g[1]["g"]["n"]) == (445000.0, 125000.0) and g[2]["g"] is not None and g[3]["g"] is None
    d = spark.range(1).select(spatial.segment_distance(F.lit(0.0), F.lit(3.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("a"), spatial.segment_distance(F.lit(5.0), F.lit(3.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("b")).first()
    assert (d["a"], d["b"]) == (3.0, 5.0)
    hole = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0]]]
    rings = [np.array(r, dtype=float) for r in hole]
    assert spatial.even_odd(np.array([[0.5, 0.5], [2, 2]]), rings).tolist() == [True, False]
    assert spatial.ring_distance(np.array([[0.5, 2.0], [2, 2], [7, 8]]), rings).tolist() == [0.5, 1.0, 5.0]
    p = spark.createDataFrame([(1, 0.5, 2.0), (2, 2.0, 2.0), (3, 5.0, 2.0), (4, 50.0, 2.0), (None, None, 1.0)], "i long, x double, y double")
    shape = spark.createDataFrame([("a", hole)], "code string, rings array<array<array<double>>>")
    assert sorted((r["i"], r["distance"]) for r in spatial.polygon_distances(p, "i", shape, "code", 1.0, 1.5).collect()) == [(1, 0.0), (2, 1.0), (3, 1.0)]
    assert sorted((r["i"], r["distance"]) for r in spatial.polygon_distances(p, "i", shape, "code", 1.0, 1.5, boundary=True).collect()) == [(1, 0.5), (2, 1.0), (3, 1.0)]
    assert [r["i"] for r in spatial.points_in_polygons(p, "i", shape, "code", 1.0).collect()] == [1]


def test_search_is_monotone_under_filters(spark, sf):
    x = registry.QUERIES["rerank_mult"](spark, sf)
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    full = [r["doc_id"] for r in retrieval.page(x, "doc_id", 1000).collect()]
    some = [r["doc_id"] for r in retrieval.page(x.join(langs, "doc_id").where("lang = 'en'"), "doc_id", 1000).collect()]
    assert some == [i for i in full if i in set(some)] and len(some) < len(full)
    first, second = ({r["doc_id"] for r in retrieval.page(x, "doc_id", 5, o).collect()} for o in (0, 5))
    assert not first & second
    assert [retrieval.confidence(*c) for c in ((0.6, True, None), (0.6, True, False), (0.45, True, True), (0.1, True, True), (0.9, False, None))] == ["strong", "weak", "weak", "none", "none"]


def test_average_ranks(spark):
    d = spark.createDataFrame([("g", v) for v in (1, 2, 2, 4)], "g string, v int")
    assert sorted(r[0] for r in d.select(statistics.average_rank(["g"], "v")).collect()) == [1.0, 2.5, 2.5, 4.0]
