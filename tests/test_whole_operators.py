"""Cases in which less than the whole job was done once."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerlark.operators import entity, spatial


def test_components_of_a_long_chain_are_one(spark):
    names = list(range(300))
    random.Random(0).shuffle(names)
    edges = spark.createDataFrame([*zip(names, names[1:]), (2001, 2002), (2002, 2002), (2003, None)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(300), *range(2001, 2005)]], "node long")
    got = {r["node"]: r["component"] for r in entity.components(edges, nodes).collect()}
    assert got == {**dict.fromkeys(range(300), 0), 2001: 2001, 2002: 2001, 2003: 2003, 2004: 2004}


def test_nearest_finds_far_points_and_says_where_there_is_none(spark):
    a = spark.createDataFrame([(1, 0.5, 0.5), (2, 1e6, -1e6), (3, 3e4, 0.0), (4, None, 1.0), (5, float("nan"), 0.0), (None, 0.0, 5000.0)], "k long, x double, y double")
    b = spark.createDataFrame([(7, 0.0, 0.0), (8, 1.0, 0.0), (9, None, None)], "s long, x double, y double")
    got = {r["k"]: (r["s"], r["distance"] and round(r["distance"], 3)) for r in spatial.nearest(a, "k", b, "s", cell=1.0).collect()}
    assert got == {1: (7, 0.707), 2: (8, 1414212.855), 3: (8, 29999.0), 4: (None, None), 5: (None, None), None: (7, 5000.0)}
    none = spatial.nearest(a, "k", b.where(F.lit(False)), "s", cell=1.0).collect()
    assert sorted(r["k"] or 0 for r in none) == [0, 1, 2, 3, 4, 5] and all(r["s"] is None and r["distance"] is None for r in none)


def plain_merge(a, b):
    """Whether two records of one title may be one, said for values."""
    from ledgerlark.functions import values as V

    key = lambda x: " ".join(re.sub("[^a-z0-9]+", " ", (x or "").lower()).split())
    words = lambda x: set(key(x).split())
    who = lambda x: words(x) - set(V.PUBLISHER_NOISE) - set(V.PLATFORM_WORDS)
    na, nb = key(a["publisher"]), key(b["publisher"])
    if na == nb:
        return not (a["source_id"] == b["source_id"] and na == (a["source_label"] or ""))
    if (a["source_id"] == V.AGGREGATOR) == (b["source_id"] == V.AGGREGATOR):
        return False
    mirrored = b["source_id"] in V.PLATFORM_SOURCES.get(na, ()) or a["source_id"] in V.PLATFORM_SOURCES.get(nb, ())
    wa, wb = who(a["publisher"]), who(b["publisher"])
    least = min(len(wa), len(wb))
    return mirrored or (least > 0 and len(wa & wb) == least and (len(wa) == len(wb) or least >= 2))


def plain_clusters(rows):
    from ledgerlark.functions import values as V

    key = lambda x: " ".join(re.sub("[^a-z0-9]+", " ", (x or "").lower()).split())
    out, blocks = {}, {}
    for r in sorted(rows, key=lambda r: (key(r["publisher"]) in V.PLATFORM_SOURCES, r["key"])):
        home = next((c for c in blocks.setdefault(key(r["title"]), []) if all(plain_merge(m, r) for m in c)), None)
        if home is None:
            blocks[key(r["title"])].append([r])
        else:
            home.append(r)
    for clusters in blocks.values():
        for c in clusters:
            first = c[0]["key"]
            out |= {m["key"]: first for m in c}
    return out


def test_clusters_equal_one_record_at_a_time(spark):
    r = random.Random(6)
    names = ["Leeds City Council", "Leeds", "Kent County Council", "Kent", "OpenDataNI", "Hub", "Greater London Authority", "Kent Hub", "Leeds Open Data", None]
    rows = [{"key": f"k{i:04d}", "title": r.choice(["Spending over 500", "Trees", "Car parks"]), "source_id": r.choice(["data_gov_uk", "own", "hub", "opendatani", "london_datastore"]), "publisher": r.choice(names)} for i in range(300)]
    rows = [x | {"source_label": {"hub": "hub", "own": "leeds"}.get(x["source_id"])} for x in rows]  # a source has one label
    x = spark.createDataFrame([tuple(v.values()) for v in rows], "key string, title string, source_id string, publisher string, source_label string")
    got = {g["key"]: g["cluster"] for g in entity.cluster_titles(x).collect()}
    want = plain_clusters(rows)
    assert {k: (got[k], rows[int(k[1:])]["publisher"]) for k in got} == {k: (want[k], rows[int(k[1:])]["publisher"]) for k in want}


def test_greedy_clusters_query_equals_one_record_at_a_time(spark, sf):
    from ledgerlark import plans, registry  # noqa: F401

    held = {}
    plain = entity.cluster_titles
    entity.cluster_titles = lambda x: plain(held.setdefault("x", x))
    try:
        got = {g["key"]: g["cluster"] for g in registry.QUERIES["greedy_clusters"](spark, sf).collect()}
    finally:
        entity.cluster_titles = plain
    assert got == plain_clusters([g.asDict() for g in held["x"].collect()])


def test_ranks_and_quantiles_of_repeated_values(spark):
    from ledgerlark.operators import ranking

    values = [5] * 400 + list(range(300)) + [None] * 7
    d = spark.createDataFrame([(v,) for v in values], "v int")
    got = sorted(ranking.global_rank(d, "v", "r", rows=50).collect(), key=lambda x: x["r"])
    assert [x["r"] for x in got] == list(range(len(values))) and [x["v"] for x in got] == [None] * 7 + sorted(v for v in values if v is not None)
    assert ranking.quantiles(d, "v", [0.0, 0.25, 0.5, 0.99, 1.0]) == [float(np.quantile([v for v in values if v is not None], s)) for s in (0.0, 0.25, 0.5, 0.99, 1.0)]
    assert ranking.quantiles(d.where("v > 1000"), "v", [0.5]) == []


def test_the_stored_index_ranks_as_a_full_text_engine_does(spark, tmp_path):
    """Against SQLite's index with the same analyser and weights."""
    import sqlite3

    from ledgerlark.operators.index import SearchIndex

    r = random.Random(8)
    words = "flood flooding floods risk risks river rivers café cafe council councils school schooling data table licence licensed".split()
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 5))), " ".join(r.choices(words, k=r.randint(0, 30))) or None) for i in range(200)]
    fields = {"title": 5.0, "body": 1.0}
    path = f"file://{tmp_path}/index"
    SearchIndex.build(spark.createDataFrame([*rows, (None, "no key", "x")], "k long, title string, body string"), "k", fields, path)
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, body, tokenize='porter unicode61')")
    db.executemany("insert into t(rowid, title, body) values (?, ?, ?)", [(i + 1, a, b or "") for i, a, b in rows])
    for asked in (["flooding", "rivers"], ["café"], ["licensing", "data", "nowhere"]):
        m = SearchIndex(spark, path, "k", fields).matches(asked)
        got = {x["key"]: x["s"] for x in m.rows.where(m.any(asked)).select("key", m.bm25(asked).alias("s")).collect()}
        want = {i - 1: -s for i, s in db.execute("select rowid, bm25(t, 5.0, 1.0) from t where t match ?", (" OR ".join(f'"{w}"' for w in asked),))}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_stored_tables_are_built_again_when_their_source_changes(spark, tmp_path):
    from ledgerlark.sources.stored import stored

    src, built = f"file://{tmp_path}/src", []
    spark.range(3).coalesce(1).write.parquet(src)
    build = lambda to: (built.append(to), spark.range(1).write.parquet(to))
    a = stored(spark, "t", spark.read.parquet(src), build, fresh=0)
    assert stored(spark, "t", spark.read.parquet(src), build, fresh=0) == a and len(built) == 1
    spark.range(2).coalesce(1).write.mode("append").parquet(src)
    b = stored(spark, "t", spark.read.parquet(src), build, fresh=0)
    assert b != a and len(built) == 2 and spark.read.parquet(b).count() == 1
    # another source of the same schema is another table, however fresh the first one is
    spark.range(9).coalesce(1).write.parquet(f"{src}2")
    c = stored(spark, "t", spark.read.parquet(f"{src}2"), build)
    assert c not in (a, b) and stored(spark, "t", spark.read.parquet(f"{src}2"), build) == c and len(built) == 3
