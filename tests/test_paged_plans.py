"""Plans of large portals: the number of tasks is bounded, and lost pages are never landed."""

from pyspark.sql import functions as F

from ledgerlark.sources import paged as P


def test_a_large_portal_has_long_tasks_and_not_more_of_them():
    source = P.Source.of({"id": "a", "api": "file:///none", "rows": 50})
    small, large = P._tasks(source, 0, 5_000, 0, False), P._tasks(source, 0, 7_200_000, 0, False)
    assert [len(t.starts) for t in small] == [8] * 12 + [4]
    assert len(large) <= P.MOST_TASKS
    assert [s for t in large for s in t.starts] == list(range(0, 7_200_000, 50))
    assert len(P._tasks(source, 0, 5_000, 3, False)) == 34


def test_lost_pages_count_in_the_total(spark, tmp_path):
    records = spark.range(100).select(F.col("id").alias("k"))
    wrap = lambda n, r: F.concat(F.lit('{"result":{"count":'), n.cast("string"), F.lit(',"results":['), r, F.lit("]}}"))
    P.land_pages(records, "k", F.to_json(F.struct("k")), f"file://{tmp_path}/p", 10, wrap, F.col("start") / 10 % 4 == 1)
    assert len(list(tmp_path.glob("p/start=*"))) == 7 and not list(tmp_path.glob("p/_temporary*"))
    rows = P.read_paged(spark, [{"id": "p", "api": f"file://{tmp_path}/p", "protocol": "ckan", "address": P.LANDED, "rows": 10}], retries=1)
    assert P.harvest_runs(rows).first().asDict() == {"source": "p", "total": 100, "stored": 70, "errors": 3, "abandoned": True}


def test_pages_are_landed_by_as_many_tasks_as_there_are_cores_or_more(spark, tmp_path):
    assert [P.landing_tasks(n, 50, 12) for n in (0, 40, 200, 20_000, 7_200_000)] == [1, 1, 4, 12, 562]
    wrap = lambda n, r: F.concat(F.lit("["), r, F.lit("]"))
    pages = lambda: sorted((f.parent.name, f.name, f.read_text()) for f in tmp_path.glob("p/*/*"))
    records = spark.range(25).select(F.col("id").alias("k"))
    P.land_pages(records, "k", F.col("k").cast("string"), f"file://{tmp_path}/p", 10, wrap)
    first = pages()
    assert [p[:2] for p in first] == [(f"start={s}", "page.json") for s in (0, 10, 20)] and first[2][2].strip() == "[20,21,22,23,24]"
    P.land_pages(records, "k", F.col("k").cast("string"), f"file://{tmp_path}/p", 10, wrap)
    assert pages() == first
