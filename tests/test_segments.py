"""A growing index after any batches equals one built anew; only touched segments are written."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators.index import SearchIndex, term_of
from ledgerlark.operators.segments import GrowingIndex, stream_into

FIELDS = {"title": 3.0, "body": 1.0}
WORDS = ["water", "roads", "maps", "of", "spending", "word3"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, title string, body string")


def text(rng):
    return " ".join(rng.choice([*WORDS, f"word{rng.randrange(60)}"]) for _ in range(rng.randrange(1, 30)))


def equals_fresh(spark, index, now, tmp_path):
    path = f"file://{tmp_path}/fresh-{uuid.uuid4().hex}"
    SearchIndex.build(frame(spark, [(k, *v) for k, v in now.items()]), "k", FIELDS, path)
    fresh = SearchIndex(spark, path, "k", FIELDS)
    for words in (WORDS, ["water"], ["word3", "absent"]):
        got, want = ([(r["key"], round(r["bm25"], 9)) for r in x.top(words, 1000).orderBy("key").collect()] for x in (index, fresh))
        assert got == want
    terms = [term_of(w) for w in WORDS]
    key = lambda df: sorted((r["key"], r["term"], tuple(r["tf"]), r["length"]) for r in df.collect())
    assert key(index.postings(terms)) == key(fresh.postings(terms))
    v = index.version()
    assert sum(x[0] for x in v.segments.values()) == len(now)


def test_batches_equal_a_fresh_build(spark, tmp_path):
    rng = random.Random(6)
    index = GrowingIndex(spark, f"file://{tmp_path}/grow", "k", FIELDS)
    assert index.top(["water"]).collect() == [] and index.version().number == 0
    now = {i: (text(rng), text(rng)) for i in range(120)}
    now[900] = (None, "")
    index.apply(frame(spark, [(k, *v) for k, v in now.items()] + [(None, "no key", "water")]))
    equals_fresh(spark, index, now, tmp_path)
    first = set(index.version().segments)
    new = {i: (text(rng), text(rng)) for i in (3, 4, 5, 200, 201)}
    v = index.apply(frame(spark, [(k, *x) for k, x in new.items()]), spark.createDataFrame([(7,), (8,), (5_000,), (None,)], "k long"))
    now |= new
    del now[7], now[8]
    equals_fresh(spark, index, now, tmp_path)
    assert first < set(v.segments) and len(v.written) == 1 and v.segments[next(iter(first))][2] == 5
    # the same again changes nothing that can be seen
    index.apply(frame(spark, [(k, *x) for k, x in new.items()] * 2), spark.createDataFrame([(7,)], "k long"))
    equals_fresh(spark, index, now, tmp_path)
    # a record that was deleted comes back, one that is changed and deleted goes
    back = {7: ("water", "water roads"), 3: ("x", "y")}
    index.apply(frame(spark, [(k, *x) for k, x in back.items()]), spark.createDataFrame([(3,)], "k long"))
    now[7] = back[7]
    del now[3]
    equals_fresh(spark, index, now, tmp_path)
    index.apply(None, spark.createDataFrame([(k,) for k in now], "k long"))
    assert index.top(WORDS).collect() == [] and index.version().segments == {}


def test_merges_leave_few_segments_and_old_readers_whole(spark, tmp_path):
    rng = random.Random(7)
    index = GrowingIndex(spark, f"file://{tmp_path}/grow", "k", FIELDS, fan=3)
    now = {}
    held = None
    for n in range(7):
        new = {n * 10 + i: (text(rng), text(rng)) for i in range(9)}
        v = index.apply(frame(spark, [(k, *x) for k, x in new.items()]))
        now |= new
        if n == 1:
            held = v, sorted((r["key"], r["term"]) for r in index.postings(["water"], v).collect())
    v = index.version()
    assert len(v.segments) <= 3 and v.number > 7
    equals_fresh(spark, index, now, tmp_path)
    # a reader that holds an older version still reads it whole, until what it names is removed
    assert sorted((r["key"], r["term"]) for r in index.postings(["water"], held[0]).collect()) == held[1]
    gone = index.vacuum()
    assert gone and not set(gone) & set(v.segments)
    equals_fresh(spark, index, now, tmp_path)


def test_half_dead_segments_are_written_anew(spark, tmp_path):
    index = GrowingIndex(spark, f"file://{tmp_path}/grow", "k", FIELDS)
    index.apply(frame(spark, [(i, "water", "maps") for i in range(10)]))
    v = index.apply(None, spark.createDataFrame([(i,) for i in range(6)], "k long"))
    assert [x for x in v.segments.values()] == [[4, 8, 0]]


def test_two_writers_of_one_version(spark, tmp_path):
    index = GrowingIndex(spark, f"file://{tmp_path}/grow", "k", FIELDS)
    index.apply(frame(spark, [(1, "water", "maps")]))
    with pytest.raises(RuntimeError, match="written by another"):
        index._put(index.version())


def test_stream_of_changes(spark, tmp_path):
    src = f"{tmp_path}/in"
    index = GrowingIndex(spark, f"file://{tmp_path}/grow", "k", FIELDS)
    rows = [[(1, "water", "a", False), (2, "water", "b", None)], [(2, None, None, True), (3, "roads", "water", False)]]
    for batch in rows:
        spark.createDataFrame(batch, "k long, title string, body string, deleted boolean").coalesce(1).write.mode("append").parquet(src)
        stream_into(index, spark.readStream.schema("k long, title string, body string, deleted boolean").parquet(src), f"{tmp_path}/ck").awaitTermination()
    assert sorted(r["key"] for r in index.top(["water"]).collect()) == [1, 3]
    assert index.postings([term_of("water")]).agg(F.count("*")).first()[0] == 2


def test_a_large_segment_is_written_by_more_tasks_than_folders(spark, tmp_path, monkeypatch):
    from ledgerlark.operators import segments as S

    assert [S.tasks_of(n) for n in (0, 1, 1 << 25, 1 << 30, 6 << 30)] == [(1, 1), (1, 1), (4, 1), (64, 2), (224, 7)]
    monkeypatch.setattr(S.I, "FILE_TEXT", 2_000)
    grow = S.GrowingIndex(spark, f"file://{tmp_path}/g", "k", {"body": 1.0})
    grow.apply(spark.createDataFrame([(i, "water road " * 20) for i in range(400)], "k long, body string"))
    files = list(tmp_path.glob("g/postings/segment=*/folder=*/*.parquet"))
    assert len(files) > len({f.parent for f in files})


def test_all_records_are_not_sorted_by_one_task(spark, tmp_path):
    from ledgerlark.operators import segments as S

    grow = S.GrowingIndex(spark, f"file://{tmp_path}/g", "k", {"body": 1.0})
    grow.apply(spark.createDataFrame([(i, "water " * (i % 7 + 1) + "road") for i in range(50)], "k long, body string"))
    every, few = grow.top(["water"], 2_000_000_000), grow.top(["water"], 5)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan(few) and "TakeOrdered" not in plan(every) and "Limit" not in plan(every)
    assert len(every.collect()) == 50 and every.collect()[:5] == few.collect()
