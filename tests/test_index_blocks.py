"""The best of an index with blocks equals a whole read, and reads less."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import index as I
from ledgerlark.operators.index import SearchIndex

FIELDS = {"title": 5.0, "body": 1.0}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rng = random.Random(2)
    common = ["water", "road", "the", "of"]
    rows = []
    for i in range(3_000):
        body = [rng.choice(common) for _ in range(rng.choice((3, 10, 40, 200)))] + [f"word{rng.randrange(4000)}" for _ in range(rng.choice((0, 5, 60)))]
        rng.shuffle(body)
        rows.append((i, rng.choice(common) if rng.random() < 0.1 else f"word{rng.randrange(50)}", " ".join(body)))
    rows += [(5_000, None, None), (5_001, "", " !? "), (5_002, "seldom", "seldom water"), (5_003, "Seldom", "x")]
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    SearchIndex.build(spark.createDataFrame(rows, "k long, title string, body string"), "k", FIELDS, path, block=40)
    return SearchIndex(spark, path, "k", FIELDS)


def whole(index, words, rows):
    m = index.matches(words)
    got = m.rows.where(m.any(words)).select("key", m.bm25(words).alias("bm25")).orderBy(F.desc("bm25"), "key").limit(rows)
    return [(r["key"], round(r["bm25"], 9)) for r in got.collect()]


@pytest.mark.parametrize("words", [["water"], ["water", "road"], ["the", "seldom"], ["seldom"], ["water", "road", "the", "of", "word7", "word3999"], ["word7", "word8"], ["absent"], ["absent", "water"], []])
@pytest.mark.parametrize("rows", [1, 10, 100, 100_000])
def test_top_equals_a_whole_read(built, words, rows):
    got = [(r["key"], round(r["bm25"], 9)) for r in built.top(words, rows).collect()]
    assert got == whole(built, words, rows)


def test_many_ranges_are_joined(built, monkeypatch):
    monkeypatch.setattr(I, "RANGES", 0)
    assert [(r["key"], round(r["bm25"], 9)) for r in built.top(["water", "seldom"], 10).collect()] == whole(built, ["water", "seldom"], 10)


def test_most_postings_of_a_common_term_are_not_needed(built):
    terms = [I.term_of("water")]
    found = built.counts(terms)
    assert found[terms[0]]["df"] > 2_500
    weight = {t: I.rarity(built.stats["n"], r["df"]) for t, r in found.items()}
    left = built._left(built._own(terms), terms, [], weight, 10)
    assert left.count() < found[terms[0]]["df"] / 4
    assert "PushedFilters" in (plan := left._jdf.queryExecution().executedPlan().toString()) and "GreaterThanOrEqual(at" in plan


def test_block_maxima_are_true(spark, built):
    rows = built.postings([I.term_of(w) for w in ("water", "road")]).withColumn("w", I._weighed(FIELDS))
    real = rows.groupBy("term", I._block(F.col("at"), built.stats["widths"]).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.max(I.saturation(F.col("w"), F.col("length"), built.stats["mean"])).alias("most"))
    kept = spark.read.parquet(f"{built.path}/blocks").where(F.col("term").isin("water", "road")).select("term", "block", "n", "most")
    pairs = [{(r["term"], r["block"]): (r["n"], round(r["most"], 9)) for r in x.collect()} for x in (real, kept)]
    assert pairs[0] == pairs[1]
    assert reduce(lambda a, b: a + b, (n for n, _ in pairs[0].values())) == rows.count()


def test_files_of_a_folder_hold_ranges_of_places(spark, tmp_path, monkeypatch):
    """A term's block lies in one or two files of its folder, not in all of them."""
    monkeypatch.setattr(I, "FILE_TEXT", 2_000)
    docs = spark.createDataFrame([(i, "water road " * 20) for i in range(400)], "k long, body string")
    SearchIndex.build(docs, "k", {"body": 1.0}, f"file://{tmp_path}/i", block=40)
    every = spark.read.parquet(f"file://{tmp_path}/i/postings").where("term = 'water'").withColumn("file", F.input_file_name())
    ends = sorted((r["lo"], r["hi"]) for r in every.groupBy("file").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).collect())
    assert len(ends) > 3 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_a_build_reads_texts_by_tasks_of_one_size(spark):
    from ledgerlark.session import spread

    rows = spark.range(100).coalesce(1)
    assert spread(rows, 40).rdd.getNumPartitions() == max(40, spark.sparkContext.defaultParallelism)
    assert spread(spark.range(0, 100, 1, 64), 40).rdd.getNumPartitions() == 64


@pytest.mark.parametrize("most", [0, 1 << 26])
def test_blocks_are_the_same_with_common_terms_joined_by_a_shuffle(spark, built, tmp_path, monkeypatch, most):
    monkeypatch.setattr(I, "COMMON_BYTES", most)
    docs = spark.createDataFrame([(i, f"water road word{i % 7}") for i in range(300)], "k long, body string")
    SearchIndex.build(docs, "k", {"body": 1.0}, f"file://{tmp_path}/i", block=40)
    got = spark.read.parquet(f"file://{tmp_path}/i/blocks").groupBy("term").agg(F.sum("n").alias("n")).collect()
    want = {I.term_of(w): n for w, n in [("water", 300), ("road", 300)] + [(f"word{j}", len(range(j, 300, 7))) for j in range(7)] if n > 40}
    assert {r["term"]: r["n"] for r in got} == want
