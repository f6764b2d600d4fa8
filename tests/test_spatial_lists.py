"""Pairs of near points: places are compared, their points travel as lists, and as many tasks write pairs as there are pairs for."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import spatial

POINTS = "id long, x double, y double"


@pytest.fixture
def small(monkeypatch):
    for name, n in (("LIST_POINTS", 3), ("TASK_PAIRS", 100), ("CELL_TESTS", 20)):
        monkeypatch.setattr(spatial, name, n, raising=False)


def _rows(spark):
    a = [(i, float(i * 37 % 11), float(i * 91 % 7)) for i in range(60)] + [(7, 1.0, 1.0)] * 5 + [(None, 1.0, 1.0), (None, 2.0, 2.0), (99, None, 1.0), (98, float("nan"), 1.0), (97, -0.0, 0.0)]
    b = [(1_000 + i, float(i * 53 % 13), float(i * 17 % 5)) for i in range(40)] + [(None, 1.0, 1.0), (1_099, 1.0, None), (1_098, 0.0, -0.0)]
    return a, b, spark.createDataFrame(a, POINTS).toDF("a", "x", "y"), spark.createDataFrame(b, POINTS).toDF("b", "x", "y")


def test_lists_lose_and_add_no_pair(spark, small):
    a, b, da, db = _rows(spark)
    got = Counter((r["a"], r["b"], round(r["distance"], 9)) for r in spatial.within(da, "a", db, "b", 2.0).collect())
    near = lambda p, q: None not in (*p[1:], *q[1:]) and (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 4
    assert got == Counter((p[0], q[0], round(((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5, 9)) for p in a for q in b if near(p, q))
    assert spatial.within(da.limit(0), "a", db, "b", 2.0).count() == 0


def test_tasks_follow_from_the_pairs(spark, small):
    # Two places with a few points each: a hash of the place would give their pairs to one task or two.
    points = lambda name, n: spark.range(n).select(F.col("id").alias(name), (F.col("id") % 2).cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = spatial.within(points("a", 300), "a", points("b", 40), "b", 5.0)
    made = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in made) == 300 * 40
    assert len(made) > 60 and max(r["count"] for r in made) < 1_000
