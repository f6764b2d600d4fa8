"""Many points at few places: distances are taken between places, not points."""

import json

from pyspark.sql import functions as F

from ledgerlark.operators.spatial import _first_radius, nearest, within


def _points(spark, name, n, many):
    i = F.col("id") % many
    return spark.range(n).select(F.col("id").alias(name), (i * 37 % 100).cast("double").alias("x"), (i * 91 % 100).cast("double").alias("y"))


def test_crowded_places_are_searched_once(spark):
    a, b = _points(spark, "a", 40_000, 50), _points(spark, "b", 20_000, 25)
    got = nearest(a, "a", b, "b", cell=100.0)
    # Every point with every site near it would be 800 million pairs.
    rows = {r["a"]: (r["b"], r["distance"]) for r in got.where("a < 50").collect()}
    sites = {i: (i * 37 % 100, i * 91 % 100) for i in range(25)}
    for k, (s, far) in rows.items():
        x, y = k * 37 % 100, k * 91 % 100
        square, want = min(((x - u) ** 2 + (y - v) ** 2, i) for i, (u, v) in sites.items())
        assert s == want and abs(far**2 - square) < 1e-6
    assert got.count() == 40_000
    assert got.where("b >= 25").count() == 0


def test_a_first_radius_has_few_sites_in_a_cell(spark):
    line = spark.range(4096).select((F.col("id") / 1024.0).alias("x"), F.lit(0.0).alias("y"))
    assert _first_radius(line, 4.0) == 4.0 / 64


def test_pairs_within_follow_from_places(spark):
    a, b = _points(spark, "a", 600, 50), _points(spark, "b", 300, 25)
    got = within(a, "a", b, "b", 30.0)
    at = lambda i, n: ((i % n) * 37 % 100, (i % n) * 91 % 100)
    want = {(i, j) for i in range(600) for j in range(300) if sum((p - q) ** 2 for p, q in zip(at(i, 50), at(j, 25))) <= 900}
    assert {(r["a"], r["b"]) for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan, json.dumps(plan)  # places, each once, before the distances
