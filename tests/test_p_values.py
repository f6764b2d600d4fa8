"""The incomplete beta function and p-values against numbers worked out by integration and known tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import statistics as S


def by_integral(a, b, x):
    """Gauss-Legendre after a change of variable that takes both ends' roots away."""
    nodes, weights = np.polynomial.legendre.leggauss(200)
    top = math.asin(math.sqrt(x))
    t = (nodes + 1) / 2 * top
    whole = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return float(math.exp(whole) * (weights * 2 * np.sin(t) ** (2 * a - 1) * np.cos(t) ** (2 * b - 1)).sum() * top / 2)


def test_incomplete_beta(spark):
    rows = [(a, b, x) for a in (0.5, 1.0, 2.5, 10.0, 60.0) for b in (0.5, 1.0, 3.0, 40.0) for x in (0.0, 0.001, 0.2, 0.5, 0.77, 0.999, 1.0)]
    got = spark.createDataFrame(rows, "a double, b double, x double").select("*", S.incomplete_beta(F.col("a"), F.col("b"), F.col("x")).alias("y")).collect()
    for r in got:
        assert r["y"] == pytest.approx(by_integral(r["a"], r["b"], r["x"]) if 0 < r["x"] < 1 else r["x"], abs=1e-10)


def test_log_gamma(spark):
    rows = [(x,) for x in (0.1, 0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 1e5)]
    for r in spark.createDataFrame(rows, "x double").select("x", S.log_gamma(F.col("x")).alias("y")).collect():
        assert r["y"] == pytest.approx(math.lgamma(r["x"]), abs=1e-12, rel=1e-13)


def test_tabled_p_values(spark):
    # Two-sided 5 % and 1 % points of Student's t with 8 and 20 degrees of freedom, as correlations.
    rows = []
    for freedom, t, p in ((8, 2.306004135, 0.05), (8, 3.355387331, 0.01), (20, 2.085963447, 0.05), (20, 2.845339710, 0.01), (1, 12.70620474, 0.05)):
        rows.append((t / math.sqrt(freedom + t * t), freedom + 2, p))
    rows += [(0.0, 30, 1.0), (1.0, 10, 0.0), (-1.0, 10, 0.0)]
    for r in spark.createDataFrame(rows, "rho double, n long, p double").select("p", S.correlation_p(F.col("rho"), F.col("n")).alias("y")).collect():
        assert r["y"] == pytest.approx(r["p"], abs=1e-9)
    odd = spark.createDataFrame([(0.5, 2), (None, 10), (float("nan"), 10), (0.5, None)], "rho double, n long").select(S.correlation_p(F.col("rho"), F.col("n")).alias("y")).collect()
    assert [r["y"] for r in odd] == [None] * 4


def test_spearman_by_group(spark):
    rows = [("x", i, i * i) for i in range(10)] + [("y", i, (i * 7) % 10) for i in range(10)] + [("z", 1, 1)]
    got = {r["g"]: r for r in S.spearman_test(spark.createDataFrame(rows, "g string, a int, b int"), ["g"], "a", "b").collect()}
    assert got["x"]["rho"] == pytest.approx(1.0) and got["x"]["p"] == pytest.approx(0.0, abs=1e-9)
    assert 0.05 < got["y"]["p"] < 1 and got["z"]["p"] is None
