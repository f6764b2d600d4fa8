"""Order statistics that SQL has no name for."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str, least: int = 1) -> DataFrame:
    """The value at offset n // 2 of each group in ascending order, of groups with ``least`` rows or more.

    Equal values are counted before the window, so a group's rows are bounded
    by its distinct values.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("median_n"))
    w = Window.partitionBy(*keys)
    n = n.withColumn("median_to", F.sum("median_n").over(w.orderBy(value))).withColumn("median_all", F.sum("median_n").over(w))
    at = F.expr("median_all div 2")
    return n.where((F.col("median_all") >= least) & (F.col("median_to") > at) & (F.col("median_to") - F.col("median_n") <= at)).select(*keys, F.col(value).alias(name))


def average_rank(keys: Sequence[str], value: str) -> Column:
    """The rank in a group with ties sharing their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def share_rank(keys: Sequence[str], value: str) -> Column:
    """The average rank over the number of rows: 1 for the last."""
    return average_rank(keys, value) / F.count(F.lit(1)).over(Window.partitionBy(*keys))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Spearman's rho of two columns in each group."""
    r = df.select(*keys, average_rank(keys, a).alias("rank_a"), average_rank(keys, b).alias("rank_b"))
    return r.groupBy(*keys).agg(F.corr("rank_a", "rank_b").alias("rho"), F.count(F.lit(1)).alias("n"))


#: Steps of the continued fraction: enough for fifteen digits where its terms converge slowest.
BETA_STEPS = 200


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of a positive number: Stirling's series after twelve steps up."""
    up = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0.0), lambda s, i: s + F.log(x + i))
    z = x + 12
    tail = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - up


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, by its continued fraction in Lentz's form, as one expression."""
    tiny = 1e-300

    def fraction(a: Column, b: Column, x: Column) -> Column:
        off = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

        def step(s: Column, m: Column, coefficient: Column) -> Column:
            d = 1 / off(1 + coefficient * s["d"])
            c = off(1 + coefficient / s["c"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

        def two(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            # A struct bound by a lambda of one element is worked out once.
            return F.aggregate(F.array(even, odd), s, lambda t, k: step(t, m, k))

        d = 1 / off(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(BETA_STEPS)), start, lambda s, m: two(s, m.cast("double")), lambda s: s["h"])

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    inner = F.when(x < (a + 1) / (a + b + 2), front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def correlation_p(rho: Column, n: Column) -> Column:
    """A-33: the two-sided p-value of a correlation of n rows by Student's t; null for fewer than three rows or no correlation."""
    freedom = (n - 2).cast("double")
    share = F.greatest(1 - rho * rho, F.lit(0.0))
    return F.when((n > 2) & rho.isNotNull() & ~F.isnan(rho), incomplete_beta(freedom / 2, F.lit(0.5), share))


def spearman_test(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """A-33: Spearman's rho of each group with its p-value."""
    return spearman(df, keys, a, b).withColumn("p", correlation_p(F.col("rho"), F.col("n")))
