"""Parts of composite analyses that several of them share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry(findings: Mapping[tuple[int, str], tuple[DataFrame, str]]) -> DataFrame:
    """tier, kind, subject, n: counts by subject of each finding's rows, all in one plan."""
    out = None
    for (tier, kind), (rows, subject) in findings.items():
        one = rows.groupBy(F.col(subject).alias("subject")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), "subject", "n")
        out = one if out is None else out.unionByName(one)
    return out


def witness(df: DataFrame, parts: str, total: str, tolerance: float) -> DataFrame:
    """Adds agrees: the sum of parts meets the stated total."""
    return df.withColumn("agrees", F.abs(F.col(parts) - F.col(total)) <= tolerance)


def seeded_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The rows with the least hashes of seed and key (a top-k, so no full sort)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("sample_hash", h).orderBy("sample_hash", key).limit(rows).drop("sample_hash")


def pattern_hits(df: DataFrame, column: str, named: Mapping[str, str]) -> DataFrame:
    """P-14: name, docs: how many rows each named pattern meets, all in one pass; a null text meets none."""
    hit = df.agg(*(F.count_if(F.col(column).rlike(p)).alias(n) for n, p in named.items()))
    return hit.unpivot([], list(named), "name", "docs")
