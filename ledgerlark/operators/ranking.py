"""Ranks and quantiles over whole tables without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.session import cut_lineage, drop_cut

#: Rows that a task ranks.
RANKED_ROWS = 1_000_000


def global_rank(df: DataFrame, order: str, name: str, rows: int = RANKED_ROWS) -> DataFrame:
    """Adds the 0-based rank by a column, nulls first (ties by no order).

    Rows are dealt into ranges of the column that hold about ``rows`` each; a
    repeated value is parted by a row number of no meaning.  A row's rank is
    the number of rows in lower ranges plus its place in its own.
    """
    parts = max(1, ceil(df.count() / rows))
    keyed = df.withColumn("rank_row", F.monotonically_increasing_id())
    # Written once: ranges come from a sample and would differ when made again.
    keyed = cut_lineage(keyed.repartitionByRange(parts, order, "rank_row").withColumn("rank_part", F.spark_partition_id()))
    sizes = keyed.groupBy("rank_part").agg(F.count(F.lit(1)).alias("rank_n"))  # ``parts`` rows
    before = Window.orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("rank_part", F.coalesce(F.sum("rank_n").over(before), F.lit(0)).alias("rank_base"))
    own = F.row_number().over(Window.partitionBy("rank_part").orderBy(order, "rank_row")) - 1
    return keyed.withColumn("rank_own", own).join(base, "rank_part").withColumn(name, F.col("rank_base") + F.col("rank_own")).drop("rank_part", "rank_own", "rank_base", "rank_row")


def competition_rank(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the 1-based rank in descending order of a column over all rows; equal values share the best rank.

    Counts by value are ranked, not rows.
    """
    by = global_rank(df.groupBy(order).agg(F.count(F.lit(1)).alias("rank_same")).withColumn("rank_down", -F.col(order)), "rank_down", "rank_at")
    # How many rows stand before a value: the counts of better values, summed by ranges of rank.
    part = F.floor(F.col("rank_at") / RANKED_ROWS)
    sums = by.groupBy(part.alias("rank_part")).agg(F.sum("rank_same").alias("rank_n"))  # a row for each million values
    base = sums.select("rank_part", F.coalesce(F.sum("rank_n").over(Window.orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank_base"))
    own = F.coalesce(F.sum("rank_same").over(Window.partitionBy("rank_part").orderBy("rank_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = by.withColumn("rank_part", part).withColumn("rank_own", own).join(base, "rank_part").select(order, (F.col("rank_base") + F.col("rank_own") + 1).cast("long").alias(name))
    return df.join(told, order)


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation, nulls left out; empty for a table without values."""
    ranked = cut_lineage(global_rank(df.where(F.col(value).isNotNull()).select(value), value, "quantile_rank"))
    n = ranked.count()
    if not n:
        drop_cut(ranked)
        return []
    at = [s * (n - 1) for s in shares]
    wanted = sorted({f(a) for a in at for f in (floor, ceil)})
    got = {r["quantile_rank"]: float(r[value]) for r in ranked.where(F.col("quantile_rank").isin(wanted)).collect()}  # two for each share
    drop_cut(ranked)
    return [got[floor(a)] + (got[ceil(a)] - got[floor(a)]) * (a - floor(a)) for a in at]
