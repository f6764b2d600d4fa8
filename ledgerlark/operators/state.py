"""Merging new rows into held tables, and what has changed between two of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with their keys; columns in ``keep`` stay as first written."""
    if keep:
        held = old.select(*keys, *(F.col(c).alias(f"held_{c}") for c in keep), F.lit(True).alias("held_row"))
        new = new.join(held, list(keys), "left")
        new = new.select(*(F.when(F.col("held_row"), F.col(f"held_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns))
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*old.columns))


def replace_touched(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of a touched key are replaced by the new ones."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*old.columns))


def add_counts(old: DataFrame, new: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Counts of both tables added up by key."""
    return old.unionByName(new).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, mark: str) -> DataFrame:
    """key, change: new, changed or gone, by one aggregate over both snapshots (keys are unique in each)."""
    a = before.select(key, F.col(mark).alias("mark_a"), F.lit(None).cast("string").alias("mark_b"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    b = after.select(key, F.lit(None).cast("string").alias("mark_a"), F.col(mark).alias("mark_b"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    s = a.unionByName(b).groupBy(key).agg(F.max("mark_a").alias("mark_a"), F.max("mark_b").alias("mark_b"), F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    change = F.when(F.col("in_a") == 0, "new").when(F.col("in_b") == 0, "gone").when(~F.col("mark_a").eqNullSafe(F.col("mark_b")), "changed")
    return s.select(key, change.alias("change")).where("change is not null")


def append_missing(wanted: DataFrame, path: str, key: str, make: Callable[[DataFrame], DataFrame]) -> None:
    """Q-19: appends what ``make`` gives for the wanted rows whose key the table at ``path`` does not hold; a run cut short is taken up by the next.

    Rows without a key are left out; a repeated one is made once.
    """
    held = wanted.sparkSession.read.parquet(path)
    new = wanted.where(F.col(key).isNotNull()).dropDuplicates([key]).join(held.select(key), key, "left_anti")
    make(new).select(*held.columns).write.mode("append").parquet(path)
