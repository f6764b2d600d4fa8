"""Joins whose left side may hold one key in a third of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in this many of the left rows; so there are fewer hot keys than this.
PARTS = 4_096


def join_uneven(left: DataFrame, right: DataFrame, keys: list[str], rows: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has each key once and in ``rows`` how many left rows hold it.

    Hot keys, at most ``PARTS`` of them, are sent to the tasks, so their rows
    stay where they are; all others are joined as Spark sees fit.
    """
    total = right.agg(F.sum(rows).alias("n")).first()["n"] or 0
    hot = right.where(F.col(rows) > total / PARTS)
    names = hot.select(*keys)
    cold = left.join(F.broadcast(names), keys, "left_anti").join(right.where(F.col(rows) <= total / PARTS), keys, how)
    return left.join(F.broadcast(hot), keys).unionByName(cold)
