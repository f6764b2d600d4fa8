"""Conditions over lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Iterable[Column]) -> Column:
    """Whether any condition holds, joined in pairs: a chain of hundreds would be too deep for the analyser."""
    level = list(conditions) or [F.lit(False)]
    while len(level) > 1:
        level = [level[i] | level[i + 1] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]
