"""All queries of the library by name, with the DuckDB SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Registers a function of (spark, sf_dir) and, where SQL can say it, its oracle."""

    def put(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def cast_oracle(name: str, **kinds: str) -> None:
    """States the types of result columns that DuckDB would widen or make decimal."""
    casts = ", ".join(f"CAST({c} AS {k}) AS {c}" for c, k in kinds.items())
    ORACLE[name] = f"SELECT * REPLACE ({casts}) FROM ({ORACLE[name]})"
