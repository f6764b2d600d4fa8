"""Written tables that cut lineage, in the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, SparkSession] = {}
_OWN: dict[str, str] = {}
_BATCH, _DEFAULT_ROWS, _ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only for a single machine without one, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("folder")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = _OWN["folder"] = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    return where.rstrip("/")


class Scratch:
    """A folder of parquet tables for one run of an operator.

    ``save`` writes a DataFrame and returns a scan of what was written: a lost
    executor costs no recomputation beyond that table.  ``drop`` removes one
    that is no longer read.  What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        # Whole texts are wide: with ten thousand of them in a batch Python workers outgrow an executor of 3 GB.  The
        # result is read after this call, so the setting stays; one that the session made itself is left alone.
        if spark.conf.get(_BATCH) == _DEFAULT_ROWS:
            spark.conf.set(_BATCH, _ROWS)
        if not _ROOTS:
            atexit.register(_clean)
        _ROOTS[self.root] = spark

    def save(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """``files``: for tables of a known small size, how many to write."""
        df = df.coalesce(files) if files else df
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Removes all tables but these, which the result still reads."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(root) if fs.exists(root) else ():
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for root, spark in _ROOTS.items():
        try:
            _delete(spark, root)
        except Exception:  # the session has ended already
            pass


def blocks_for(total: int | None, each: int, least: int = 1) -> int:
    """The power of two of blocks that hold at most about ``each`` units of ``total``."""
    n = least
    while n * each < (total or 0):
        n *= 2
    return n


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"] or 0
