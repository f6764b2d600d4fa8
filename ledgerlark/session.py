"""Tables and sessions."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a single machine without one takes a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("folder")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = _OWN["folder"] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return where.rstrip("/")


def spread(df: DataFrame, least: int = 1) -> DataFrame:
    """The rows dealt to all cores, and to ``least`` tasks, where a table's few files would make fewer; any other table as it is."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, least)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


_CUTS: dict[str, SparkSession] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as written to the session's shared folder; ``drop_cut`` removes them, at the latest the end of the driver does."""
    # Not checkpoint(): its plans keep the rows' constraints, which grow with every round of a loop.
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _CUTS:
        atexit.register(drop_all_cuts)
    _CUTS[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path  # type: ignore[attr-defined]
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Removes what ``cut_lineage`` wrote for these, which nothing reads any more; other frames are left alone."""
    for path in {getattr(f, "_cut_path", None) for f in frames} & set(_CUTS):
        _remove(_CUTS.pop(path), path)


def drop_all_cuts() -> None:
    for path in list(_CUTS):
        try:
            _remove(_CUTS.pop(path), path)
        except Exception:  # the session has ended already
            pass


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
