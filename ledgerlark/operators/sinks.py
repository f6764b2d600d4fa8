"""Writing: rebuilt tables, streamed upserts, exchanged checks, repairs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.state import add_counts, upsert


def rebuild(df: DataFrame, path: str) -> None:
    """K-6, K-7: writes beside the table, moves the old one aside and the new one into its place.

    Readers see the old table, for a moment none, then the new one, never half
    of one.  If the last move fails the old one is put back; it is deleted only
    when the new one stands.
    """
    spark, tag = df.sparkSession, uuid.uuid4().hex
    beside, aside = (f"{path.rstrip('/')}.{kind}-{tag}" for kind in ("new", "old"))
    df.write.parquet(beside)
    fs, new, live = _paths(spark, beside, path)
    _, old, _ = _paths(spark, aside, path)
    held = fs.exists(live)
    if held and not fs.rename(live, old):
        raise OSError(f"{path} could not be moved to {aside}")
    if not fs.rename(new, live):
        if held:
            fs.rename(old, live)
        raise OSError(f"{beside} could not be moved to {path}")
    if held:
        fs.delete(old, True)


def _paths(spark: SparkSession, a: str, b: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    x, y = jvm.org.apache.hadoop.fs.Path(a), jvm.org.apache.hadoop.fs.Path(b)
    return x.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), x, y


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _paths(spark, path, path)
    return fs.exists(p)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> None:
    """K-1: the table at ``path`` with ``new`` merged in; of rows that share a key in ``new`` one stays."""
    once = new.dropDuplicates(list(keys))
    rebuild(upsert(spark.read.parquet(path), once, keys, keep) if exists(spark, path) else once, path)


def upsert_batches(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str):  # noqa: ANN201
    """K-3: a stream of checks merged into a table batch by batch; a replayed batch changes nothing."""
    merge = lambda batch, _: upsert_table(batch.sparkSession, path, batch, keys)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def export_checks(checks: DataFrame, vantage: str) -> DataFrame:
    """K-8: what one vantage has seen."""
    return checks.where(F.col("vantage") == vantage)


def import_checks(held: DataFrame, other: DataFrame) -> DataFrame:
    """K-8: another vantage's checks beside one's own; of each (vantage, url) the later one."""
    both = held.unionByName(other, allowMissingColumns=True)
    row = F.struct("fetched_at", *(c for c in both.columns if c != "fetched_at"))
    return both.groupBy("vantage", "url").agg(F.max(row).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in held.columns))


def merge_reach(held: DataFrame, new: DataFrame) -> DataFrame:
    """K-4: counts by host and vantage added up."""
    return add_counts(held.select("host", "vantage", "ok", "failed"), new.select("host", "vantage", "ok", "failed"), ["host", "vantage"], ["ok", "failed"])


def reachable_elsewhere(reach: DataFrame, vantage: str) -> DataFrame:
    """J-10, T-6: hosts that this vantage cannot reach (three failures, no success) but another can."""
    here = reach.where((F.col("vantage") == vantage) & (F.col("ok") == 0) & (F.col("failed") >= 3)).select("host")
    return here.join(reach.where((F.col("vantage") != vantage) & (F.col("ok") > 0)).select("host"), "host", "left_semi")


def repair_checks(checks: DataFrame, alive: DataFrame) -> DataFrame:
    """K-10: silent checks (status 0) of hosts that answer after all are dropped, so that they are checked again."""
    from ledgerlark.functions.normalise import host

    silent = (F.col("status") == 0).alias("silent")
    keyed = checks.withColumn("check_host", host(F.col("url")))
    again = keyed.where(silent).join(alive.select(F.col("host").alias("check_host")).distinct(), "check_host", "left_semi").select("url")
    return checks.join(again, "url", "left_anti")


def availability(datasets: DataFrame, resources: DataFrame, checks: DataFrame) -> DataFrame:
    """A-2, J-6: key, availability by one aggregate: the best verdict; dead only if all resources were checked; nofiles if none is listed."""
    seen = resources.select("dataset_key", "url").join(checks.select("url", "verdict"), "url", "left")
    best = F.lit(None).cast("string")
    for verdict in ("unreachable", "blocked", "webpage", "api", "data"):
        best = F.when(F.count_if(F.col("verdict") == verdict) > 0, verdict).otherwise(best)
    all_seen = (F.count(F.lit(1)) == F.count("verdict")) & (F.count("verdict") > 0)
    by = seen.groupBy("dataset_key").agg(F.coalesce(best, F.when(all_seen, "dead")).alias("availability"))
    out = datasets.join(by.withColumn("listed", F.lit(True)), F.col("key") == F.col("dataset_key"), "left")
    none = F.col("listed").isNull() & (F.coalesce("resource_count", F.lit(0)) == 0)
    return out.select("key", F.coalesce("availability", F.when(none, "nofiles")).alias("availability"))
