"""Structured Streaming forms of the stateful behaviour: windows, dedupe, host reach, the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total of each hour; on a stream, rows later than ``late`` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def once_each(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def host_reach(checks: DataFrame) -> DataFrame:
    """T-6: running counts by host; three failures without a success are unreachable."""
    s = checks.groupBy("host").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.max("ts").alias("last_seen"))
    return s.withColumn("unreachable", (F.col("ok") == 0) & (F.col("failed") >= 3))


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Runs a stream over what is there now into a memory table of that name."""
    w = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return q


def append_log(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """K-11, T-8: best-effort append; a log that can't be written never fails its caller."""
    try:
        rows.select("ts", F.substring("query", 1, 500).alias("query"), "k", "confidence", "top_similarity", "n_results", "place", "bbox_matches", "top_key").write.mode("append").parquet(path)
    except Exception as e:  # noqa: BLE001
        spark.sparkContext._jvm.System.err.println(f"query log: {e}"[:200])
