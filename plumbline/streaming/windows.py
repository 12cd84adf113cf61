"""Streams: windowed statistics with watermarks, and the same operators in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, at: str, by: list[str], value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """``window_start, by, n, total, mean, median`` (approximate) per tumbling window; events later than ``late`` are left out
    of a stream (a batch has none). State is one row per open window and group."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events
    g = e.groupBy(F.window(at, width).alias("w"), *by)
    s = g.agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.percentile_approx(value, 0.5, 10_000).alias("median"))
    return s.select(F.col("w.start").alias("window_start"), *by, "n", "total", (F.col("total") / F.col("n")).alias("mean"), "median")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``by, start, end, n`` of activity sessions separated by gaps."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns the result table (memory sink: results are small, or a test)."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def upsert_batches(df: DataFrame, path: str, key: str, version: str, checkpoint: str):
    """A sink that keeps the latest version per key: each micro-batch is merged into a Parquet table (two folders in turn, so
    a failed batch leaves the last good table)."""

    def merge(batch: DataFrame, epoch: int) -> None:
        from plumbline.operators.dedupe import keep_first
        from plumbline.sources.writers import exists

        spark = batch.sparkSession
        here, there = f"{path}/{epoch % 2}", f"{path}/{(epoch + 1) % 2}"
        both = batch.unionByName(spark.read.parquet(there)) if exists(spark, there) else batch
        keep_first(both, [key], [[version, "desc"]]).write.mode("overwrite").parquet(here)

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
