"""Windowed and running roll-ups of measurement streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def telemetry_windows(samples: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Average and peak per process and window; late rows within ``delay`` count."""
    return (
        samples.withWatermark("ts", delay).groupBy(F.window("ts", width), "proc")
        .agg(F.avg("value").alias("avg"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))
        .select("proc", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "avg", "peak", "n")
    )


def peak_over_baseline(samples: DataFrame) -> DataFrame:
    """Running peak minus the earliest sample per process.

    Built-in aggregates keep the state, so each batch is combined before the
    exchange and a busy process does not send its rows to one task.
    """
    first = F.min_by("value", F.struct("ts", "value"))
    return samples.groupBy("proc").agg(
        F.max("value").alias("peak"), first.alias("baseline"), (F.max("value") - first).alias("delta"))


def running_levels(samples: DataFrame, hi: float, bins: int = 64) -> DataFrame:
    """Running fixed-bin histogram with the maximum seen per bin."""
    pos = F.floor(F.col("value") / hi * bins)
    return samples.groupBy("proc", F.least(F.greatest(pos, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed results to Parquet and stop when the input is drained."""
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def replace_at(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest complete result as a Parquet table."""
    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        df.writeStream.outputMode("complete").foreachBatch(put)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
