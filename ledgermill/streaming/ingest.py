"""Streams of statements and transactions: repeated statements dropped with bounded state, windowed spend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def without_repeats(statements: DataFrame, time: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """The first of equal statements; its keys are forgotten once the watermark has passed."""
    return statements.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def spend_windows(events: DataFrame, time: str, key: str, value: str, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """key, start, end, n, total of tumbling or sliding windows; rows later than the watermark are left out."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    sums = events.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return sums.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def run_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write everything that has arrived to Parquet, exactly once, and stop."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
