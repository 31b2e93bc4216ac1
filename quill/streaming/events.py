"""Event streams. Each function takes a batch or a streaming DataFrame with a timestamp column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A file source: each file is taken once, known from the checkpoint after a restart."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by tumbling or sliding window; a stream forgets windows once the watermark has passed them."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = marked.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    out = marked.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once; a stream remembers keys within the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def append(stream: DataFrame, out: str, checkpoint: str):
    """Appends to a parquet log exactly once, all that is there now, then stops."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
