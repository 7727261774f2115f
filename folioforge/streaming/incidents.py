"""Structured Streaming forms of the stateful operators over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: How late an event may be before its state is dropped.
LATENESS = "30 minutes"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as a stream of Parquet files; the schema is that of the files at hand."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def incident_sessions(events: DataFrame, gap: str = "600 seconds") -> DataFrame:
    """Recurrences of a kind within the gap as one incident, with its count."""
    window = F.session_window("ts", gap)
    found = events.withWatermark("ts", LATENESS).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select("event_type", F.col("w.start").alias("first"), F.col("w.end").alias("closes"), "n")


def rate(events: DataFrame, span: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """Calls of each kind in sliding windows."""
    window = F.window("ts", span, step)
    return events.withWatermark("ts", LATENESS).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def tumbling(events: DataFrame, span: str = "1 hour") -> DataFrame:
    """Counts and sums of each kind in tumbling windows."""
    window = F.window("ts", span)
    totals = events.withWatermark("ts", LATENESS).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return totals.select("event_type", F.col("w.start").alias("start"), "n", "total")


def first_seen(events: DataFrame, key: str) -> DataFrame:
    """The first event of each key within the lateness: a rebuild's debounce, state bounded by the watermark."""
    return events.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there to Parquet, then stop; a later call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
