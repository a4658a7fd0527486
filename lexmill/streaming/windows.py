"""Documents and events as streams: tumbling counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str | None = "1 hour", time: str = "ts", by: str = "event_type") -> DataFrame:
    """Count and sum of ``value`` by window and type; late data within the watermark count."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    return (
        rows.where(F.col(time).isNotNull())
        .groupBy(F.window(time, width), by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), by, "n", "total")
    )


def run_to_table(spark: SparkSession, source: str, sink: str, checkpoint: str, width: str = "1 hour") -> None:
    """Read Parquet files of ``source`` as a stream, and append finished windows to ``sink`` until the input ends."""
    schema = spark.read.parquet(source).schema
    counts = tumbling_counts(spark.readStream.schema(schema).parquet(source), width)
    counts.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
