"""Pass statistics as a stream: an addition to the batch operators, on Structured Streaming's own windows and watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def windowed_health(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, stalls and total value by window and type; rows later than the watermark are left out. Works on streams and tables alike."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    g = seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 80).cast("long")).alias("stalls"))
    return g.select(F.col("w.start").alias("at"), "event_type", "n", "stalls")


def append_to(rows: DataFrame, folder: str, checkpoint: str):
    """A running query that appends finished windows to a folder, exactly once by way of its checkpoint."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_pass_stats(spark: SparkSession, d: str) -> DataFrame:
    return windowed_health(spark.read.parquet(f"{d}/events.parquet"))


QUERIES = {"stream_pass_stats": stream_pass_stats}
ORACLE_SQL = {"stream_pass_stats": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS at, event_type, count(*) AS n, CAST(sum(CASE WHEN value > 80 THEN 1 ELSE 0 END) AS BIGINT) AS stalls FROM events GROUP BY 1, 2"}
