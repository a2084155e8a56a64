"""A daily panel from a stream of events.  Beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of events as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def daily_panel(events: DataFrame, late: str = "2 days") -> DataFrame:
    """household_id, date, consumption by tumbling day; rows later than the watermark are left out by Spark."""
    day = F.window("ts", "1 day")
    each = events.withWatermark("ts", late).groupBy(F.col("user_id").alias("household_id"), day.alias("w")).agg(F.sum("value").alias("consumption"))
    return each.select("household_id", F.to_date("w.start").alias("date"), "consumption")


def write_panel(panel: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append closed days to Parquet, with what is at hand."""
    return panel.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
