"""Events as a stream: late rows within a watermark, counts by day, and days that replace themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """The events files of a folder, as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "events*.parquet").parquet(folder)


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, n, users. State is dropped as the watermark passes a day; users counts roughly."""
    kept = stream.withWatermark("ts", late)
    counted = kept.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return counted.select(F.to_date("window.start").alias("day"), "event_type", "n", "users")


def run_daily(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take what is there, writing each batch's days; a batch that runs again replaces the same rows.

    A batch's rows go to a folder of their own, so later batches add to a day and a repeated one does not double it.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("day", F.to_date("ts")).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(path)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
