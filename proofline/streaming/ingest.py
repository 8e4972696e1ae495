"""Streams: ingestion of uploads that runs once for each file, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofline.operators.catalog import only_new
from proofline.sources.collections import UPLOAD, append, upload_rows


def upload_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(UPLOAD).option("multiLine", True).json(path)


def ingest(payloads: DataFrame, store: str, collection: str, checkpoint: str) -> StreamingQuery:
    """Append the chunks of new files to the store; a file whose name is stored already is passed over.

    The first payload of a name in a batch counts. A batch that is run again after a failure finds its files stored.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = upload_rows(batch.dropDuplicates(["filename"]))
        try:
            stored = spark.read.parquet(store).where(F.col("collection_id") == collection).select("filename")
            rows = only_new(rows, stored, "filename")
        except Exception as error:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(error):
                raise
        append(rows, store, collection)

    return payloads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Count and sum of the values of each type in tumbling or sliding windows; works on tables and streams."""
    late = events.withWatermark("ts", watermark) if watermark else events
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return late.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """Count of the events of each user in sessions that end after ``gap`` without one."""
    late = events.withWatermark("ts", watermark) if watermark else events
    return late.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )


def first_of_each(events: DataFrame, key: str, watermark: str) -> DataFrame:
    """Events without repeats of the key that come within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
