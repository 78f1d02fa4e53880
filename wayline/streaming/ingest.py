"""Structured Streaming: an extension that feeds the store and summarises as rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import Study
from ..sources.store import Store


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_rows(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row a (segment_id, ts_utc) within the watermark, so the state is bounded."""
    timed = stream.withColumn("event_time", F.col("ts_utc").cast("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["segment_id", "ts_utc"])


def tumbling_summary(stream: DataFrame, value: str, width: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """count and mean by segment and window; a window is final once the watermark has passed it."""
    timed = stream.withColumn("event_time", F.col("ts_utc").cast("timestamp")).withWatermark("event_time", delay)
    out = timed.groupBy("segment_id", F.window("event_time", width)).agg(F.count(value).alias("count"), F.avg(value).alias("mean"))
    return out.select("segment_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "count", "mean")


def into_store(stream: DataFrame, store: Store, checkpoint: str, bin_minutes: int, name: str | None = None) -> StreamingQuery:
    """Each micro-batch is merged keep-first, so a batch that is run again adds nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.ingest(Study(batch.drop("event_time")), name, "stream", bin_minutes)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
