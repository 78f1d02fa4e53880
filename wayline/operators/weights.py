"""Traffic-volume weighting. Volumes are one row a segment: segment_id, aadt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _positive(weight: str = "aadt") -> Column:
    return F.when(F.col(weight) > 0, F.col(weight).cast("double"))


def weighted_mean_speed(means: DataFrame, volumes: DataFrame, value: str = "mean") -> DataFrame:
    """One row, weighted_speed: over segments with a value and a positive volume; NULL if there is none."""
    rows = means.join(volumes.select("segment_id", _positive().alias("_w")), "segment_id").where(F.col(value).isNotNull() & F.col("_w").isNotNull())
    return rows.agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("weighted_speed"))


def vehicle_hours_of_delay(means: DataFrame, volumes: DataFrame, value: str = "mean") -> DataFrame:
    """Adds vehicle_hours a day: delay in minutes / 60 times volume; 0 without a positive volume, NULL without a delay."""
    joined = means.join(volumes.select("segment_id", _positive().alias("_w")), "segment_id", "left")
    return joined.withColumn("vehicle_hours", F.when(F.col("_w").isNull(), F.lit(0.0)).otherwise(F.col(value) / 60 * F.col("_w"))).drop("_w")


def weighted_speed_by_time(df: DataFrame, volumes: DataFrame, value: str = "speed", min_coverage: float = 0.5) -> DataFrame:
    """Per ts_utc: weighted_speed over the reporting segments, n_segments, and coverage, their share of the volume of all segments of the frame.

    Timestamps below ``min_coverage`` have no row; without any positive volume there is none.
    """
    weights = volumes.select("segment_id", _positive().alias("_w")).where("_w IS NOT NULL")
    rows = df.join(weights, "segment_id")
    # One pass sums each segment's weight once: distinct pairs are counted before the total.
    total = rows.select("segment_id", "_w").distinct().agg(F.sum("_w").alias("_total"))
    sums = rows.where(F.col(value).isNotNull()).groupBy("ts_utc").agg(F.sum(F.col("_w") * F.col(value)).alias("_s"), F.sum("_w").alias("_w"), F.count_distinct("segment_id").alias("n_segments"))
    out = sums.crossJoin(F.broadcast(total)).withColumn("coverage", F.col("_w") / F.col("_total")).where(F.col("coverage") >= min_coverage)
    return out.select("ts_utc", (F.col("_s") / F.col("_w")).alias("weighted_speed"), "coverage", "n_segments")
