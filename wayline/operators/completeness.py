"""Corridor and network roll-ups under a completeness rule, and coverage diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import default_metric, require
from .filters import filter_members

POLICIES = ("max", "total")


def _cells(df: DataFrame, value: str | None = None) -> DataFrame:
    """One row for each (corridor, ts_utc, segment_id): all that counts, sums, expectations and members come from."""
    sums = [] if value is None else [F.sum(value).alias("_v")]
    return df.where(F.col("corridor").isNotNull()).groupBy("corridor", "ts_utc", "segment_id").agg(*sums, F.count("*").alias("_rows"))


def _with_expected(by_time: DataFrame, cells: DataFrame, policy: str) -> DataFrame:
    """Adds expected to rows (corridor, ts_utc, _reporting): a window over a corridor's timestamps, or its distinct segments."""
    if policy not in POLICIES:
        raise ValueError(f"expected is one of {POLICIES}")
    if policy == "max":
        return by_time.withColumn("expected", F.max("_reporting").over(Window.partitionBy("corridor")))
    return by_time.join(cells.groupBy("corridor", "segment_id").agg(F.count("*").alias("_t")).groupBy("corridor").agg(F.count("segment_id").alias("expected")), "corridor")


def mark_complete(df: DataFrame, expected: str = "max") -> DataFrame:
    """Adds n_segments, expected and complete to each row.

    expected: the most segments that any timestamp of the corridor has ('max'), or all that the corridor
    ever has ('total'). Rows without a corridor get NULL counts and are not complete; a frame without
    the column is one corridor.
    """
    own = "corridor" in df.columns
    work = df if own else df.withColumn("corridor", F.lit("all"))
    cells = _cells(work)
    by_time = cells.groupBy("corridor", "ts_utc").agg(F.count("segment_id").alias("_reporting"))
    marked = _with_expected(by_time, cells, expected).select("corridor", "ts_utc", F.col("_reporting").alias("n_segments"), "expected")
    out = work.join(marked, ["corridor", "ts_utc"], "left").withColumn("complete", F.coalesce(F.col("n_segments") >= F.col("expected"), F.lit(False)))
    return out if own else out.drop("corridor")


def corridor_travel_time(df: DataFrame, metadata: DataFrame | None = None, require_complete: bool = True, value: str | None = None, expected: str = "max", members=None, minutes: bool = True) -> DataFrame:
    """Sum of ``value`` over the segments of each (corridor, ts_utc).

    What is expected counts reporting segments; n_segments and complete count those with a value. With
    ``metadata`` (segment_id, miles) a travel-time sum also gets its length and, if it is in minutes,
    the space-mean speed. The rows are read and aggregated once.
    """
    value = value or default_metric(df)
    require(df, "corridor", value)
    cells = _cells(filter_members(df, members), value)
    by_time = cells.groupBy("corridor", "ts_utc").agg(F.sum("_v").alias(value), F.count_if(F.col("segment_id").isNotNull() & F.col("_v").isNotNull()).alias("n_segments"), F.count("segment_id").alias("_reporting"))
    out = _with_expected(by_time, cells, expected).select("corridor", "ts_utc", value, "n_segments", "expected").withColumn("complete", F.col("n_segments") >= F.col("expected"))
    if require_complete:
        out = out.where("complete")
    if metadata is not None and value == "travel_time":
        out = attach_length_speed(out, cells.select("corridor", "segment_id").distinct(), metadata, minutes)
    return out


def attach_length_speed(totals: DataFrame, members: DataFrame, metadata: DataFrame, minutes: bool = True) -> DataFrame:
    """Adds the miles of each corridor's distinct segments, 0 if none is known, and mph where travel time is positive minutes."""
    lengths = members.join(metadata.select("segment_id", "miles"), "segment_id", "left").groupBy("corridor").agg(F.coalesce(F.sum("miles"), F.lit(0.0)).alias("miles"))
    mph = F.when(F.lit(minutes) & (F.col("travel_time") > 0), F.col("miles") / (F.col("travel_time") / 60))
    return totals.join(lengths, "corridor", "left").withColumn("mph", mph)


def network_travel_time(df: DataFrame, metadata: DataFrame | None = None, require_complete: bool = True, value: str | None = None, expected: str = "total", label: str = "Network", members=None, minutes: bool = True) -> DataFrame:
    """All segments as one corridor."""
    return corridor_travel_time(df.withColumn("corridor", F.lit(label)), metadata, require_complete, value, expected, members, minutes)


def segment_coverage(df: DataFrame, members: DataFrame | None = None, value: str | None = None) -> DataFrame:
    """For each member: n_reported, n_timestamps, coverage, and complete_set_cost, the timestamps at which it alone is absent.

    members: a frame of segment_id; those never seen are kept. The cost needs no member-by-timestamp
    grid: of the timestamps with all members but one, it is those without this member.
    """
    if value is not None:
        df = df.where(F.col(value).isNotNull())
    all_members = (df if members is None else members).select("segment_id").where("segment_id IS NOT NULL").distinct()
    # Distinct pairs by timestamp are in one place: how many there are is a window over them, and one aggregate gives all else.
    seen = df.select("ts_utc", "segment_id").join(all_members, "segment_id", "left_semi").groupBy("ts_utc", "segment_id").agg(F.count("*").alias("_rows"))
    by_time = Window.partitionBy("ts_utc")
    seen = seen.repartition("ts_utc").withColumns({"n": F.count("*").over(by_time), "_one": F.col("segment_id") == F.min("segment_id").over(by_time)})
    # By segment and by how many reported with it: as many rows as members, for each of them.
    tally = seen.groupBy("segment_id", "n").agg(F.count("*").alias("_t"), F.count_if("_one").alias("_ones"))
    number = all_members.agg(F.count("*").alias("n_members"))
    short = F.col("n") == F.col("n_members") - 1
    tally = tally.crossJoin(F.broadcast(number))
    totals = tally.agg(F.coalesce(F.sum("_ones"), F.lit(0)).alias("n_timestamps"), F.coalesce(F.sum(F.when(short, F.col("_ones"))), F.lit(0)).alias("n_short"))
    own = tally.groupBy("segment_id").agg(F.sum("_t").alias("n_reported"), F.coalesce(F.sum(F.when(short, F.col("_t"))), F.lit(0)).alias("present_short"))
    out = all_members.join(own, "segment_id", "left").crossJoin(F.broadcast(totals))
    reported = F.coalesce("n_reported", F.lit(0))
    return out.select(
        "segment_id",
        reported.alias("n_reported"),
        "n_timestamps",
        F.when(F.col("n_timestamps") > 0, reported / F.col("n_timestamps")).alias("coverage"),
        (F.col("n_short") - F.coalesce("present_short", F.lit(0))).alias("complete_set_cost"),
    ).orderBy(F.desc("complete_set_cost"), "coverage", "segment_id")
