"""Row filters and calendar labels."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal


def filter_confidence(df: DataFrame, threshold: float = 80) -> DataFrame:
    """Rows whose cvalue is above ``threshold``; equal and missing ones go."""
    return df.where(F.col("cvalue") > threshold)


def assign_day_group(df: DataFrame, scheme=None) -> DataFrame:
    """Adds day_group; days that the scheme doesn't name get NULL."""
    pick = F.lit(None).cast("string")
    for day, label in cal.day_scheme(scheme).items():
        pick = F.when(F.col("dow") == day, F.lit(label)).otherwise(pick)
    return df.withColumn("day_group", pick)


def assign_time_bins(df: DataFrame, bins=cal.TIME_BINS) -> DataFrame:
    """Adds time_bin: the first bin of the list that holds the row, else NULL. A bin of equal ends holds nothing."""
    pick = F.lit(None).cast("string")
    for label in reversed(list(bins)):
        start, end = cal.parse_time_bin(label)
        pick = F.when(cal.within(F.col("tod_sec"), start, end), F.lit(label)).otherwise(pick)
    return df.withColumn("time_bin", pick)


def assign_group_label(df: DataFrame, sep: str = ", ") -> DataFrame:
    """Adds group_label, NULL if either part is."""
    return df.withColumn("group_label", F.concat("day_group", F.lit(sep), "time_bin"))


def filter_time_window(df: DataFrame, window=None) -> DataFrame:
    """Rows of a daily window, half-open, also over midnight; None or equal ends keep all."""
    if window is None:
        return df
    start, end = cal.parse_window(window)
    if start == end or (start, end) == (0, cal.DAY):
        return df
    return df.where(cal.within(F.col("tod_sec"), start, end))


def filter_day_of_week(df: DataFrame, days=None) -> DataFrame:
    """Rows of some weekdays; None, none or all seven keep all."""
    wanted = sorted({cal.parse_weekday(d) for d in days or ()})
    return df if not wanted or len(wanted) == 7 else df.where(F.col("dow").isin(wanted))


def filter_date_range(df: DataFrame, start: date | str | None = None, end: date | str | None = None, tz: str | None = None) -> DataFrame:
    """Rows of local days from ``start`` to ``end``, both whole and included; None is open. A bound with a zone is moved to ``tz`` first."""
    def day(x) -> Column:
        if isinstance(x, str):
            x = datetime.fromisoformat(x)
        return F.lit(cal.moment(x, tz).date())

    if start is not None:
        df = df.where(F.col("local_date") >= day(start))
    return df if end is None else df.where(F.col("local_date") <= day(end))


def filter_members(df: DataFrame, members=None) -> DataFrame:
    """Rows of some segments: a list of ids, or a frame of segment_id for more than fit a list."""
    if members is None:
        return df
    if isinstance(members, DataFrame):
        return df.join(members.select("segment_id").distinct(), "segment_id", "left_semi")
    members = list(members)
    return df.where(F.col("segment_id").isin(members)) if members else df


def filter_when(df: DataFrame, window=None, days=None) -> DataFrame:
    """Time of day and weekday together."""
    return filter_day_of_week(filter_time_window(df, window), days)


def between(start: datetime, end: datetime) -> F.Column:
    """Half-open membership of local_ts."""
    moment = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return (F.col("local_ts") >= moment(start)) & (F.col("local_ts") < moment(end))


def in_period(period) -> F.Column:
    """The same for a period as people write it."""
    return between(*cal.parse_period(period))


def window_key(window=None, days=None) -> tuple:
    """One key for all spellings of the same restriction, for caches."""
    span = None if window is None else cal.parse_window(window)
    span = None if span is None or span[0] == span[1] or span == (0, cal.DAY) else span
    wanted = tuple(sorted({cal.parse_weekday(d) for d in days or ()}))
    return span, None if len(wanted) in (0, 7) else wanted
