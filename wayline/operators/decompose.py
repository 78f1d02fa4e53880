"""Seasonal decomposition of each entity's series.

trend: median over the preceding ``window_days``, the row itself included, by time. season_day: mean of
the detrended values by time-of-day slot. season_week: mean of what is left by weekday and slot.
prediction is their sum, not below zero; resid is the value less the prediction. Each series' first
``drop_days`` go, and rows whose window holds fewer than ``min_samples`` values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as cal
from ..schema import numeric, require

#: Five-minute samples that a full window must hold at least; scaled for other cadences and shorter days.
FULL_SAMPLES = 480
#: Days that one task computes at once, besides the window before them.
CHUNK_DAYS = 28


def min_samples(df: DataFrame, *cadences: int) -> DataFrame:
    """freq_minutes and min_samples for each cadence: FULL_SAMPLES scaled by the observed slots of the day out of all that a day has; one aggregate of the rows.

    Slots are counted of distinct seconds of the day, of which there are at most 86,400.
    """
    seen = df.where(F.col("tod_sec").isNotNull()).groupBy("tod_sec").agg(F.count("*").alias("_n"))
    slots = seen.agg(*(F.count_distinct(cal.floor_seconds(c)).alias(str(c)) for c in cadences))
    scaled = lambda c: F.greatest(F.bround(FULL_SAMPLES * F.least(F.lit(1.0), F.col(str(c)) / max(1, round(1440 / c)))).cast("long"), F.lit(1).cast("long"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("freq_minutes"), scaled(c).alias("min_samples")) for c in cadences)))
    return slots.select(each.alias("x")).select("x.*")


def auto_min_samples(df: DataFrame, freq_minutes: int = 5) -> int:
    """``min_samples`` of one cadence, as a number."""
    return min_samples(df, freq_minutes).first()["min_samples"]


def rolling_median(df: DataFrame, value: str, entity=("segment_id",), window_days: int = 7, ts: str = "ts_utc") -> DataFrame:
    """Adds median and n_window over (ts - window_days .. ts], by time, at both ends closed.

    An exact median has no incremental JVM form, so pandas computes it; a series is cut into chunks of
    days, each with the window before it as a halo, so no task holds a whole series.
    """
    require(df, value, *entity)
    span = CHUNK_DAYS * cal.DAY
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(micros / (span * 1_000_000)).cast("long")
    last = F.floor((micros + window_days * cal.DAY * 1_000_000) / (span * 1_000_000)).cast("long")
    spread = df.withColumn("_micros", micros).withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, last)))
    names = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_micros", kind="stable")
        series = pd.Series(pdf[value].to_numpy(dtype=float), index=pd.to_datetime(pdf["_micros"], unit="us"))
        window = series.rolling(pd.Timedelta(days=window_days), closed="both")
        # Rows of one instant see each other: each takes the last one's window.
        stat = pd.DataFrame({"median": window.median(), "n_window": window.count()}).groupby(level=0).transform("last")
        pdf["median"], pdf["n_window"] = stat["median"].to_numpy(), stat["n_window"].fillna(0).astype("int64").to_numpy()
        return pdf.loc[pdf["_own"] == pdf["_chunk"], [*names, "median", "n_window"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = spread.groupBy(*entity, "_chunk").applyInPandas(run, f"{fields}, median double, n_window long")
    return out.withColumn("median", F.when(~F.isnan("median"), F.col("median")))


def decompose(
    df: DataFrame, value: str, entity=("segment_id",), freq_minutes: int = 5, window_days: int = 7, drop_days: int = 7, min_samples: int | None = None,
    keep_components: bool = True, min_slot_samples: int = 1, trend: bool = True,
) -> DataFrame:
    """Adds median, season_day, season_week, prediction and resid; needs the local calendar columns.

    Without ``keep_components`` only prediction and resid are added. ``min_slot_samples``: rows of slots
    of the day with fewer values go. Without ``trend`` the median is that of the whole series, and no row
    goes for its window.

    Both seasons are windows over the rows of an entity's slot, which one shuffle brings together, so
    that the rolling median, the costly part, is computed once.
    """
    require(df, value, *entity, "local_ts", "dow", "tod_sec")
    numeric(df, value)
    if min_samples is None:
        min_samples = auto_min_samples(df, freq_minutes)
    keys = list(entity)
    known = df.where(F.col(value).isNotNull())
    own = [F.min("local_ts").alias("_begin")] if trend else [F.min("local_ts").alias("_begin"), F.median(value).alias("median"), F.count("*").alias("n_window")]
    begin = known.groupBy(*keys).agg(*own)
    rows = (rolling_median(known, value, entity, window_days) if trend else known).join(begin, keys)
    rows = rows.where(F.col("local_ts") >= F.col("_begin") + F.make_dt_interval(F.lit(drop_days if trend else 0)))
    if trend:
        rows = rows.where(F.col("n_window") >= min_samples)
    rows = rows.withColumn("_slot", cal.floor_seconds(freq_minutes)).withColumn("_free", F.col(value) - F.col("median")).repartition(*keys, "_slot")
    slot, weekly = Window.partitionBy(*keys, "_slot"), Window.partitionBy(*keys, "_slot", "dow")
    out = rows.withColumn("_week", F.avg("_free").over(weekly)).withColumns({"season_day": F.avg("_free").over(slot), "_slot_n": F.count("_free").over(slot)})
    out = out.where(F.col("_slot_n") >= min_slot_samples).withColumn("season_week", F.col("_week") - F.col("season_day"))
    total = F.col("median") + F.col("season_day") + F.col("season_week")
    out = out.withColumn("prediction", F.when(total < 0, F.lit(0.0)).otherwise(total)).withColumn("resid", F.col(value) - F.col("prediction"))
    return out.select(*df.columns, *(("median", "n_window", "season_day", "season_week") if keep_components else ()), "prediction", "resid")


def seasonally_adjust(decomposed: DataFrame, value: str) -> DataFrame:
    """Adds <value>_adj: the value less both seasons."""
    return decomposed.withColumn(f"{value}_adj", F.col(value) - F.col("season_day") - F.col("season_week"))


def adjust(df: DataFrame, value: str, **options) -> DataFrame:
    """The costly half of an adjusted comparison, independent of its periods."""
    return seasonally_adjust(decompose(df, value, **options), value)
