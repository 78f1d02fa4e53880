"""Grouped summaries, rolling averages and free-flow delay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import default_metric, metric_columns, numeric, require
from .blocks import in_blocks


#: Cells of a median's first stage in each doubling of the values.
CELLS = 64


def _cell(v: Column) -> Column:
    """A whole number that grows with a double, CELLS of them to a doubling on either side of zero; NaN comes last."""
    size = F.abs(v)
    power = F.floor(F.log2(size))
    own = power * CELLS + F.least(F.greatest(F.floor((size / F.pow(F.lit(2.0), power) - 1) * CELLS), F.lit(0)), F.lit(CELLS - 1)) + 2000 * CELLS
    return F.when(F.isnan(v), F.lit(2**31 - 1)).when(size == F.lit(float("inf")), F.signum(v) * (2**31 - 2)).when(size < 1e-300, F.lit(0)).otherwise(F.signum(v) * own).cast("int")


def group_medians(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The exact median of ``value`` by group as <value>_median, selected in two stages; groups without a value have no row.

    First the values are counted by group and by cell of near values, which tells for each group the cells,
    two at most, that hold its middle ranks. Then the values of these cells alone are counted and ordered.
    No task holds a group's values, and a group with a third of all rows is ordered by cells.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_c", _cell(F.col("_v")))
    up = Window.partitionBy(*keys).orderBy("_c")
    cells = rows.groupBy(*keys, "_c").agg(F.count("*").alias("_n"))
    cells = cells.withColumns({"_to": F.sum("_n").over(up.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    low, high, before = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1, F.col("_to") - F.col("_n")
    middle = cells.withColumns({"_low": low, "_high": high, "_before": before}).where(((F.col("_before") < F.col("_low")) & (F.col("_low") <= F.col("_to"))) | ((F.col("_before") < F.col("_high")) & (F.col("_high") <= F.col("_to"))))
    # Groups without a key were left out before: plain equality joins.
    near = rows.join(middle.select(*keys, "_c", "_low", "_high", "_before"), [*keys, "_c"]).groupBy(*keys, "_c", "_v").agg(F.count("*").alias("_n"), F.first("_low").alias("_low"), F.first("_high").alias("_high"), F.first("_before").alias("_before"))
    rank = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_c").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda r: F.min(F.when(F.col("_rank") >= F.col(r), F.col("_v")))
    return near.withColumn("_rank", rank).groupBy(*keys).agg(((at("_low") + at("_high")) / 2).alias(f"{value}_median"))


def segment_summary(df: DataFrame, values=None, group_cols=("segment_id", "day_group", "time_bin")) -> DataFrame:
    """count, mean, std (sample) and median of each metric by group; rows with a missing key go, a single value has no std."""
    values = list(values or [m for m in metric_columns(df) if m in ("speed", "travel_time", "delay")])
    require(df, *values, *group_cols)
    numeric(df, *values)
    keys = list(group_cols)
    keyed = df.dropna(subset=keys)
    stats = [f(v).alias(f"{v}_{name}") for v in values for name, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp))]
    out = keyed.groupBy(*keys).agg(*stats)
    for v in values:
        out = out.join(group_medians(keyed, v, keys), keys, "left")
    return out.select(*keys, *(f"{v}_{name}" for v in values for name in ("count", "mean", "std", "median")))


def daily_summary(df: DataFrame, value: str | None = None, group_cols=None) -> DataFrame:
    """By local day: count, mean, std and the band mean +- std."""
    value = value or default_metric(df)
    keys = list(group_cols or (["group_label"] if "group_label" in df.columns else ["day_group", "time_bin"]))
    keys = ["segment_id", *[k for k in keys if k != "segment_id"], "local_date"]
    out = df.dropna(subset=keys).groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.withColumns({"upper": F.col("mean") + F.col("std"), "lower": F.col("mean") - F.col("std")})


def segment_means(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("segment_id").agg(F.avg(value).alias("mean"))


def rolling_average(df: DataFrame, value: str, window: int = 5, group_cols=("segment_id",), direction: str = "trailing", order=("ts_utc",), out: str | None = None, block_rows: int | None = None) -> DataFrame:
    """Mean of the available values among ``window`` rows that end at, begin at or surround each row.

    With ``block_rows`` a series is averaged in blocks of so many rows, so that one that holds most of all
    rows runs in many tasks; the result is the same, for two more shuffles.
    """
    if window < 1:
        raise ValueError("a window has at least one row")
    before = (window - 1) // 2
    frames = {"trailing": (1 - window, 0), "leading": (0, window - 1), "centered": (before + 1 - window, before)}
    if direction not in frames:
        raise ValueError(f"unknown direction: {direction!r}")
    return _framed(df, list(group_cols), list(order), {out or f"{value}_{direction}_{window}": (value, frames[direction])}, block_rows)


def neighbour_averages(df: DataFrame, value: str, rows: int = 5, group_cols=("segment_id",), order=("ts_utc",), block_rows: int | None = None) -> DataFrame:
    """Adds the means of the ``rows`` rows before each row and of those after it, without the row itself; block_rows as in ``rolling_average``."""
    return _framed(df, list(group_cols), list(order), {f"prev_{rows}": (value, (-rows, -1)), f"next_{rows}": (value, (1, rows))}, block_rows)


def _framed(df: DataFrame, group: list[str], order: list[str], means: dict[str, tuple], block_rows: int | None) -> DataFrame:
    """Adds means over frames of rows, by group at once or in blocks."""
    if block_rows is None:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumns({name: F.avg(v).over(w.rowsBetween(*frame)) for name, (v, frame) in means.items()})
    low, high = min(0, *(f[0] for _, f in means.values())), max(0, *(f[1] for _, f in means.values()))
    rows, w = in_blocks(df, group, order, low, high, block_rows)
    rows = rows.withColumns({name: F.avg(v).over(w.rowsBetween(*frame)) for name, (v, frame) in means.items()})
    return rows.where("_own").select(*df.columns, *means)


def parse_free_flow(choice):
    """'ref', or a name and a percentile of 'p85' or of such a pair."""
    if choice == "ref" or isinstance(choice, tuple):
        return choice
    if isinstance(choice, str) and choice[:1] == "p" and choice[1:].replace(".", "", 1).isdigit() and 0 <= float(choice[1:]) <= 100:
        return choice, float(choice[1:])
    raise ValueError(f"not a free-flow choice: {choice!r}")


def free_flow_speed(df: DataFrame, free_flow="ref") -> DataFrame:
    """Adds free_flow: the reference speed, or for 'p85' or ('p85', 85) each segment's percentile of speed, interpolated.

    The percentile is aggregated once a segment, with partial results before the shuffle, and joined back.
    """
    free_flow = parse_free_flow(free_flow)
    if free_flow == "ref":
        require(df, "ref_speed")
        return df.withColumn("free_flow", F.col("ref_speed"))
    _, q = free_flow
    level = df.groupBy("segment_id").agg(F.percentile("speed", F.lit(q / 100.0)).alias("free_flow"))
    return df.join(level, "segment_id", "left")


def segment_delay(df: DataFrame, lengths: DataFrame | None = None, free_flow="ref", floor: bool = True) -> DataFrame:
    """Adds delay in minutes: travel time less that at free flow.

    lengths: segment_id and miles; rows without a length use speed, with which the length cancels:
    tt - tt * v / v_ff. A free-flow speed of zero or none gives NULL; negative delays become 0 if ``floor``.
    """
    require(df, "travel_time")
    if lengths is None and "speed" not in df.columns:
        raise ValueError("delay needs lengths or a speed")
    df = free_flow_speed(df, free_flow)
    fast = F.when(F.col("free_flow") > 0, F.col("free_flow"))
    ideal = F.lit(None).cast("double")
    if "speed" in df.columns:
        ideal = F.col("travel_time") * F.col("speed") / fast
    if lengths is not None:
        df = df.join(lengths.select("segment_id", F.col("miles").cast("double").alias("_miles")), "segment_id", "left")
        ideal = F.coalesce(F.col("_miles") / fast * 60, ideal)
    delay = F.col("travel_time") - ideal
    df = df.withColumn("delay", F.when(delay < 0, F.lit(0.0)).otherwise(delay) if floor else delay)
    return df.drop("_miles", "free_flow")
