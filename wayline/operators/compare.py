"""Before/after comparison: Welch statistics, effect sizes, false-discovery control and a paired test."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as cal
from ..functions.student_t import p_value, t_quantile
from ..schema import Provenance, default_metric, numeric, require
from .filters import between


def _octave(p: Column) -> Column:
    """Which halving of (0, 1] a p lies in: 0 for (0.5, 1]; 1075 for 0."""
    return F.when(p > 0, F.least(F.floor(-F.log2(F.least(p, F.lit(1.0)))), F.lit(1074))).otherwise(F.lit(1075)).cast("int")


def bh_qvalues(df: DataFrame, p: str = "p_value", out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q-values; rows without a p don't count and get none.

    Ranks and the reverse cumulative minimum are scans in three steps, none of which orders all rows in
    one task: within cells of nearly equal p (256 to a halving of p), over a halving's cells, and over the
    halvings, of which doubles have 1076. The scans run over counts of distinct p, not over the rows.
    """
    value = F.col("_p")
    octave = _octave(value)
    share = F.least(F.floor((value * F.pow(F.lit(2.0), octave.cast("double") + 1) - 1) * 256), F.lit(255))
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("_p")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_o", -octave).withColumn("_cell", (F.col("_o") * 256 + F.greatest(F.when(octave <= 1022, share).otherwise(0), F.lit(0))).cast("int"))
    keys = ("_o", "_cell")
    cell, halving = Window.partitionBy(*keys).orderBy("_p"), Window.partitionBy("_o").orderBy("_cell")
    earlier, later = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    of_halving = lambda f, c: F.collect_list(F.struct("_o", F.col(c).alias("v")))

    cells = counts.groupBy(*keys).agg(F.sum("_n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(halving.rowsBetween(*earlier)), F.lit(0)))
    halvings = counts.groupBy("_o").agg(F.sum("_n").alias("_s")).agg(of_halving(F.sum, "_s").alias("_all"))
    below = F.aggregate("_all", F.lit(0).cast("long"), lambda s, x: s + F.when(x["_o"] < F.col("_o"), x["v"]).otherwise(0))
    total = F.aggregate("_all", F.lit(0).cast("long"), lambda s, x: s + x["v"])
    placed = cells.crossJoin(F.broadcast(halvings)).select(*keys, (F.col("_before") + below).alias("_before"), total.alias("_m"))
    rank = F.col("_before") + F.sum("_n").over(cell.rowsBetween(Window.unboundedPreceding, 0))
    raw = counts.join(placed, list(keys)).withColumn("_raw", F.least(value * F.col("_m") / rank, F.lit(1.0)))

    least = raw.groupBy(*keys).agg(F.min("_raw").alias("_raw")).withColumn("_after", F.min("_raw").over(halving.rowsBetween(*later)))
    leasts = raw.groupBy("_o").agg(F.min("_raw").alias("_s")).agg(of_halving(F.min, "_s").alias("_all"))
    above = F.aggregate("_all", F.lit(1.0), lambda s, x: F.least(s, F.when(x["_o"] > F.col("_o"), x["v"])))
    beyond = least.crossJoin(F.broadcast(leasts)).select(*keys, F.least("_after", above).alias("_after"))
    q = raw.join(beyond, list(keys)).select("_p", F.greatest(F.least(F.min("_raw").over(cell.rowsBetween(0, Window.unboundedFollowing)), "_after"), F.lit(0.0)).alias(out))
    return df.join(q, F.col(p).cast("double") == F.col("_p"), "left").drop("_p")


def welch_columns(confidence: float = 0.95, inference: bool = True) -> dict[str, Column]:
    """Statistics from n_, mean_ and var_ of before and after; undefined ones are NULL."""
    a, b = F.col("var_before") / F.col("n_before"), F.col("var_after") / F.col("n_after")
    se = F.sqrt(a + b)
    positive = F.when(se > 0, se)
    dof = F.when(se > 0, (a + b) * (a + b) / (a * a / (F.col("n_before") - 1) + b * b / (F.col("n_after") - 1)))
    effect = F.col("mean_after") - F.col("mean_before")
    pooled = F.sqrt(((F.col("n_before") - 1) * F.col("var_before") + (F.col("n_after") - 1) * F.col("var_after")) / (F.col("n_before") + F.col("n_after") - 2))
    out = {"effect": effect, "se": se, "dof": dof, "t_stat": effect / positive, "cohens_d": effect / F.when(pooled > 0, pooled), "pct_change": 100 * effect / F.when(F.col("mean_before") != 0, F.col("mean_before"))}
    if inference:
        half = t_quantile(0.5 + confidence / 2, F.col("dof")) * F.col("se")
        out |= {"p_value": p_value(F.col("t_stat"), F.col("dof")), "ci_low": F.col("effect") - half, "ci_high": F.col("effect") + half}
    return out


def _wall_days(start: Column, end: datetime) -> Column:
    """Days, with fractions, from a local wall-clock time to another; none if they are in the other order."""
    micros = F.timestamp_diff("MICROSECOND", start, F.lit(end).cast("timestamp_ntz"))
    return F.greatest(micros / (cal.DAY * 1e6), F.lit(0.0))


def compare_values(df: DataFrame, before, after, value: str | None = None, by=(), unit: str = "day", min_samples: int = 2, confidence: float = 0.95, inference: bool = True, method: str = "raw") -> DataFrame:
    """One row for each segment (and ``by``): n, mean, spread, effect and Welch's test between two local periods.

    unit 'day' compares means of local days, 'sample' the rows themselves. Groups with fewer than
    ``min_samples`` units on a side, or with a missing key, have no row. n_samples_* count the rows with a
    value in each period; *_days_effective are the days of a period, with fractions, from the group's
    own first row on, be that later than the others' or after a warm-up; ``method`` is noted.
    """
    if unit not in ("day", "sample"):
        raise ValueError("unit is 'day' or 'sample'")
    first, second = cal.check_periods(before, after)
    value = value or default_metric(df)
    keys = ["segment_id", *by]
    require(df, value, "local_ts", *keys)
    numeric(df, value)
    side = F.when(between(*first), F.lit("before")).when(between(*second), F.lit("after"))
    rows = df.dropna(subset=keys).withColumn("_side", side)
    if unit == "day":
        rows = rows.groupBy(*keys, "_side", "local_date").agg(F.avg(value).alias("_v"), F.count(value).alias("_n"), F.min("local_ts").alias("_start"))
    else:
        rows = rows.select(*keys, "_side", F.col(value).cast("double").alias("_v"), F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("long").alias("_n"), F.col("local_ts").alias("_start"))
    of = lambda s, c="_v": F.when(F.col("_side") == s, F.col(c))
    sides = ("before", "after")
    stats = [f(of(s)).alias(f"{n}_{s}") for s in sides for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    stats += [F.sum(of(s, "_n")).alias(f"n_samples_{s}") for s in sides]
    out = rows.groupBy(*keys).agg(*stats, F.min("_start").alias("_start")).where((F.col("n_before") >= min_samples) & (F.col("n_after") >= min_samples))
    days = {f"{s}_days_effective": _wall_days(F.greatest("_start", F.lit(p[0]).cast("timestamp_ntz")), p[1]) for s, p in zip(sides, (first, second))}
    out = out.withColumns(days | {"method": F.lit(method)}).drop("_start")
    for name, column in welch_columns(confidence, inference).items():
        out = out.withColumn(name, column)
    return bh_qvalues(out) if inference else out


def effective_days(df: DataFrame, before, after, warmup_days: int = 0) -> DataFrame:
    """segment_id, first_date, late_start, warmup_overlap and the days of each period that its own series covers."""
    (a, b), (c, d) = cal.check_periods(before, after)
    starts = df.groupBy("segment_id").agg(F.min("local_date").alias("first_date"))
    ready = F.date_add("first_date", warmup_days)
    days = lambda s, e: F.greatest(F.datediff(F.lit(e.date()), F.greatest(ready, F.lit(s.date()))), F.lit(0))
    return starts.select("segment_id", "first_date", (F.col("first_date") > F.lit(a.date())).alias("late_start"), (ready > F.lit(a.date())).alias("warmup_overlap"), days(a, b).alias("days_before"), days(c, d).alias("days_after"))


def warnings(df: DataFrame, before, after, provenance: Provenance, warmup_days: int = 0) -> Provenance:
    """Adds notes on series that start late or whose warm-up reaches into the first period: one small action, on request."""
    row = effective_days(df, before, after, warmup_days).agg(F.count_if("late_start").alias("late"), F.count_if("warmup_overlap").alias("warm")).first()
    for n, text in ((row["late"], "segments start after the first period begins"), (row["warm"], "segments warm up within the first period")):
        provenance = provenance.warned(f"{n} {text}") if n else provenance
    return provenance


def ttest_by_slot(df: DataFrame, before, after, value: str | None = None, by=(), slot_minutes: int = 15, inference: bool = True) -> DataFrame:
    """Paired test over times of day: mean by slot on each side, slots with both, at least two of them."""
    first, second = cal.check_periods(before, after)
    value = value or default_metric(df)
    keys = ["segment_id", *by]
    of = lambda p: F.avg(F.when(between(*p), F.col(value)))
    slots = df.dropna(subset=keys).groupBy(*keys, cal.floor_seconds(slot_minutes).alias("slot")).agg(of(first).alias("b"), of(second).alias("a"))
    paired = slots.where("a IS NOT NULL AND b IS NOT NULL").groupBy(*keys).agg(F.avg(F.col("a") - F.col("b")).alias("avg_difference"), F.stddev_samp(F.col("a") - F.col("b")).alias("_s"), F.count("*").alias("n_bins"))
    out = paired.where("n_bins >= 2").withColumn("t_stat", F.col("avg_difference") / F.when(F.col("_s") > 0, F.col("_s") / F.sqrt("n_bins"))).drop("_s")
    return out.withColumn("p_value", p_value(F.col("t_stat"), F.col("n_bins") - 1)) if inference else out


def compare_adjusted(adjusted: DataFrame, before, after, value: str, **options) -> DataFrame:
    """The cheap half of a seasonally adjusted comparison: ``adjusted`` comes from decompose.adjust and may be kept for many periods."""
    return compare_values(adjusted, before, after, f"{value}_adj", **({"method": "decomposed"} | options))

