"""Persistent level shifts, and the shifts nearest to known dates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import numeric, require


def detect_changepoints(df: DataFrame, value: str, entity=("segment_id",), window_days: int = 14, score_threshold: float = 5.0, min_days: int = 5, min_separation_days: int = 7) -> DataFrame:
    """Days at which the daily means of the window before and of that after differ most.

    The score is the absolute Welch statistic of the two windows, each with at least ``min_days`` days.
    A candidate reaches the threshold and is the largest within ``min_separation_days`` on either side,
    the earlier of equal ones. The windows are frames over day numbers, one row a day.
    """
    require(df, value, "local_date", *entity)
    keys = list(entity)
    days = df.where(F.col(value).isNotNull()).groupBy(*keys, "local_date").agg(F.avg(value).alias("_v")).withColumn("_day", F.unix_date("local_date"))
    w = Window.partitionBy(*keys).orderBy("_day")
    before, after = w.rangeBetween(-window_days, -1), w.rangeBetween(0, window_days - 1)
    stats = {f"{n}_{s}": f("_v").over(frame) for s, frame in (("before", before), ("after", after)) for n, f in (("n", F.count), ("avg", F.avg), ("var", F.var_samp))}
    scored = days.withColumns(stats).where((F.col("n_before") >= min_days) & (F.col("n_after") >= min_days))
    se = F.sqrt(F.col("var_before") / F.col("n_before") + F.col("var_after") / F.col("n_after"))
    scored = scored.withColumn("score", F.abs(F.col("avg_after") - F.col("avg_before")) / F.when(se > 0, se)).where(F.col("score") >= score_threshold)
    past = F.max("score").over(w.rangeBetween(-min_separation_days, -1))
    future = F.max("score").over(w.rangeBetween(1, min_separation_days))
    best = scored.withColumns({"_past": past, "_future": future}).where((F.col("_past").isNull() | (F.col("score") > F.col("_past"))) & (F.col("_future").isNull() | (F.col("score") >= F.col("_future"))))
    diff = F.col("avg_after") - F.col("avg_before")
    return best.select(*keys, F.col("local_date").alias("changepoint_date"), "score", F.col("avg_before"), F.col("avg_after"), diff.alias("avg_diff"), (diff / F.when(F.col("avg_before") != 0, F.col("avg_before"))).alias("pct_change"))


#: Days that one task scores at once, besides the windows before and after them.
CHUNK_DAYS = 84


def changepoints_in_time(
    df: DataFrame, value: str, entity=("segment_id",), window_days: int = 14, score_threshold: float = 5.0, min_samples: int = 60, min_separation_days: int = 7,
    robust: bool = False, lower_bound: float | None = None, upper_bound: float | None = None, recent_days: int | None = None, ts: str = "ts_utc",
) -> DataFrame:
    """Instants at which a series' level in the window before and in that after, which the instant begins, differ most.

    Each row is a candidate that has ``min_samples`` values on either side. The score is the absolute difference
    of the means over its standard error, in which a window counts as many independent values as
    local days begin in it, since values of one day go together; ``robust`` takes medians, and quartiles for the
    spread. A change point reaches the threshold and is the largest score within ``min_separation_days``
    on either side, the earlier of equal ones. Values beyond the bounds don't count. With
    ``recent_days`` a shift must still hold: the mean of the series' last days is nearer to the level after it.

    Gives the keys, changepoint_ts, changepoint_date (local), score, avg_before, avg_after, avg_diff and pct_change (a
    fraction). A series is scored in chunks with the rows about them as a halo, by prefix sums of counts, values and squares;
    no task holds a whole series.
    """
    require(df, value, ts, "local_date", *entity)
    numeric(df, value)
    keys = list(entity)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if lower_bound is not None:
        known = known.where(F.col(value) >= lower_bound)
    if upper_bound is not None:
        known = known.where(F.col(value) <= upper_bound)
    rows = known.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.unix_date("local_date").alias("_d"), F.col(value).cast("double").alias("_v"))
    day, halo = 86_400_000_000, window_days + min_separation_days + 1
    chunk = lambda shift: F.floor((F.col("_t") + shift * day) / (CHUNK_DAYS * day)).cast("long")
    spread = rows.withColumn("_own", chunk(0)).withColumn("_chunk", F.explode(F.sequence(chunk(-halo), chunk(halo))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t", kind="stable")
        t, v, d = (pdf[c].to_numpy() for c in ("_t", "_v", "_d"))
        at = np.searchsorted(t, t)  # candidates begin with the first row of their instant
        low, high = np.searchsorted(t, t - window_days * day), np.searchsorted(t, t + window_days * day)
        first = np.concatenate([[True], d[1:] != d[:-1]])
        centre = v.mean()
        sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (v - centre, (v - centre) ** 2, first)]

        def side(a: np.ndarray, b: np.ndarray) -> tuple:
            n = b - a
            total, square, days = (s[b] - s[a] for s in sums)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean, var = total / n, (square - total**2 / n) / (n - 1)
            if robust:
                mean, var = (np.full(len(t), np.nan) for _ in range(2))
                for i in np.flatnonzero(n >= min_samples):
                    q = np.quantile(v[a[i] : b[i]], (0.25, 0.5, 0.75))
                    mean[i], var[i] = q[1] - centre, ((q[2] - q[0]) / 1.349) ** 2
            return n, mean + centre, np.maximum(var, 0), np.maximum(days, 1)

        (nb, mb, vb, db), (na, ma, va, da) = side(low, at), side(at, high)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.abs(ma - mb) / np.sqrt(vb / db + va / da)
        score[(nb < min_samples) | (na < min_samples) | ~np.isfinite(score)] = -1.0
        some = np.flatnonzero((score >= score_threshold) & (at == np.arange(len(t))) & (pdf["_own"] == pdf["_chunk"]).to_numpy())
        apart = min_separation_days * day
        best = [i for i in some if score[i] > max(score[np.searchsorted(t, t[i] - apart) : i], default=-2.0) and score[i] >= score[i : np.searchsorted(t, t[i] + apart, side="right")].max()]
        out = pdf.iloc[best][keys].copy()
        for name, x in (("_t", t), ("_d", d), ("score", score), ("avg_before", mb), ("avg_after", ma)):
            out[name] = x[best]
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    found = spread.groupBy(*keys, "_chunk").applyInPandas(run, f"{fields}, _t long, _d int, score double, avg_before double, avg_after double")
    if recent_days is not None:
        last = rows.groupBy(*keys).agg(F.max("_t").alias("_last"))
        recent = rows.join(last, keys).where(F.col("_t") > F.col("_last") - recent_days * day).groupBy(*keys).agg(F.avg("_v").alias("_recent"))
        found = found.join(recent, keys).where(F.abs(F.col("_recent") - F.col("avg_after")) < F.abs(F.col("_recent") - F.col("avg_before")))
    diff = F.col("avg_after") - F.col("avg_before")
    when = F.timestamp_micros("_t").cast(dict(df.dtypes)[ts])
    return found.select(*keys, when.alias("changepoint_ts"), F.date_from_unix_date("_d").alias("changepoint_date"), "score", "avg_before", "avg_after", diff.alias("avg_diff"), (diff / F.when(F.col("avg_before") != 0, F.col("avg_before"))).alias("pct_change"))


def changepoints_near(changepoints: DataFrame, known_dates: DataFrame, window_days: int = 7, entity=("segment_id",)) -> DataFrame:
    """For each entity and known date (known_date, label) its nearest change point, the earlier of equally near ones.

    Each pair has a row in the result, so the product is no larger than that times the few change points
    of an entity. It is left to the optimiser, which knows their sizes, how it is made.
    """
    distance = F.abs(F.datediff("changepoint_date", "known_date"))
    best = F.min_by(F.struct("changepoint_date", "score", "avg_diff"), F.struct(distance, F.col("changepoint_date")))
    near = changepoints.crossJoin(known_dates).groupBy(*entity, "known_date", "label").agg(best.alias("b"), F.min(distance).alias("days_apart"))
    return near.select(*entity, "known_date", "label", "b.*", "days_apart", (F.col("days_apart") <= window_days).alias("within_window")).orderBy(*entity, "known_date")
