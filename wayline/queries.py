"""Registered queries: each operator applied to whole driver tables, with DuckDB SQL that says the same.

``events`` serves as observations: event_type is the corridor, user_id the segment, value the travel
time, props.k the confidence. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calendar as cal
from .functions import labels
from .operators import compare, completeness, decompose, filters, geometry, nearest, shifts, summarize, weights
from .plans import analysis
from .schema import Study, pin_utc
from .sources import kml, sinks, store

BEFORE, AFTER = "20240109-20240118", "20240120-20240129"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}

_OBS = """obs AS (SELECT event_id AS obs_id, CAST(ts AS TIMESTAMP) AS ts_utc, CAST(user_id AS BIGINT) AS segment_id, event_type AS corridor, CAST(value AS DOUBLE) AS travel_time,
  60.0::DOUBLE / (1 + value) AS speed, CAST(props->>'k' AS DOUBLE) AS cvalue FROM events),
cal0 AS (SELECT *, (ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Denver' AS local_ts FROM obs),
cal AS (SELECT *, CAST(local_ts AS DATE) AS local_date, CAST(isodow(local_ts) - 1 AS INTEGER) AS dow, CAST(hour(local_ts) * 3600 + minute(local_ts) * 60 + second(local_ts) AS INTEGER) AS tod_sec FROM cal0)"""
_GROUPS = """grp AS (SELECT *, CASE WHEN dow <= 3 THEN 'Mon–Thu' WHEN dow = 4 THEN 'Fri' WHEN dow = 5 THEN 'Sat' ELSE 'Sun' END AS day_group,
  CASE WHEN tod_sec >= 23400 AND tod_sec < 32400 THEN '6:30AM-9:00AM' WHEN tod_sec >= 32400 AND tod_sec < 50400 THEN '9:00AM-2:00PM' WHEN tod_sec >= 50400 AND tod_sec < 68400 THEN '2:00PM-7:00PM' ELSE '7:00PM-6:30AM' END AS time_bin FROM cal)"""
_HOURLY = f"""{_OBS}, hourly AS (SELECT corridor, date_trunc('hour', ts_utc) AS ts_utc, avg(travel_time) AS travel_time FROM obs GROUP BY ALL),
hcal0 AS (SELECT *, (ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Denver' AS local_ts FROM hourly),
hcal AS (SELECT *, CAST(local_ts AS DATE) AS local_date, CAST(isodow(local_ts) - 1 AS INTEGER) AS dow, CAST(hour(local_ts) * 3600 AS INTEGER) AS tod_sec FROM hcal0),
med AS (SELECT *, median(travel_time) OVER w AS median, count(travel_time) OVER w AS n_window, min(local_ts) OVER (PARTITION BY corridor) AS begin_ts FROM hcal
  WINDOW w AS (PARTITION BY corridor ORDER BY ts_utc RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)),
kept AS (SELECT *, travel_time - median AS free FROM med WHERE local_ts >= begin_ts + INTERVAL 7 DAYS AND n_window >= 40),
sd AS (SELECT corridor, tod_sec, avg(free) AS season_day FROM kept GROUP BY ALL),
sw AS (SELECT k.corridor, dow, k.tod_sec, avg(free - season_day) AS season_week FROM kept k JOIN sd USING (corridor, tod_sec) GROUP BY ALL),
dec AS (SELECT k.*, season_day, season_week, greatest(median + season_day + season_week, 0) AS prediction FROM kept k JOIN sd USING (corridor, tod_sec) JOIN sw USING (corridor, dow, tod_sec))"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` under canonical names."""
    value = F.col("value").cast("double")
    return table(pin_utc(spark), sf_dir, "events").select(
        F.col("event_id").alias("obs_id"), F.col("ts").cast("timestamp_ntz").alias("ts_utc"), F.col("user_id").cast("long").alias("segment_id"), F.col("event_type").alias("corridor"),
        value.alias("travel_time"), (F.lit(60.0) / (1 + value)).alias("speed"), F.get_json_object("props", "$.k").cast("double").alias("cvalue"),
    )


def local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.to_local(observations(spark, sf_dir))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.assign_time_bins(filters.assign_day_group(local(spark, sf_dir)))


def thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly slots of three segments a corridor, some of them missing."""
    hour = F.date_trunc("hour", F.col("ts_utc").cast("timestamp")).cast("timestamp_ntz")
    return observations(spark, sf_dir).withColumns({"segment_id": F.col("segment_id") % 3, "ts_utc": hour})


_THIRDS = f"{_OBS}, t AS (SELECT * REPLACE (segment_id % 3 AS segment_id, date_trunc('hour', ts_utc) AS ts_utc) FROM obs)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five regular hourly series, one a corridor, with local columns."""
    hour = F.date_trunc("hour", F.col("ts_utc").cast("timestamp")).cast("timestamp_ntz")
    return cal.to_local(observations(spark, sf_dir).groupBy("corridor", hour.alias("ts_utc")).agg(F.avg("travel_time").alias("travel_time")))


def r6(df: DataFrame, *names: str, above: float = 0.0) -> DataFrame:
    """Rounded to six places. above: added first, where exact halves are common and sums differ in their last bits."""
    return df.withColumns({n: F.round(F.col(n) + above, 6) for n in names})


# --- filters and calendar ---------------------------------------------------------------------------


@query(f"WITH {_OBS} SELECT obs_id, segment_id, cvalue FROM obs WHERE cvalue > 80")
def filter_confidence(spark, sf_dir):
    return filters.filter_confidence(observations(spark, sf_dir), 80).select("obs_id", "segment_id", "cvalue")


@query(f"WITH {_OBS} SELECT obs_id, local_ts, local_date, dow, tod_sec FROM cal")
def local_calendar(spark, sf_dir):
    return local(spark, sf_dir).select("obs_id", "local_ts", "local_date", "dow", "tod_sec")


@query(f"WITH {_OBS} SELECT obs_id, tod_sec FROM cal WHERE tod_sec >= 79200 OR tod_sec < 18000")
def window_tod_overnight(spark, sf_dir):
    return filters.filter_time_window(local(spark, sf_dir), "10PM-5AM").select("obs_id", "tod_sec")


@query(f"WITH {_OBS} SELECT obs_id, dow FROM cal WHERE dow IN (1, 5)")
def filter_dow(spark, sf_dir):
    return filters.filter_day_of_week(local(spark, sf_dir), ["Tue", "Saturday"]).select("obs_id", "dow")


@query(f"WITH {_OBS} SELECT obs_id, local_date FROM cal WHERE local_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def filter_dates(spark, sf_dir):
    return filters.filter_date_range(local(spark, sf_dir), "2024-01-05", "2024-01-12").select("obs_id", "local_date")


@query(f"WITH {_OBS}, {_GROUPS} SELECT obs_id, day_group || ', ' || time_bin AS group_label FROM grp")
def group_labels(spark, sf_dir):
    return filters.assign_group_label(grouped(spark, sf_dir)).select("obs_id", "group_label")


@query(f"WITH {_OBS} SELECT obs_id FROM cal WHERE segment_id IN (SELECT CAST(c_custkey AS BIGINT) FROM customer WHERE c_acctbal > 0)")
def members_semi_join(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("long").alias("segment_id"))
    return filters.filter_members(local(spark, sf_dir), rich).select("obs_id")


# --- summaries --------------------------------------------------------------------------------------


@query(f"""WITH {_OBS}, {_GROUPS} SELECT corridor, day_group, time_bin, count(travel_time) AS travel_time_count, round(avg(travel_time), 6) AS travel_time_mean,
  round(stddev_samp(travel_time), 6) AS travel_time_std, round(median(travel_time), 6) AS travel_time_median FROM grp WHERE cvalue > 80 GROUP BY ALL""")
def daygroup_timebin_summary(spark, sf_dir):
    rows = filters.filter_confidence(grouped(spark, sf_dir), 80)
    out = summarize.segment_summary(rows, ["travel_time"], ("corridor", "day_group", "time_bin"))
    return r6(out, "travel_time_mean", "travel_time_std", "travel_time_median")


@query(f"""WITH {_OBS}, {_GROUPS} SELECT segment_id, day_group, time_bin, local_date, count(travel_time) AS count, round(avg(travel_time), 6) AS mean, round(stddev_samp(travel_time), 6) AS std,
  round(avg(travel_time) + stddev_samp(travel_time), 6) AS upper, round(avg(travel_time) - stddev_samp(travel_time), 6) AS lower FROM grp GROUP BY segment_id, day_group, time_bin, local_date""")
def daily_bands(spark, sf_dir):
    return r6(summarize.daily_summary(grouped(spark, sf_dir), "travel_time"), "mean", "std", "upper", "lower")


@query(f"WITH {_OBS} SELECT segment_id, round(avg(travel_time), 6) AS mean FROM cal WHERE tod_sec >= 21600 AND tod_sec < 36000 AND dow < 5 GROUP BY segment_id")
def segment_means(spark, sf_dir):
    return r6(summarize.segment_means(filters.filter_when(local(spark, sf_dir), (6, 10), range(5)), "travel_time"), "mean")


def _rolling(direction):
    def run(spark, sf_dir):
        out = summarize.rolling_average(observations(spark, sf_dir), "travel_time", 5, direction=direction, order=("ts_utc", "obs_id"), out="rolling")
        return r6(out.select("obs_id", "rolling"), "rolling")

    run.__name__ = f"rolling_{direction}"
    return run


for _direction, _frame in (("trailing", "4 PRECEDING AND CURRENT ROW"), ("leading", "CURRENT ROW AND 4 FOLLOWING"), ("centered", "2 PRECEDING AND 2 FOLLOWING")):
    query(f"WITH {_OBS} SELECT obs_id, round(avg(travel_time) OVER (PARTITION BY segment_id ORDER BY ts_utc, obs_id ROWS BETWEEN {_frame}), 6) AS rolling FROM obs")(_rolling(_direction))


@query(f"""WITH {_OBS} SELECT obs_id, round(avg(travel_time) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS prev_5, round(avg(travel_time) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 6) AS next_5
  FROM obs WINDOW w AS (PARTITION BY segment_id ORDER BY ts_utc, obs_id)""")
def neighbour_averages(spark, sf_dir):
    return r6(summarize.neighbour_averages(observations(spark, sf_dir), "travel_time", order=("ts_utc", "obs_id")).select("obs_id", "prev_5", "next_5"), "prev_5", "next_5")


@query(f"WITH {_OBS} SELECT segment_id, round(quantile_cont(speed, 0.85), 6) AS free_flow FROM obs GROUP BY segment_id")
def freeflow_percentile(spark, sf_dir):
    return r6(summarize.free_flow_speed(observations(spark, sf_dir), ("p85", 85)).select("segment_id", "free_flow").distinct(), "free_flow")


def _lengths(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("long").alias("segment_id"), (F.col("c_custkey") % 17 / F.lit(10.0)).alias("miles"))


@query(f"""WITH {_OBS}, ff AS (SELECT segment_id, quantile_cont(speed, 0.85) AS v FROM obs GROUP BY segment_id),
  l AS (SELECT CAST(c_custkey AS BIGINT) AS segment_id, (c_custkey % 17) / 10.0::DOUBLE AS miles FROM customer WHERE c_acctbal > 0)
  SELECT obs_id, round(greatest(travel_time - coalesce(miles / v * 60, travel_time * speed / v), 0), 6) AS delay FROM obs JOIN ff USING (segment_id) LEFT JOIN l USING (segment_id)""")
def segment_delay(spark, sf_dir):
    return r6(summarize.segment_delay(observations(spark, sf_dir), _lengths(spark, sf_dir), ("p85", 85)).select("obs_id", "delay"), "delay")


# --- completeness -----------------------------------------------------------------------------------


def _complete_sql(expected):
    return f"""WITH {_THIRDS}, n AS (SELECT corridor, ts_utc, count(DISTINCT segment_id) AS n_segments FROM t GROUP BY ALL), e AS ({expected})
  SELECT obs_id, n_segments, expected, n_segments >= expected AS complete FROM t JOIN n USING (corridor, ts_utc) JOIN e USING (corridor)"""


@query(_complete_sql("SELECT corridor, max(n_segments) AS expected FROM n GROUP BY corridor"))
def complete_flags_max(spark, sf_dir):
    return completeness.mark_complete(thirds(spark, sf_dir), "max").select("obs_id", "n_segments", "expected", "complete")


@query(_complete_sql("SELECT corridor, count(DISTINCT segment_id) AS expected FROM t GROUP BY corridor"))
def complete_flags_total(spark, sf_dir):
    return completeness.mark_complete(thirds(spark, sf_dir), "total").select("obs_id", "n_segments", "expected", "complete")


@query(f"""WITH {_THIRDS}, n AS (SELECT corridor, ts_utc, count(DISTINCT segment_id) AS n FROM t GROUP BY ALL), e AS (SELECT corridor, max(n) AS expected FROM n GROUP BY corridor)
  SELECT corridor, ts_utc, round(sum(travel_time), 6) AS travel_time, count(DISTINCT segment_id) AS n_segments, any_value(expected) AS expected, true AS complete FROM t JOIN e USING (corridor) GROUP BY corridor, ts_utc HAVING count(DISTINCT segment_id) >= any_value(expected)""")
def corridor_total(spark, sf_dir):
    return r6(completeness.corridor_travel_time(thirds(spark, sf_dir), value="travel_time"), "travel_time")


@query(f"""WITH {_THIRDS}, e AS (SELECT count(DISTINCT segment_id) AS expected FROM t)
  SELECT 'Network' AS corridor, ts_utc, round(sum(travel_time), 6) AS travel_time, count(DISTINCT segment_id) AS n_segments, any_value(expected) AS expected, count(DISTINCT segment_id) >= any_value(expected) AS complete FROM t, e GROUP BY ts_utc""")
def network_total(spark, sf_dir):
    return r6(completeness.network_travel_time(thirds(spark, sf_dir), value="travel_time", require_complete=False), "travel_time")


def _nation_lengths(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("segment_id"), (F.col("n_nationkey") + F.lit(0.5)).alias("miles"))


@query(f"""WITH {_THIRDS}, m AS (SELECT corridor, sum(segment_id + 0.5::DOUBLE) AS miles FROM (SELECT DISTINCT corridor, segment_id FROM t) GROUP BY corridor)
  SELECT corridor, ts_utc, any_value(miles) AS miles, round(any_value(miles) / (sum(travel_time) / 60), 6) AS mph FROM t JOIN m USING (corridor) GROUP BY corridor, ts_utc""")
def corridor_speed(spark, sf_dir):
    out = completeness.corridor_travel_time(thirds(spark, sf_dir), _nation_lengths(spark, sf_dir), require_complete=False, value="travel_time")
    return r6(out.select("corridor", "ts_utc", "miles", "mph"), "mph")


@query(f"""WITH {_HOURLY.split(", hourly AS")[0]}, p AS (SELECT DISTINCT date_trunc('hour', ts_utc) AS ts_utc, CASE corridor {{names}} END AS segment_id FROM obs),
  b AS (SELECT ts_utc, count(*) AS n FROM p GROUP BY ts_utc), s AS (SELECT ts_utc FROM b WHERE n = (SELECT count(DISTINCT segment_id) - 1 FROM p))
  SELECT segment_id, count(*) AS n_reported, (SELECT count(*) FROM b) AS n_timestamps, round(count(*) / (SELECT count(*) FROM b)::DOUBLE, 6) AS coverage,
  (SELECT count(*) FROM s) - count(*) FILTER (WHERE ts_utc IN (SELECT ts_utc FROM s)) AS complete_set_cost FROM p GROUP BY segment_id""".replace("CASE corridor {names} END", "CAST(length(corridor) AS BIGINT)"))
def coverage_cost(spark, sf_dir):
    """Segments are told apart by the length of their corridor's name."""
    rows = hourly(spark, sf_dir).withColumn("segment_id", F.length("corridor").cast("long"))
    return r6(completeness.segment_coverage(rows, value="travel_time"), "coverage")


# --- before and after -------------------------------------------------------------------------------


def _welch_sql(unit):
    source = "SELECT corridor, side, local_date, avg(travel_time) AS v FROM s GROUP BY ALL" if unit == "day" else "SELECT corridor, side, travel_time AS v FROM s"
    return f"""WITH {_OBS}, s AS (SELECT *, CASE WHEN local_ts >= TIMESTAMP '2024-01-09' AND local_ts < TIMESTAMP '2024-01-19' THEN 'b' WHEN local_ts >= TIMESTAMP '2024-01-20' AND local_ts < TIMESTAMP '2024-01-30' THEN 'a' END AS side FROM cal),
  u AS ({source}),
  g AS (SELECT corridor, count(v) FILTER (side = 'b') AS nb, avg(v) FILTER (side = 'b') AS mb, var_samp(v) FILTER (side = 'b') AS vb, count(v) FILTER (side = 'a') AS na, avg(v) FILTER (side = 'a') AS ma, var_samp(v) FILTER (side = 'a') AS va FROM u WHERE side IS NOT NULL GROUP BY corridor)
  SELECT corridor, nb AS n_before, round(mb, 6) AS mean_before, na AS n_after, round(ma, 6) AS mean_after, round(ma - mb, 6) AS effect, round(sqrt(vb / nb + va / na), 6) AS se,
    round(power(vb / nb + va / na, 2) / (power(vb / nb, 2) / (nb - 1) + power(va / na, 2) / (na - 1)), 6) AS dof, round((ma - mb) / sqrt(vb / nb + va / na), 6) AS t_stat,
    round((ma - mb) / sqrt(((nb - 1) * vb + (na - 1) * va) / (nb + na - 2)), 6) AS cohens_d FROM g WHERE nb >= 2 AND na >= 2"""


def _compare(spark, sf_dir, unit):
    rows = local(spark, sf_dir).withColumn("segment_id", F.col("corridor"))
    out = compare.compare_values(rows, BEFORE, AFTER, "travel_time", unit=unit, inference=False)
    names = ["mean_before", "mean_after", "effect", "se", "dof", "t_stat", "cohens_d"]
    return r6(out, *names).select(F.col("segment_id").alias("corridor"), "n_before", "n_after", *names)


@query(_welch_sql("day"))
def compare_raw_day(spark, sf_dir):
    return _compare(spark, sf_dir, "day")


@query(_welch_sql("sample"))
def compare_raw_sample(spark, sf_dir):
    return _compare(spark, sf_dir, "sample")


_SIDES = "CASE WHEN local_ts >= TIMESTAMP '2024-01-09' AND local_ts < TIMESTAMP '2024-01-19' THEN 'b' WHEN local_ts >= TIMESTAMP '2024-01-20' AND local_ts < TIMESTAMP '2024-01-30' THEN 'a' END AS side"


@query(f"""WITH {_OBS}, {_GROUPS}, s AS (SELECT corridor, day_group, local_date, local_ts, travel_time, {_SIDES} FROM grp WHERE corridor <> 'view' OR local_ts >= TIMESTAMP '2024-01-11 06:00:00'),
  d AS (SELECT corridor, day_group, side, local_date, avg(travel_time) AS v, count(travel_time) AS n, min(local_ts) AS first_ts FROM s GROUP BY ALL),
  g AS (SELECT corridor, day_group, count(v) FILTER (side = 'b') AS n_before, count(v) FILTER (side = 'a') AS n_after, CAST(sum(n) FILTER (side = 'b') AS BIGINT) AS n_samples_before, CAST(sum(n) FILTER (side = 'a') AS BIGINT) AS n_samples_after,
    avg(v) FILTER (side = 'a') - avg(v) FILTER (side = 'b') AS effect, min(first_ts) AS first_ts FROM d GROUP BY ALL)
  SELECT corridor, day_group, n_before, n_after, n_samples_before, n_samples_after, round(effect, 6) AS effect, 'raw' AS method,
    round(greatest(date_diff('microsecond', greatest(first_ts, TIMESTAMP '2024-01-09'), TIMESTAMP '2024-01-19') / 86400000000.0::DOUBLE, 0), 6) AS before_days_effective,
    round(greatest(date_diff('microsecond', greatest(first_ts, TIMESTAMP '2024-01-20'), TIMESTAMP '2024-01-30') / 86400000000.0::DOUBLE, 0), 6) AS after_days_effective FROM g WHERE n_before >= 2 AND n_after >= 2""")
def compare_by_day_group(spark, sf_dir):
    """By corridor and day group; one corridor starts within the first period."""
    rows = filters.assign_day_group(local(spark, sf_dir)).where("corridor <> 'view' OR local_ts >= TIMESTAMP_NTZ '2024-01-11 06:00:00'").withColumn("segment_id", F.col("corridor"))
    out = compare.compare_values(rows, BEFORE, AFTER, "travel_time", by=["day_group"], inference=False)
    counts = ["n_before", "n_after", "n_samples_before", "n_samples_after"]
    shown = ["effect", "before_days_effective", "after_days_effective"]
    return r6(out, *shown).select(F.col("segment_id").alias("corridor"), "day_group", *counts, "method", *shown)


@query()
def compare_ci_pvalues(spark, sf_dir):
    """Confidence intervals, p and q: the t distribution is computed here, not by SQL; tests hold it against known values."""
    out = compare.compare_values(local(spark, sf_dir), BEFORE, AFTER, "travel_time")
    return out.select("segment_id", "n_before", "n_after", "effect", "ci_low", "ci_high", "p_value", "q_value")


@query("""WITH p AS (SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 7919 % 1000) / 1000.0::DOUBLE END AS p FROM customer),
  k AS (SELECT *, rank() OVER (ORDER BY p DESC) AS down, count(*) OVER () AS m FROM p WHERE p IS NOT NULL),
  c AS (SELECT id, p, p * m / (m - down + 1) AS raw FROM k), q AS (SELECT id, least(min(raw) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM c)
  SELECT p.id, p.p, round(q.q, 6) AS q FROM p LEFT JOIN q ON p.id = q.id""")
def bh_qvalues(spark, sf_dir):
    key = F.col("c_custkey").cast("long")
    rows = table(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 11 != 0, (key * 7919 % 1000) / F.lit(1000.0)).alias("p"))
    return r6(compare.bh_qvalues(rows, "p", "q"), "q")


@query(f"""WITH {_OBS}, s AS (SELECT corridor, tod_sec // 900 AS slot, avg(travel_time) FILTER (local_ts >= TIMESTAMP '2024-01-09' AND local_ts < TIMESTAMP '2024-01-19') AS b, avg(travel_time) FILTER (local_ts >= TIMESTAMP '2024-01-20' AND local_ts < TIMESTAMP '2024-01-30') AS a FROM cal GROUP BY ALL)
  SELECT corridor, round(avg(a - b), 6) AS avg_difference, count(*) AS n_bins, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t_stat FROM s WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY corridor HAVING count(*) >= 2""")
def paired_tod_ttest(spark, sf_dir):
    rows = local(spark, sf_dir).withColumn("segment_id", F.col("corridor"))
    return r6(compare.ttest_by_slot(rows, BEFORE, AFTER, "travel_time", inference=False), "avg_difference", "t_stat").withColumnRenamed("segment_id", "corridor")


@query(f"""WITH {_OBS}, f AS (SELECT segment_id, min(local_date) AS first_date FROM cal GROUP BY segment_id)
  SELECT segment_id, first_date, first_date > DATE '2024-01-09' AS late_start, first_date + 7 > DATE '2024-01-09' AS warmup_overlap,
  CAST(greatest(date_diff('day', greatest(first_date + 7, DATE '2024-01-09'), DATE '2024-01-19'), 0) AS INTEGER) AS days_before, CAST(greatest(date_diff('day', greatest(first_date + 7, DATE '2024-01-20'), DATE '2024-01-30'), 0) AS INTEGER) AS days_after FROM f""")
def effective_days(spark, sf_dir):
    return compare.effective_days(local(spark, sf_dir), BEFORE, AFTER, 7)


# --- decomposition and shifts -----------------------------------------------------------------------


@query(f"WITH {_HOURLY} SELECT corridor, ts_utc, round(median, 6) AS median, n_window FROM med")
def rolling_median_7d(spark, sf_dir):
    out = decompose.rolling_median(hourly(spark, sf_dir), "travel_time", ("corridor",))
    return r6(out.select("corridor", "ts_utc", "median", "n_window"), "median")


def _decomposed(spark, sf_dir):
    return decompose.decompose(hourly(spark, sf_dir), "travel_time", ("corridor",), freq_minutes=60, min_samples=40)


@query(f"""WITH {_HOURLY} SELECT corridor, ts_utc, round(median + 1e-9, 6) AS median, round(season_day + 1e-9, 6) AS season_day, round(season_week + 1e-9, 6) AS season_week, round(prediction + 1e-9, 6) AS prediction, round(travel_time - prediction + 1e-9, 6) AS resid FROM dec""")
def decompose_hourly(spark, sf_dir):
    names = ["median", "season_day", "season_week", "prediction", "resid"]
    return r6(_decomposed(spark, sf_dir).select("corridor", "ts_utc", *names), *names, above=1e-9)


@query(f"WITH {_HOURLY} SELECT corridor, ts_utc, round(travel_time - season_day - season_week + 1e-9, 6) AS travel_time_adj FROM dec")
def seasonal_adjust(spark, sf_dir):
    return r6(decompose.seasonally_adjust(_decomposed(spark, sf_dir), "travel_time").select("corridor", "ts_utc", "travel_time_adj"), "travel_time_adj", above=1e-9)


@query(f"""WITH {_HOURLY}, s AS (SELECT corridor, local_date, avg(travel_time - season_day - season_week) AS v, CASE WHEN local_date BETWEEN DATE '2024-01-09' AND DATE '2024-01-18' THEN 'b' WHEN local_date BETWEEN DATE '2024-01-20' AND DATE '2024-01-29' THEN 'a' END AS side FROM dec GROUP BY ALL)
  SELECT corridor, count(v) FILTER (side = 'b') AS n_before, count(v) FILTER (side = 'a') AS n_after, round(avg(v) FILTER (side = 'a') - avg(v) FILTER (side = 'b') + 1e-9, 6) AS effect FROM s WHERE side IS NOT NULL GROUP BY corridor""")
def compare_adjusted(spark, sf_dir):
    adjusted = decompose.seasonally_adjust(_decomposed(spark, sf_dir), "travel_time").withColumn("segment_id", F.col("corridor"))
    out = compare.compare_adjusted(adjusted, BEFORE, AFTER, "travel_time", inference=False)
    return r6(out.select(F.col("segment_id").alias("corridor"), "n_before", "n_after", "effect"), "effect", above=1e-9)


@query(f"""WITH {_OBS} SELECT f AS freq_minutes, CAST(greatest(1, round_even(480 * least(1.0::DOUBLE, count(DISTINCT tod_sec // (60 * f)) / (1440.0::DOUBLE / f)), 0)) AS BIGINT) AS min_samples
  FROM cal, (SELECT CAST(unnest([5, 15, 60]) AS INTEGER) AS f) WHERE tod_sec >= 57600 AND tod_sec < 64800 GROUP BY f""")
def auto_min_samples(spark, sf_dir):
    """At three cadences: two hours of the day are a twelfth of its slots at each."""
    rows = filters.filter_time_window(local(spark, sf_dir), "4PM-6PM")
    return decompose.min_samples(rows, 5, 15, 60)


_SHIFT = """days AS (SELECT CAST(l_suppkey AS BIGINT) AS segment_id, CAST(l_shipdate AS DATE) AS local_date, avg(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY ALL),
  st AS (SELECT *, count(v) OVER b AS nb, avg(v) OVER b AS mb, var_samp(v) OVER b AS vb, count(v) OVER a AS na, avg(v) OVER a AS ma, var_samp(v) OVER a AS va FROM days
    WINDOW b AS (PARTITION BY segment_id ORDER BY local_date RANGE BETWEEN INTERVAL 60 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), a AS (PARTITION BY segment_id ORDER BY local_date RANGE BETWEEN CURRENT ROW AND INTERVAL 59 DAYS FOLLOWING)),
  sc AS (SELECT *, abs(ma - mb) / nullif(sqrt(vb / nb + va / na), 0) AS score FROM st WHERE nb >= 5 AND na >= 5),
  hi AS (SELECT * FROM sc WHERE score >= 3),
  pk AS (SELECT *, max(score) OVER (PARTITION BY segment_id ORDER BY local_date RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS past, max(score) OVER (PARTITION BY segment_id ORDER BY local_date RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 7 DAYS FOLLOWING) AS future FROM hi),
  cp AS (SELECT segment_id, local_date AS changepoint_date, score, mb AS avg_before, ma AS avg_after, ma - mb AS avg_diff, (ma - mb) / nullif(mb, 0) AS pct_change FROM pk WHERE (past IS NULL OR score > past) AND (future IS NULL OR score >= future))"""


def _shifts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("segment_id"), F.to_date("l_shipdate").alias("local_date"), F.col("l_quantity").cast("double").alias("quantity"))
    return shifts.detect_changepoints(rows, "quantity", window_days=60, score_threshold=3.0)


@query(f"WITH {_SHIFT} SELECT segment_id, changepoint_date, round(score, 6) AS score, round(avg_before, 6) AS avg_before, round(avg_after, 6) AS avg_after, round(avg_diff, 6) AS avg_diff, round(pct_change, 6) AS pct_change FROM cp")
def changepoints_daily(spark, sf_dir):
    return r6(_shifts(spark, sf_dir), "score", "avg_before", "avg_after", "avg_diff", "pct_change")


@query(f"""WITH {_HOURLY}, x AS (SELECT corridor, ts_utc, local_date, travel_time + CASE WHEN ts_utc >= TIMESTAMP '2024-01-14 09:00:00' AND corridor = 'view' THEN 40 WHEN ts_utc >= TIMESTAMP '2024-01-20 21:00:00' AND corridor = 'click' THEN -25 ELSE 0 END AS v FROM hcal),
  f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY corridor, local_date ORDER BY ts_utc) = 1 THEN 1 ELSE 0 END AS first FROM x),
  w AS (SELECT *, count(v) OVER b AS nb, avg(v) OVER b AS mb, var_samp(v) OVER b AS vb, sum(first) OVER b AS db, count(v) OVER a AS na, avg(v) OVER a AS ma, var_samp(v) OVER a AS va, sum(first) OVER a AS da FROM f
    WINDOW b AS (PARTITION BY corridor ORDER BY ts_utc RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), a AS (PARTITION BY corridor ORDER BY ts_utc RANGE BETWEEN CURRENT ROW AND INTERVAL '4 days 23:59:59.999999' FOLLOWING)),
  s AS (SELECT *, CASE WHEN nb >= 60 AND na >= 60 THEN abs(ma - mb) / sqrt(vb / greatest(db, 1) + va / greatest(da, 1)) END AS score FROM w),
  p AS (SELECT *, max(score) OVER (PARTITION BY corridor ORDER BY ts_utc RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS past, max(score) OVER (PARTITION BY corridor ORDER BY ts_utc RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND INTERVAL 3 DAYS FOLLOWING) AS future FROM s)
  SELECT corridor, ts_utc AS changepoint_ts, round(score, 6) AS score, round(mb, 6) AS avg_before, round(ma, 6) AS avg_after, round((ma - mb) / mb, 6) AS pct_change FROM p WHERE score >= 1 AND (past IS NULL OR score > past) AND (future IS NULL OR score >= future)""")
def changepoints_hourly(spark, sf_dir):
    """Hourly series, two of which are shifted within a day."""
    at = lambda t, c: (F.col("ts_utc") >= F.lit(t).cast("timestamp_ntz")) & (F.col("corridor") == c)
    moved = F.when(at("2024-01-14 09:00:00", "view"), 40.0).when(at("2024-01-20 21:00:00", "click"), -25.0).otherwise(0.0)
    rows = hourly(spark, sf_dir).withColumn("travel_time", F.col("travel_time") + moved)
    found = shifts.changepoints_in_time(rows, "travel_time", ("corridor",), window_days=5, score_threshold=1.0, min_separation_days=3)
    return r6(found.select("corridor", "changepoint_ts", "score", "avg_before", "avg_after", "pct_change"), "score", "avg_before", "avg_after", "pct_change")


@query(f"""WITH {_SHIFT}, k AS (SELECT * FROM (VALUES (DATE '1996-07-01', 'opening'), (DATE '1999-03-15', 'closure')) AS t(known_date, label)),
  n AS (SELECT segment_id, known_date, label, changepoint_date, round(score, 6) AS score, round(avg_diff, 6) AS avg_diff, CAST(abs(date_diff('day', known_date, changepoint_date)) AS INTEGER) AS days_apart FROM cp, k
    QUALIFY row_number() OVER (PARTITION BY segment_id, known_date ORDER BY abs(date_diff('day', known_date, changepoint_date)), changepoint_date) = 1)
  SELECT *, days_apart <= 7 AS within_window FROM n""")
def changepoints_near(spark, sf_dir):
    known = spark.sql("SELECT * FROM VALUES (DATE '1996-07-01', 'opening'), (DATE '1999-03-15', 'closure') AS t(known_date, label)")
    return r6(shifts.changepoints_near(_shifts(spark, sf_dir), known), "score", "avg_diff")


# --- store ------------------------------------------------------------------------------------------


@query("SELECT array_to_string(list_sort(list(DISTINCT event_type)), ', ') AS area_name, substring(md5('corridors:' || array_to_string(list_sort(list(DISTINCT event_type)), '|')), 1, 12) AS area_key FROM events")
def area_identity(spark, sf_dir):
    return store.area_identity(observations(spark, sf_dir)).select("area_name", "area_key")


@query("SELECT 'segments(' || count(DISTINCT user_id) || ')' AS area_name, substring(md5('segments:' || array_to_string(list_sort(list(DISTINCT CAST(user_id AS BIGINT))), ',')), 1, 12) AS area_key FROM events")
def area_identity_segments(spark, sf_dir):
    """An export without corridors is named by its segments, in numeric order."""
    return store.area_identity(observations(spark, sf_dir).drop("corridor")).select("area_name", "area_key")


@query(f"""WITH {_HOURLY}, d AS (SELECT corridor, epoch_us(ts_utc) - lag(epoch_us(ts_utc)) OVER (PARTITION BY corridor ORDER BY ts_utc) AS step FROM hourly),
  c AS (SELECT corridor, step, count(*) AS n FROM d WHERE step > 0 GROUP BY ALL) SELECT corridor, CAST(round_even(step / 60000000.0::DOUBLE, 0) AS INTEGER) AS bin_minutes FROM c QUALIFY row_number() OVER (PARTITION BY corridor ORDER BY n DESC, step) = 1""")
def detect_bin(spark, sf_dir):
    return store.detect_bin(hourly(spark, sf_dir).withColumn("segment_id", F.lit(1)), by=("corridor",))


@query(f"""WITH {_THIRDS}, old AS (SELECT DISTINCT corridor, segment_id, ts_utc FROM t WHERE ts_utc < TIMESTAMP '2024-01-16')
  SELECT obs_id, corridor, segment_id, ts_utc FROM t ANTI JOIN old USING (corridor, segment_id, ts_utc) QUALIFY row_number() OVER (PARTITION BY corridor, segment_id, ts_utc ORDER BY obs_id) = 1""")
def keep_first_merge(spark, sf_dir):
    """What the whole table adds to a store that holds its first half."""
    rows = thirds(spark, sf_dir)
    stored = rows.where(F.col("ts_utc") < F.lit("2024-01-16").cast("timestamp_ntz"))
    return store.keep_first(stored, rows, ["corridor", "segment_id", "ts_utc"], ["obs_id"]).select("obs_id", "corridor", "segment_id", "ts_utc")


@query(f"WITH {_OBS} SELECT corridor, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts, count(DISTINCT segment_id) AS n_segments FROM obs GROUP BY corridor")
def registry_span(spark, sf_dir):
    return store.area_span(observations(spark, sf_dir), ["corridor"]).drop("n_rows")


# --- weights ----------------------------------------------------------------------------------------


def _volumes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("segment_id"), F.col("c_acctbal").cast("double").alias("aadt"))


_W = f"{_OBS}, v AS (SELECT CAST(c_custkey AS BIGINT) AS segment_id, CAST(c_acctbal AS DOUBLE) AS aadt FROM customer), m AS (SELECT segment_id, avg(speed) AS mean, avg(travel_time) AS delay FROM obs GROUP BY segment_id)"


@query(f"WITH {_W} SELECT round(sum(mean * aadt) / sum(aadt), 6) AS weighted_speed FROM m JOIN v USING (segment_id) WHERE aadt > 0")
def weighted_mean_speed(spark, sf_dir):
    return r6(weights.weighted_mean_speed(summarize.segment_means(observations(spark, sf_dir), "speed"), _volumes(spark, sf_dir)), "weighted_speed")


@query(f"WITH {_W} SELECT segment_id, round(delay, 6) AS mean, round(CASE WHEN aadt > 0 THEN delay / 60 * aadt ELSE 0 END, 6) AS vehicle_hours FROM m LEFT JOIN v USING (segment_id)")
def vehicle_hours(spark, sf_dir):
    return r6(weights.vehicle_hours_of_delay(summarize.segment_means(observations(spark, sf_dir), "travel_time"), _volumes(spark, sf_dir)), "mean", "vehicle_hours")


@query(f"""WITH {_W}, h AS (SELECT date_trunc('day', ts_utc) AS ts_utc, segment_id, avg(speed) AS speed FROM obs GROUP BY ALL), j AS (SELECT * FROM h JOIN v USING (segment_id) WHERE aadt > 0),
  t AS (SELECT sum(aadt) AS total FROM (SELECT DISTINCT segment_id, aadt FROM j)) SELECT ts_utc, round(sum(speed * aadt) / sum(aadt), 6) AS weighted_speed, round(sum(aadt) / any_value(total), 6) AS coverage, count(DISTINCT segment_id) AS n_segments FROM j, t GROUP BY ts_utc HAVING sum(aadt) / any_value(total) >= 0.5""")
def weighted_by_time(spark, sf_dir):
    day = F.date_trunc("day", F.col("ts_utc").cast("timestamp")).cast("timestamp_ntz")
    rows = observations(spark, sf_dir).groupBy(day.alias("ts_utc"), "segment_id").agg(F.avg("speed").alias("speed"))
    return r6(weights.weighted_speed_by_time(rows, _volumes(spark, sf_dir)), "weighted_speed", "coverage")


# --- labels -----------------------------------------------------------------------------------------


@query("""SELECT CAST(p_partkey AS BIGINT) AS segment_id, array_to_string(list_distinct_keep, ' & ') AS label FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [p_brand, p_type] ELSE [p_brand] END AS list_distinct_keep FROM part)""")
def simplify_names(spark, sf_dir):
    """Roads 'N <brand>/S/<brand>', crossed by 'US-<key> <type>' for a third of them and by themselves otherwise."""
    road = F.concat(F.lit("20 / W "), F.col("p_brand"))
    cross = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("US-"), F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_type"), F.lit(" / "), F.upper("p_type"))).otherwise(F.concat(F.lit("Old "), F.col("p_brand")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("segment_id"), labels.simplify_label(road, cross).alias("label"))


@query("""SELECT n_name, nullif(regexp_extract(upper(trim(n_name)), '[NESW]', 0), '') AS direction_group, CAST(CASE WHEN regexp_extract(upper(trim(n_name)), '[NESW]', 0) IN ('N', 'E') THEN 1 WHEN regexp_extract(upper(trim(n_name)), '[NESW]', 0) IN ('S', 'W') THEN -1 ELSE 0 END AS INTEGER) AS direction_sign FROM nation""")
def direction_sign(spark, sf_dir):
    n = F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_name", labels.direction_group(n).alias("direction_group"), labels.direction_sign(n).alias("direction_sign"))


# --- geometry ---------------------------------------------------------------------------------------

_LAT = 43.6


def _segments(spark, sf_dir):
    k = F.col("s_suppkey").cast("long")
    x, y = F.lit(-116.2) + (k * 37 % 1000) / F.lit(5000.0), F.lit(43.5) + (k * 91 % 1000) / F.lit(5000.0)
    return table(spark, sf_dir, "supplier").select(k.alias("segment_id"), geometry.line((x, y), (x + (k % 7 - 3) / F.lit(500.0), y + (k % 5 - 2) / F.lit(500.0))).alias("line"))


def _lines(spark, sf_dir):
    k = F.col("s_suppkey").cast("long")
    x, y = F.lit(-116.2) + (k * 37 % 1000) / F.lit(5000.0), F.lit(43.5) + (k * 91 % 1000) / F.lit(5000.0)
    shift = (k % 9) / F.lit(20000.0)
    return table(spark, sf_dir, "supplier").select((k + 100000).alias("line_id"), geometry.line((x + (k % 7 - 3) / F.lit(500.0) + shift, y + (k % 5 - 2) / F.lit(500.0)), (x + shift, y)).alias("line"), F.col("s_acctbal").cast("double").alias("aadt"), F.concat(F.lit("R"), k.cast("string")).alias("route"))


_M = "111320.0"
_EDGE = f"""SELECT k, (-116.2 + (k * 37 % 1000) / 5000.0) AS x, (43.5 + (k * 91 % 1000) / 5000.0) AS y, (k % 7 - 3) / 500.0 AS dx, (k % 5 - 2) / 500.0 AS dy, (k % 9) / 20000.0 AS sh FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)"""
_GEO = f"""c AS (SELECT k, x::DOUBLE AS x, y::DOUBLE AS y, dx::DOUBLE AS dx, dy::DOUBLE AS dy, sh::DOUBLE AS sh, {_M}::DOUBLE * cos(radians({_LAT}::DOUBLE)) AS sx, {_M}::DOUBLE AS sy FROM ({_EDGE})),
  a AS (SELECT k AS segment_id, x * sx AS a_x1, y * sy AS a_y1, (x + dx) * sx AS a_x2, (y + dy) * sy AS a_y2 FROM c),
  b AS (SELECT k + 100000 AS line_id, (x + dx + sh) * sx AS b_x1, (y + dy) * sy AS b_y1, (x + sh) * sx AS b_x2, y * sy AS b_y2 FROM c)"""


def _streets(spark, sf_dir):
    """Bent segments, a twentieth of them far from all lines, and by turns lines along them, streets that cross and then turn alongside, curves, and lines further off."""
    k = F.col("s_suppkey").cast("long")
    x, y = F.lit(-116.2) + (k * 37 % 1000) / F.lit(5000.0), F.lit(43.5) + (k * 91 % 1000) / F.lit(5000.0)
    dx, dy = (k % 7 - 3) / F.lit(500.0), (k % 5 - 2) / F.lit(500.0) + 0.0005
    p0, p1, p2 = (x, y), (x + dx / 2, y + dy / 2), (x + dx, y + dy + 0.001)
    side, far = (k % 9) / F.lit(20000.0), F.when(k % 20 == 0, F.lit(0.3)).otherwise(0.0)
    moved = lambda p, u, v: (p[0] + u, p[1] + v)
    middle = ((p0[0] + p1[0]) / 2, (p0[1] + p1[1]) / 2)
    over = moved(middle, dy * -0.07, dx * 0.07)
    shapes = [(moved(p2, side, 0.0), moved(p1, side, 0.0), moved(p0, side, 0.0)), (moved(middle, dy * 0.5, dx * -0.5), over, moved(over, dx / 2, dy / 2)), (p0, p1, moved(p1, 0.02, 0.0)), (moved(p0, 0.003, 0.001), moved(p1, 0.003, 0.001), moved(p2, 0.003, 0.002))]
    line = F.when(k % 4 == 0, geometry.line(*shapes[0])).when(k % 4 == 1, geometry.line(*shapes[1])).when(k % 4 == 2, geometry.line(*shapes[2])).otherwise(geometry.line(*shapes[3]))
    rows = table(spark, sf_dir, "supplier")
    segments = rows.select(k.alias("segment_id"), geometry.line(*(moved(p, 0.0, -far) for p in (p0, p1, p2))).alias("line"))
    lines = rows.select((k + 100000).alias("line_id"), line.alias("line"), F.col("s_acctbal").cast("double").alias("aadt"), F.concat(F.lit("R"), k.cast("string")).alias("route"))
    return segments, lines


def _utm_sql(lon: str, lat: str, lon0: str) -> tuple[str, str]:
    """SQL of the zone's metres east and north, by the same closed form, with its numbers written out."""
    e, n = "0.0818191910428158", "0.00167922039462874"
    t = f"sinh(atanh(sin(radians({lat}))) - {e}::DOUBLE * atanh({e}::DOUBLE * sin(radians({lat}))))"
    xi, eta = f"atan2({t}, cos(radians({lon} - {lon0})))", f"atanh(sin(radians({lon} - {lon0})) / sqrt(1 + {t} * {t}))"
    series = [f"({n}::DOUBLE / 2 - 2 * power({n}::DOUBLE, 2) / 3 + 5 * power({n}::DOUBLE, 3) / 16)", f"(13 * power({n}::DOUBLE, 2) / 48 - 3 * power({n}::DOUBLE, 3) / 5)", f"(61 * power({n}::DOUBLE, 3) / 240)"]
    radius = f"(0.9996::DOUBLE * 6378137.0::DOUBLE / (1 + {n}::DOUBLE) * (1 + power({n}::DOUBLE, 2) / 4 + power({n}::DOUBLE, 4) / 64))"
    east = " + ".join([eta, *(f"{c} * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})" for k, c in enumerate(series, 1))])
    north = " + ".join([xi, *(f"{c} * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})" for k, c in enumerate(series, 1))])
    return f"{radius} * ({east})", f"{radius} * ({north})"


def _streets_sql() -> str:
    ax, ay = _utm_sql("lon", "lat", "lon0")
    ends = []
    for order, (p, q, k) in enumerate([("a", "b", 1), ("a", "b", 2), ("b", "a", 1), ("b", "a", 2)], 1):
        px, py, dx, dy = f"{p}x{k}", f"{p}y{k}", f"({q}x2 - {q}x1)", f"({q}y2 - {q}y1)"
        t = f"CASE WHEN {dx} * {dx} + {dy} * {dy} > 0 THEN greatest(least((({px} - {q}x1) * {dx} + ({py} - {q}y1) * {dy}) / ({dx} * {dx} + {dy} * {dy}), 1.0), 0.0) ELSE 0.0 END"
        foot = f"{q}x1 + t * {dx}", f"{q}y1 + t * {dy}"
        name = lambda p: "by_" if p == "b" else "ay"  # noqa: E731  BY is a reserved word
        own, other = (f"{px} AS {p}x, {py} AS {name(p)}"), (f"{foot[0]} AS {q}x, {foot[1]} AS {name(q)}")
        first, second = (own, other) if p == "a" else (other, own)
        ends.append(f"SELECT s, l, ea, eb, {order} AS o, {first}, {second} FROM (SELECT *, {t} AS t FROM e)")
    cross = "SELECT s, l, ea, eb, 0 AS o, ax1 + u * (ax2 - ax1), ay1 + u * (ay2 - ay1), ax1 + u * (ax2 - ax1), ay1 + u * (ay2 - ay1) FROM (SELECT *, ((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / w AS u, ((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / w AS v FROM (SELECT *, nullif((ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1), 0) AS w FROM e)) WHERE u > 0 AND u < 1 AND v > 0 AND v < 1"

    def bearings(name: str, edges: str, key: str, point: str) -> str:
        """The direction of a line five metres to either side of the place that is closest to the other's nearest point."""
        return f"""{name}_m AS (SELECT n.s, n.l, n.{point}x AS px, n.{"by_" if point == "b" else "ay"} AS py, g.e, g.x1, g.y1, g.x2, g.y2, g.len, sum(g.len) OVER (PARTITION BY n.s, n.l ORDER BY g.e) - g.len AS before, sum(g.len) OVER (PARTITION BY n.s, n.l) AS total FROM near n JOIN {edges} g ON {key}),
  {name}_f AS (SELECT *, CASE WHEN len > 0 THEN greatest(least(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (len * len), 1.0), 0.0) ELSE 0.0 END AS t FROM {name}_m),
  {name}_s AS (SELECT s, l, total, before + t * len AS pos FROM {name}_f QUALIFY row_number() OVER (PARTITION BY s, l ORDER BY sqrt(power(px - x1 - t * (x2 - x1), 2) + power(py - y1 - t * (y2 - y1), 2)), e) = 1),
  {name}_p AS (SELECT m.s, m.l, h.k, m.x1 + (h.pos - m.before) / nullif(m.len, 0) * (m.x2 - m.x1) AS x, m.y1 + (h.pos - m.before) / nullif(m.len, 0) * (m.y2 - m.y1) AS y
    FROM {name}_m m JOIN (SELECT s, l, 1 AS k, greatest(pos - 5, 0.0) AS pos FROM {name}_s UNION ALL SELECT s, l, 2, least(pos + 5, total) FROM {name}_s) h ON m.s = h.s AND m.l = h.l AND m.before <= h.pos AND m.len > 0 QUALIFY row_number() OVER (PARTITION BY m.s, m.l, h.k ORDER BY m.e DESC) = 1),
  {name} AS (SELECT p.s, p.l, (degrees(atan2(q.y - p.y, q.x - p.x)) + 360) % 180 AS turn FROM {name}_p p JOIN {name}_p q ON p.s = q.s AND p.l = q.l AND p.k = 1 AND q.k = 2)"""

    return f"""WITH c AS (SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_acctbal AS DOUBLE) AS aadt FROM supplier),
  b AS (SELECT *, -116.2::DOUBLE + (k * 37 % 1000) / 5000.0::DOUBLE AS x, 43.5::DOUBLE + (k * 91 % 1000) / 5000.0::DOUBLE AS y, (k % 7 - 3) / 500.0::DOUBLE AS dx, (k % 5 - 2) / 500.0::DOUBLE + 0.0005::DOUBLE AS dy, (k % 9) / 20000.0::DOUBLE AS sh, CASE WHEN k % 20 = 0 THEN 0.3::DOUBLE ELSE 0.0 END AS far FROM c),
  pt AS (SELECT *, x + dx / 2 AS x1, y + dy / 2 AS y1, x + dx AS x2, y + dy + 0.001::DOUBLE AS y2, (x + (x + dx / 2)) / 2 AS mx, (y + (y + dy / 2)) / 2 AS my FROM b),
  po AS (SELECT *, mx + dy * -0.07::DOUBLE AS ox, my + dx * 0.07::DOUBLE AS oy FROM pt),
  seg AS (SELECT k AS s, [{{'lon': x, 'lat': y - far}}, {{'lon': x1, 'lat': y1 - far}}, {{'lon': x2, 'lat': y2 - far}}] AS p FROM po),
  lin AS (SELECT k + 100000 AS l, CASE k % 4 WHEN 0 THEN [{{'lon': x2 + sh, 'lat': y2}}, {{'lon': x1 + sh, 'lat': y1}}, {{'lon': x + sh, 'lat': y}}] WHEN 1 THEN [{{'lon': mx + dy * 0.5, 'lat': my + dx * -0.5}}, {{'lon': ox, 'lat': oy}}, {{'lon': ox + dx / 2, 'lat': oy + dy / 2}}]
    WHEN 2 THEN [{{'lon': x, 'lat': y}}, {{'lon': x1, 'lat': y1}}, {{'lon': x1 + 0.02::DOUBLE, 'lat': y1}}] ELSE [{{'lon': x + 0.003::DOUBLE, 'lat': y + 0.001::DOUBLE}}, {{'lon': x1 + 0.003::DOUBLE, 'lat': y1 + 0.001::DOUBLE}}, {{'lon': x2 + 0.003::DOUBLE, 'lat': y2 + 0.002::DOUBLE}}] END AS p FROM po),
  zone AS (SELECT s, floor(p[1].lon / 6) * 6 + 3 AS lon0 FROM seg),
  sp AS (SELECT s, i, {ax} AS px, {ay} AS py FROM (SELECT s, lon0, i, p[i].lon AS lon, p[i].lat AS lat FROM seg JOIN zone USING (s), (SELECT unnest([1, 2, 3]) AS i))),
  lp AS (SELECT lon0, l, i, {ax} AS px, {ay} AS py FROM (SELECT l, lon0, i, p[i].lon AS lon, p[i].lat AS lat FROM lin, (SELECT DISTINCT lon0 FROM zone), (SELECT unnest([1, 2, 3]) AS i))),
  se AS (SELECT a.s, a.i AS e, a.px AS x1, a.py AS y1, b.px AS x2, b.py AS y2, sqrt(power(b.px - a.px, 2) + power(b.py - a.py, 2)) AS len FROM sp a JOIN sp b ON a.s = b.s AND b.i = a.i + 1),
  le AS (SELECT a.lon0, a.l, a.i AS e, a.px AS x1, a.py AS y1, b.px AS x2, b.py AS y2, sqrt(power(b.px - a.px, 2) + power(b.py - a.py, 2)) AS len FROM lp a JOIN lp b ON a.l = b.l AND a.lon0 = b.lon0 AND b.i = a.i + 1),
  e AS (SELECT se.s, le.l, se.e AS ea, le.e AS eb, se.x1 AS ax1, se.y1 AS ay1, se.x2 AS ax2, se.y2 AS ay2, le.x1 AS bx1, le.y1 AS by1, le.x2 AS bx2, le.y2 AS by2 FROM se JOIN zone USING (s) JOIN le USING (lon0)),
  cand AS ({" UNION ALL ".join(ends)} UNION ALL {cross}),
  pair AS (SELECT * FROM (SELECT *, CASE WHEN o = 0 THEN 0.0 ELSE sqrt(power(ax - bx, 2) + power(ay - by_, 2)) END AS d FROM cand) QUALIFY row_number() OVER (PARTITION BY s, l ORDER BY d, ea, eb, o) = 1),
  near AS (SELECT * FROM pair WHERE d <= 35),
  {bearings("ta", "se", "g.s = n.s", "b")},
  {bearings("tb", "(SELECT z.s AS zs, le.* FROM le JOIN zone z USING (lon0))", "g.l = n.l AND g.zs = n.s", "a")},
  m AS (SELECT n.s, n.l, n.d FROM near n JOIN ta USING (s, l) JOIN tb USING (s, l) WHERE least(abs(ta.turn - tb.turn) % 180, 180 - abs(ta.turn - tb.turn) % 180) <= 45 QUALIFY row_number() OVER (PARTITION BY n.s ORDER BY n.d, n.l) = 1),
  r AS (SELECT s, l, d FROM pair QUALIFY row_number() OVER (PARTITION BY s ORDER BY d, l) = 1)
  SELECT seg.s AS segment_id, CASE WHEN m.l IS NOT NULL THEN 'matched' WHEN r.l IS NOT NULL THEN 'nearest' ELSE 'missing' END AS match, coalesce(m.l, r.l) AS line_id, round(coalesce(m.d, r.d), 3) AS distance, CASE WHEN m.l IS NOT NULL THEN aadt END AS aadt, 'R' || (coalesce(m.l, r.l) - 100000) AS route
  FROM seg LEFT JOIN m USING (s) LEFT JOIN r ON r.s = seg.s LEFT JOIN c ON c.k = coalesce(m.l, r.l) - 100000"""


@query(_streets_sql())
def nearest_line_join(spark, sf_dir):
    return nearest.nearest_line_join(*_streets(spark, sf_dir)).withColumn("distance", F.round("distance", 3))


@query(f"""WITH {_GEO}, s AS (SELECT segment_id AS id, a_x1 AS x1, a_y1 AS y1, a_x2 AS x2, a_y2 AS y2 FROM a UNION ALL SELECT line_id, b_x1, b_y1, b_x2, b_y2 FROM b),
  l AS (SELECT id AS id_a, x1 AS a_x1, y1 AS a_y1, x2 AS a_x2, y2 AS a_y2 FROM s), r AS (SELECT id AS id_b, x1 AS b_x1, y1 AS b_y1, x2 AS b_x2, y2 AS b_y2 FROM s)
  SELECT id_a, id_b, round({geometry.edge_distance()}, 3) AS distance FROM l, r WHERE id_a < id_b AND {geometry.edge_distance()} <= 20 AND abs(abs({geometry.bearing("a_")} - {geometry.bearing("b_")}) - 180) <= 35""")
def overlap_pairs(spark, sf_dir):
    both = _segments(spark, sf_dir).unionByName(_lines(spark, sf_dir).select(F.col("line_id").alias("segment_id"), "line"))
    return geometry.overlap_pairs(both, _LAT).withColumn("distance", F.round("distance", 3))


@query(f"""WITH {_GEO}, s AS (SELECT segment_id AS id, a_x1 AS x1, a_y1 AS y1, a_x2 AS x2, a_y2 AS y2, x AS lon1, y AS lat1, x + dx AS lon2, y + dy AS lat2 FROM a JOIN c ON c.k = a.segment_id UNION ALL SELECT line_id, b_x1, b_y1, b_x2, b_y2, x + dx + sh, y + dy, x + sh, y FROM b JOIN c ON c.k + 100000 = b.line_id),
  u AS (SELECT id, x1, y1, x2, y2, (degrees(atan2(x2 - x1, y2 - y1)) + 360) % 360 AS heading FROM s),
  m AS (SELECT p.x1 AS ax, p.y1 AS ay, p.x2 - p.x1 AS ux, p.y2 - p.y1 AS uy, q.x1 AS bx, q.y1 AS by_, q.x2 - q.x1 AS vx, q.y2 - q.y1 AS vy, p.id AS id_a, q.id AS id_b FROM u p JOIN u q ON p.id < q.id AND abs(abs(p.heading - q.heading) - 180) <= 35),
  w AS (SELECT *, nullif(ux * vy - uy * vx, 0) AS turn, nullif(ux * ux + uy * uy, 0) AS uu, nullif(vx * vx + vy * vy, 0) AS vv FROM m),
  t AS (SELECT *, ((bx - ax) * vy - (by_ - ay) * vx) / turn AS cu, ((bx - ax) * uy - (by_ - ay) * ux) / turn AS cv, [coalesce(greatest(least(((bx - ax) * ux + (by_ - ay) * uy) / uu, 1), 0), 0), coalesce(greatest(least(((bx + vx - ax) * ux + (by_ + vy - ay) * uy) / uu, 1), 0), 0)] AS tu,
    [coalesce(greatest(least(((ax - bx) * vx + (ay - by_) * vy) / vv, 1), 0), 0), coalesce(greatest(least(((ax + ux - bx) * vx + (ay + uy - by_) * vy) / vv, 1), 0), 0)] AS tv FROM w),
  n AS (SELECT id_a, id_b FROM t WHERE (cu > 0 AND cu < 1 AND cv > 0 AND cv < 1) OR least(sqrt(power(bx - ax - tu[1] * ux, 2) + power(by_ - ay - tu[1] * uy, 2)), sqrt(power(bx + vx - ax - tu[2] * ux, 2) + power(by_ + vy - ay - tu[2] * uy, 2)),
    sqrt(power(ax - bx - tv[1] * vx, 2) + power(ay - by_ - tv[1] * vy, 2)), sqrt(power(ax + ux - bx - tv[2] * vx, 2) + power(ay + uy - by_ - tv[2] * vy, 2))) <= 20),
  g AS (SELECT s.*, id IN (SELECT id_a FROM n UNION SELECT id_b FROM n) AS moved, (lon2 - lon1) * cos(radians({_LAT}::DOUBLE)) AS east, lat2 - lat1 AS north FROM s)
  SELECT id AS segment_id, moved AS "offset", round(lon1 + CASE WHEN moved AND (east <> 0 OR north <> 0) THEN north / sqrt(east * east + north * north) * 6 / {_M}::DOUBLE / cos(radians({_LAT}::DOUBLE)) ELSE 0 END, 7) AS lon,
    round(lat1 - CASE WHEN moved AND (east <> 0 OR north <> 0) THEN east / sqrt(east * east + north * north) * 6 / {_M}::DOUBLE ELSE 0 END, 7) AS lat FROM g""")
def offset_overlapping(spark, sf_dir):
    """Lines that run against each other, moved to their right."""
    both = _segments(spark, sf_dir).unionByName(_lines(spark, sf_dir).select(F.col("line_id").alias("segment_id"), "line"))
    out = geometry.offset_overlapping(both, _LAT)
    return out.select("segment_id", "offset", F.round(F.element_at("line", 1)["lon"], 7).alias("lon"), F.round(F.element_at("line", 1)["lat"], 7).alias("lat"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS segment_id, CAST(n_nationkey + 1 AS BIGINT) AS next_id FROM nation WHERE n_nationkey < (SELECT max(n_nationkey) FROM nation)""")
def network_edges(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("segment_id"))
    last = nations.agg(F.max("segment_id").alias("last"))
    network = nations.crossJoin(F.broadcast(last)).select("segment_id", F.when(F.col("segment_id") < F.col("last"), F.col("segment_id") + 1).alias("next_id"))
    return geometry.connectivity(network)


@query("""SELECT CAST(n_nationkey AS BIGINT) AS segment_id, CASE WHEN n_regionkey = 0 THEN 'xd' WHEN n_regionkey = 1 THEN 'fallback' ELSE 'missing' END AS source, CASE WHEN n_regionkey = 0 THEN 3 WHEN n_regionkey = 1 THEN 2 END AS points FROM nation""")
def segment_geometry(spark, sf_dir):
    """Nations as segments: those of region 0 are in the network, those of region 1 have both ends."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("segment_id"), "n_regionkey")
    k = F.col("segment_id").cast("double")
    network = nations.where("n_regionkey = 0").select("segment_id", geometry.line((k, k), (k + 1, k), (k + 1, k + 1)).alias("line"))
    ends = nations.select("segment_id", k.alias("start_lon"), k.alias("start_lat"), F.when(F.col("n_regionkey") == 1, k + 1).alias("end_lon"), k.alias("end_lat"))
    return geometry.segment_geometry(nations.select("segment_id"), network, ends).select("segment_id", "source", F.when(F.size("line") > 0, F.size("line")).alias("points"))


@query(f"""WITH {_GEO} SELECT k AS segment_id, '{{{{"type":"Feature","properties":{{{{"segment_id":' || k || '}}}},"geometry":{{{{"type":"LineString","coordinates":[[' || x || ',' || y || '],[' || (x + dx) || ',' || (y + dy) || ']]}}}}}}}}' AS feature FROM c""".replace("{{", "{").replace("}}", "}"))
def geojson_features(spark, sf_dir):
    return sinks.geojson_rows(_segments(spark, sf_dir))


@query(f"""WITH {_GEO}, v AS (SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_acctbal AS DOUBLE) AS z FROM supplier), e AS (SELECT min(z) AS lo, max(z) AS hi FROM v), p AS (SELECT k, (z - lo) / (hi - lo) AS q FROM v, e)
  SELECT k AS segment_id, lower(printf('%02x%02x%02x', CAST(trunc(43 + (215 - 43) * q) AS INTEGER), CAST(trunc(131 + (25 - 131) * q) AS INTEGER), CAST(trunc(186 + (28 - 186) * q) AS INTEGER))) AS colour FROM p""")
def kml_colours(spark, sf_dir):
    values = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("segment_id"), F.col("s_acctbal").cast("double").alias("shown"))
    return sinks.ramp_colours(values, "shown").select("segment_id", "colour")


_MARKS = f"""{_GEO}, v AS (SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_acctbal AS DOUBLE) AS z, s_name FROM supplier), e AS (SELECT min(z) AS lo, max(z) AS hi FROM v), p AS (SELECT k, s_name, (z - lo) / (hi - lo) AS q FROM v, e),
  m AS (SELECT k, s_name, x, y, dx, dy, lower(printf('%02x%02x%02x', CAST(trunc(43 + (215 - 43) * q) AS INTEGER), CAST(trunc(131 + (25 - 131) * q) AS INTEGER), CAST(trunc(186 + (28 - 186) * q) AS INTEGER))) AS colour,
    printf('%.6f,%.6f,0 %.6f,%.6f,0', x, y, x + dx, y + dy) AS line FROM p JOIN c USING (k))"""


@query(f"""WITH {_MARKS} SELECT k AS segment_id, colour, '<Placemark><name>' || s_name || '</name><styleUrl>#c' || colour || '</styleUrl><LineString><coordinates>' || line || '</coordinates></LineString></Placemark>' AS placemark FROM m""")
def kml_placemarks(spark, sf_dir):
    values = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("segment_id"), F.col("s_acctbal").cast("double").alias("shown"), F.col("s_name").alias("name"))
    lines = _segments(spark, sf_dir).join(values, "segment_id")
    return sinks.placemark_rows(sinks.ramp_colours(lines, "shown"))


@query(f"""WITH {_MARKS} SELECT k AS segment_id, colour, '<Placemark><name>' || s_name || '</name><description>Segment ID: ' || k || '</description><styleUrl>#c' || colour || '</styleUrl><MultiGeometry><LineString><tessellate>1</tessellate><coordinates>' || line
  || '</coordinates></LineString><Point><coordinates>' || printf('%.6f,%.6f,0', x + dx / 2, y + dy / 2) || '</coordinates></Point></MultiGeometry></Placemark>' AS placemark FROM m""")
def kml_published(spark, sf_dir):
    """Lines with a label at their midpoint."""
    values = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("segment_id"), F.col("s_acctbal").cast("double").alias("shown"), F.col("s_name").alias("name"))
    return kml.published_rows(sinks.ramp_colours(_segments(spark, sf_dir).join(values, "segment_id"), "shown"), "name")


# --- whole analyses ---------------------------------------------------------------------------------


@query(f"""WITH {_OBS}, {_GROUPS}, p AS (SELECT *, CASE WHEN local_ts >= TIMESTAMP '2024-01-09' AND local_ts < TIMESTAMP '2024-01-19' THEN 'before' WHEN local_ts >= TIMESTAMP '2024-01-20' AND local_ts < TIMESTAMP '2024-01-30' THEN 'after' END AS period FROM grp)
  SELECT segment_id, day_group, time_bin, period, count(travel_time) AS travel_time_count, round(avg(travel_time), 6) AS travel_time_mean, round(stddev_samp(travel_time), 6) AS travel_time_std, round(median(travel_time), 6) AS travel_time_median FROM p WHERE period IS NOT NULL GROUP BY ALL""")
def panel_summary(spark, sf_dir):
    return r6(analysis.panel_summary(local(spark, sf_dir), "travel_time", BEFORE, AFTER), "travel_time_mean", "travel_time_std", "travel_time_median")


@query(f"""WITH {_THIRDS}, c AS (SELECT *, CAST(hour((ts_utc AT TIME ZONE 'UTC') AT TIME ZONE 'America/Denver') AS BIGINT) AS h FROM t WHERE cvalue > 20), f AS (SELECT * FROM c WHERE h >= 7 AND h < 19),
  g AS (SELECT ts_utc, sum(travel_time) AS travel_time, count(DISTINCT segment_id) AS n FROM f WHERE corridor = 'click' GROUP BY ts_utc) SELECT CAST(-1 AS BIGINT) AS segment_id, ts_utc, round(travel_time, 6) AS travel_time FROM g WHERE n >= (SELECT max(n) FROM g)""")
def scope_corridor_series(spark, sf_dir):
    study = analysis.open_study(Study(thirds(spark, sf_dir).drop("speed")), threshold=20)
    return r6(analysis.analysis_series(study, "travel_time", "corridor", "click", window=(7, 19)).select("segment_id", "ts_utc", "travel_time"), "travel_time")


@query(f"WITH {_W} SELECT segment_id, round(CASE WHEN aadt > 0 THEN delay / 60 * aadt ELSE 0 END, 6) AS shown, TRUE AS member FROM m LEFT JOIN v USING (segment_id)")
def map_vehicle_hours(spark, sf_dir):
    return r6(analysis.map_values(Study(observations(spark, sf_dir)), "vhd", "travel_time", volumes=_volumes(spark, sf_dir)), "shown")


@query(f"""WITH {_HOURLY}, s AS (SELECT corridor, local_date, avg(travel_time - season_day - season_week) AS v, CASE WHEN local_date BETWEEN DATE '2024-01-09' AND DATE '2024-01-18' THEN 'b' WHEN local_date BETWEEN DATE '2024-01-20' AND DATE '2024-01-29' THEN 'a' END AS side FROM dec GROUP BY ALL)
  SELECT CAST(ascii(corridor) * 100 + length(corridor) AS BIGINT) AS segment_id, round(avg(v) FILTER (side = 'a') - avg(v) FILTER (side = 'b') + 1e-9, 6) AS shown, TRUE AS member FROM s WHERE side IS NOT NULL GROUP BY corridor HAVING count(v) FILTER (side = 'a') >= 2 AND count(v) FILTER (side = 'b') >= 2""")
def map_adjusted_change(spark, sf_dir):
    """Segments are told apart by the first letter and the length of their corridor's name."""
    rows = hourly(spark, sf_dir).withColumn("segment_id", (F.ascii("corridor") * 100 + F.length("corridor")).cast("long"))
    return r6(analysis.map_values(Study(rows), "delta", "travel_time", BEFORE, AFTER, freq_minutes=60, min_samples=40), "shown", above=1e-9)
