import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayline.functions import calendar as cal
from wayline.functions import labels, student_t
from wayline.operators import compare, completeness, decompose, geometry, shifts, summarize, weights
from wayline.plans import analysis
from wayline.schema import Study


def obs(spark, rows, schema="segment_id long, ts string, travel_time double"):
    return spark.createDataFrame(rows, schema).withColumn("ts_utc", F.col("ts").cast("timestamp_ntz")).drop("ts")


def test_summary_drops_missing_keys_and_single_std(spark):
    rows = [(1, "a", 1.0), (1, "a", 3.0), (2, "a", 5.0), (1, None, 9.0)]
    df = spark.createDataFrame(rows, "segment_id long, time_bin string, speed double")
    got = {r["segment_id"]: r for r in summarize.segment_summary(df, ["speed"], ("segment_id", "time_bin")).collect()}
    assert got[1]["speed_count"] == 2 and got[1]["speed_median"] == 2.0 and got[1]["speed_std"] == pytest.approx(math.sqrt(2))
    assert got[2]["speed_std"] is None and len(got) == 2


@pytest.mark.parametrize("direction, want", [("trailing", [1, 1.5, 1.5, 3.5]), ("leading", [1.5, 3.5, 5, 5]), ("centered", [1.5, 1.5, 3.5, 5])])
def test_rolling(spark, direction, want):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([1.0, 2.0, None, 5.0])], "segment_id long, ts_utc int, x double")
    got = [r["r"] for r in summarize.rolling_average(df, "x", 3, direction=direction, out="r").orderBy("ts_utc").collect()]
    assert got == pytest.approx(want)


def test_even_centered_window_leans_back(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(6)], "segment_id long, ts_utc int, x double")
    got = [r["r"] for r in summarize.rolling_average(df, "x", 4, direction="centered", out="r").orderBy("ts_utc").collect()]
    assert got == pytest.approx(pd.Series(range(6)).rolling(4, center=True, min_periods=1).mean().tolist())


def test_delay(spark):
    df = spark.createDataFrame([(1001, 30.0, 1.0, 60.0), (1002, 40.0, 1.5, 60.0), (1003, 50.0, 1.0, 0.0), (1004, 70.0, 0.5, 60.0)], "segment_id long, speed double, travel_time double, ref_speed double")
    miles = spark.createDataFrame([(1001, 0.5), (1002, 1.0)], "segment_id long, miles double")
    got = {r["segment_id"]: r["delay"] for r in summarize.segment_delay(df, miles).collect()}
    assert got == {1001: 0.5, 1002: 0.5, 1003: None, 1004: 0.0}
    same = {r["segment_id"]: r["delay"] for r in summarize.segment_delay(df).collect()}
    assert same[1001] == pytest.approx(0.5) and same[1002] == pytest.approx(0.5)
    assert {r["segment_id"]: r["delay"] for r in summarize.segment_delay(df, miles, floor=False).collect()}[1004] < 0
    with pytest.raises(ValueError):
        summarize.segment_delay(df.drop("speed"))


def sparse(spark):
    rows = [(1, "A", "2024-01-01 08:00:00", 1.0), (2, "A", "2024-01-01 08:00:00", 2.0), (1, "A", "2024-01-01 08:05:00", 1.5), (3, "A", "2024-01-01 08:05:00", None), (9, None, "2024-01-01 08:05:00", 4.0)]
    return obs(spark, rows, "segment_id long, corridor string, ts string, travel_time double")


def test_completeness_policies(spark):
    most = completeness.mark_complete(sparse(spark), "max").collect()
    assert {r["complete"] for r in most if r["corridor"]} == {True}
    assert [(r["n_segments"], r["complete"]) for r in most if r["corridor"] is None] == [(None, False)]
    assert not any(r["complete"] for r in completeness.mark_complete(sparse(spark), "total").collect())
    with pytest.raises(ValueError):
        completeness.mark_complete(sparse(spark), "some")


def test_corridor_total_counts_values(spark):
    rows = completeness.corridor_travel_time(sparse(spark), require_complete=False, value="travel_time").orderBy("ts_utc").collect()
    assert [(r["travel_time"], r["n_segments"], r["complete"]) for r in rows] == [(3.0, 2, True), (1.5, 1, False)]
    kept = completeness.corridor_travel_time(sparse(spark), value="travel_time").collect()
    assert len(kept) == 1


def test_network_speed(spark):
    rows = [(s, c, "2024-01-01 08:00:00", t) for s, c, t in ((1, "A", 1.0), (2, "A", 2.0), (3, "B", 3.0))]
    df = obs(spark, rows, "segment_id long, corridor string, ts string, travel_time double")
    miles = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 1.5)], "segment_id long, miles double")
    row = completeness.network_travel_time(df, miles, value="travel_time").first()
    assert (row["travel_time"], row["n_segments"], row["miles"], row["mph"]) == (6.0, 3, 3.0, 30.0)


def test_coverage_cost(spark):
    rows = [(s, f"2024-01-01 08:{m:02d}:00", 1.0) for s in (1, 2, 3) for m in range(10) if not (s == 3 and m < 4)]
    members = spark.createDataFrame([(1,), (2,), (3,)], "segment_id long")
    got = {r["segment_id"]: r for r in completeness.segment_coverage(obs(spark, rows), members).collect()}
    assert got[3]["coverage"] == 0.6 and got[3]["complete_set_cost"] == 4 and got[1]["complete_set_cost"] == 0
    unseen = completeness.segment_coverage(obs(spark, rows).limit(0), members).collect()
    assert {(r["n_reported"], r["coverage"], r["complete_set_cost"]) for r in unseen} == {(0, None, 0)}


def test_bh(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.005), (5, None)], "id int, p double")
    got = [r["q"] for r in compare.bh_qvalues(df, "p", "q").orderBy("id").collect()]
    assert got[:4] == pytest.approx([0.02, 0.04, 0.04, 0.02]) and got[4] is None


def test_student_t():
    # standard table values at .975
    for dof, q in ((1, 12.7062), (2, 4.3027), (6, 2.4469), (10, 2.2281), (30, 2.0423), (120, 1.9799)):
        assert float(student_t.quantile(0.975, np.array([dof]))[0]) == pytest.approx(q, abs=5e-5)
        assert float(student_t.two_sided_p(np.array([q]), np.array([dof]))[0]) == pytest.approx(0.05, abs=1e-5)  # the table has four decimals


def series(days=50, step=2.0, at=25, seed=0, noise=0.3):
    rng, begin = np.random.default_rng(seed), datetime(2026, 1, 5, 7)
    t = pd.date_range(begin, periods=days * 24, freq="h")
    hour, day = (t.hour - 7) % 24, np.arange(len(t)) // 24
    v = 10 + 3 * np.sin(2 * np.pi * (hour - 9) / 24) + 4 * ((t - timedelta(hours=7)).dayofweek >= 5) + step * (day >= at) + rng.normal(0, noise, len(t))
    return pd.DataFrame({"segment_id": 1, "ts_utc": t, "travel_time": v})


def spark_series(spark, **options):
    df = spark.createDataFrame(series(**options)).withColumn("ts_utc", F.col("ts_utc").cast("timestamp_ntz"))
    return cal.to_local(df, "America/Denver")


def test_rolling_median_over_chunks(spark):
    pdf = series()
    got = decompose.rolling_median(spark_series(spark), "travel_time").orderBy("ts_utc").toPandas()
    want = pdf.set_index("ts_utc")["travel_time"].rolling("7D", closed="both").median().to_numpy()
    assert np.allclose(got["median"], want) and len(got) == len(pdf)


def test_adjusted_comparison_recovers_step(spark):
    adjusted = decompose.adjust(spark_series(spark), "travel_time", freq_minutes=60, min_samples=40).cache()
    rows = adjusted.toPandas()
    assert np.allclose(rows["travel_time_adj"], rows["median"] + rows["resid"])
    out = compare.compare_adjusted(adjusted, "20260112-20260127", "20260205-20260220", "travel_time").first()
    assert out["effect"] == pytest.approx(2.0, abs=0.4) and out["ci_low"] > 0 and out["q_value"] < 0.05
    assert decompose.decompose(spark_series(spark, days=5), "travel_time", freq_minutes=60, min_samples=40).count() == 0
    adjusted.unpersist()


def test_changepoints(spark):
    days = pd.date_range("2026-02-02", periods=60)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"segment_id": np.repeat([1, 2], 60), "local_date": list(days.date) * 2, "v": np.concatenate([10 + 5 * (np.arange(60) >= 30) + rng.normal(0, 0.5, 60), 10 + rng.normal(0, 0.5, 60)])})
    found = shifts.detect_changepoints(spark.createDataFrame(pdf), "v")
    rows = found.collect()
    assert [r["segment_id"] for r in rows] == [1]
    assert abs((rows[0]["changepoint_date"] - days[30].date()).days) <= 2 and rows[0]["avg_diff"] == pytest.approx(5, abs=0.6)
    known = spark.createDataFrame([(days[33].date(), "works"), (days[50].date(), "other")], "known_date date, label string")
    near = shifts.changepoints_near(found, known).collect()
    assert [r["within_window"] for r in near] == [True, False]


def test_weights(spark):
    means = spark.createDataFrame([(1, 20.0), (2, 40.0), (3, None), (4, 10.0)], "segment_id long, mean double")
    volumes = spark.createDataFrame([(1, 100.0), (2, 300.0), (3, 50.0), (4, 0.0)], "segment_id long, aadt double")
    assert weights.weighted_mean_speed(means, volumes).first()[0] == 35.0
    hours = {r["segment_id"]: r["vehicle_hours"] for r in weights.vehicle_hours_of_delay(means, volumes).collect()}
    assert hours[4] == 0.0 and hours[3] is None and hours[2] == pytest.approx(200.0)


def test_names(spark):
    rows = [("N 9th St/S/9th St", "X / Idaho St"), ("20 / W Myrtle St", "US-20 Myrtle St / Capitol Blvd"), ("184 / I-184 E", "I-184 / Americana Blvd")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, road string, crossing string")
    got = [r[0] for r in df.orderBy("id").select(labels.simplify_label(F.col("road"), F.col("crossing"))).collect()]
    assert got[1:] == ["Myrtle St & Capitol Blvd", "I-184 & Americana Blvd"]
    signs = spark.createDataFrame([("NE",), ("Southbound",), ("x",), (None,)], "d string").select(labels.direction_sign(F.col("d"))).collect()
    assert [r[0] for r in signs] == [1, -1, 0, 0]


def polyline(*points):
    return [{"lon": x, "lat": y} for x, y in points]


LINE = "array<struct<lon:double,lat:double>>"


def test_opposing_lines_move_apart(spark):
    there = polyline((-116.2, 43.61), (-116.2, 43.62))
    df = spark.createDataFrame([(1, there), (2, there[::-1]), (3, polyline((-116.0, 43.0), (-116.0, 43.1)))], f"segment_id long, line {LINE}")
    got = {r["segment_id"]: r for r in geometry.offset_overlapping(df, 43.6).collect()}
    assert got[1]["offset"] and got[2]["offset"] and not got[3]["offset"]
    metres = (got[1]["line"][0]["lon"] + 116.2) * 111320 * math.cos(math.radians(43.6))
    assert metres == pytest.approx(6, abs=0.01) and got[2]["line"][0]["lon"] < -116.2


def test_overlaps_of_many_equal_lines(spark):
    """Each pair of ids once, over more ids than a block holds."""
    there, aside = polyline((-116.2, 43.61), (-116.2, 43.615), (-116.2, 43.62)), polyline((-116.1999, 43.62), (-116.1999, 43.61))
    copies = geometry.BLOCK + 50
    df = spark.createDataFrame([(k, aside if k % 3 else there) for k in range(copies)] + [(5000, polyline((-116.0, 43.0), (-116.0, 43.1))), (None, there), (5001, None)], f"segment_id long, line {LINE}")
    got = geometry.overlap_pairs(df, 43.6).collect()
    assert sorted((r["id_a"], r["id_b"]) for r in got) == [(i, j) for i in range(copies) for j in range(i + 1, copies) if (i % 3 == 0) != (j % 3 == 0)]
    assert {round(r["distance"], 3) for r in got} == {round(0.0001 * 111320 * math.cos(math.radians(43.6)), 3)}
    assert {r["segment_id"] for r in geometry.offset_overlapping(df, 43.6).collect() if r["offset"]} == set(range(copies))


def test_pairs_of_rows_that_share_an_id(spark):
    """Each row has the bearing of its own line, and no pair with a row of its id."""
    south, east, north = polyline((-116.2, 43.62), (-116.2, 43.61)), polyline((-116.201, 43.615), (-116.199, 43.615)), polyline((-116.0, 43.0), (-116.0, 43.1))
    frame = lambda *rows: spark.createDataFrame(list(rows), f"segment_id long, line {LINE}")
    pairs = lambda df: sorted(tuple(r) for r in geometry.overlap_pairs(df, 43.6).collect())
    crossed = frame((1, east), (1, north), (2, south))
    assert pairs(crossed) == []
    twice = frame((1, south[::-1]), (1, south[::-1]), (1, south), (2, south), (3, north))
    assert pairs(twice) == [(1, 2, 0.0), (1, 2, 0.0)]


def test_rows_that_share_an_id_move_by_their_own_bearings(spark):
    south, east, north = polyline((-116.2, 43.62), (-116.2, 43.61)), polyline((-116.201, 43.615), (-116.199, 43.615)), polyline((-116.0, 43.0), (-116.0, 43.1))
    moved = lambda *rows: {r["segment_id"] for r in geometry.offset_overlapping(spark.createDataFrame(list(rows), f"segment_id long, line {LINE}"), 43.6).collect() if r["offset"]}
    assert moved((1, east), (1, north), (2, south)) == set()
    assert moved((1, south), (1, south[::-1])) == set()
    assert moved((1, south), (1, south[::-1]), (2, south), (3, north)) == {1, 2}
    assert moved((2, south), (1, south), (2, south[::-1])) == {1, 2}


@pytest.mark.parametrize("overlapping", [geometry.overlap_pairs, geometry.offset_overlapping])
def test_overlaps_broadcast_nothing_however_small_the_table_looks(spark, overlapping):
    point = lambda lat: f"named_struct('lon', -116.2D + id / 1000, 'lat', {lat}D)"
    df = spark.range(3).selectExpr("id AS segment_id", f"array({point(43.61)}, {point(43.62)}) AS line")
    assert "Broadcast" not in overlapping(df, 43.6)._jdf.queryExecution().executedPlan().toString()


def test_session_keeps_one_decomposition(spark):
    study = Study(spark_series(spark))
    session = analysis.Session(study)
    options = {"freq_minutes": 60, "min_samples": 40}
    first = session.adjusted("travel_time", window=(0, 24), **options)
    assert session.adjusted("travel_time", **options) is first
    session.close()
