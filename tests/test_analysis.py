"""Scans, selections and seasons against plain definitions; sessions, maps and what they show."""

import math
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayline.functions import calendar as cal
from wayline.operators import compare, decompose, filters, summarize
from wayline.plans import analysis
from wayline.schema import Study
from wayline.sources import kml, sinks

LINE = "array<struct<lon:double,lat:double>>"


def plans(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plain_bh(p):
    known = [x for x in p if x is not None]
    m = len(known)
    return [None if x is None else max(0.0, min(min(1.0, y * m / sum(z <= y for z in known)) for y in known if y >= x)) for x in p]


def test_bh_is_a_scan(spark):
    rng = np.random.default_rng(0)
    p = [*rng.random(150), *(rng.random(80) ** 30), *([0.5] * 40), *([1.0] * 30), 0.0, 0.0, 5e-324, 1e-310, 2.0**-7, 2.0**-7 - 2.0**-60, None, None]
    p = [None if x is None else float(x) for x in p]
    df = spark.createDataFrame(list(enumerate(p)), "id int, p_value double")
    out = compare.bh_qvalues(df)
    assert [r["q_value"] for r in out.orderBy("id").collect()] == pytest.approx(plain_bh(p), nan_ok=True)
    windows = [line for line in plans(out).split("\n") if "Window [" in line or "Window(" in line]
    assert windows and "SinglePartition" not in "".join(line for line in plans(out).split("\n") if "Exchange" in line and "rank" in line)
    assert compare.bh_qvalues(df.where("id < 0")).count() == 0


def test_medians_by_selection(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(0, 1e3, 300), *([7.25] * 201), *(10.0 ** rng.integers(-200, 200, 60) * rng.choice([-1, 1], 60)), 0.0, -0.0, 1e-320, float("inf"), float("-inf")]
    groups = rng.integers(0, 9, len(values))
    rows = [(int(g), float(v)) for g, v in zip(groups, values)] + [(20, 4.0), (21, 1.0), (21, 2.0), (22, None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r["v_median"] for r in summarize.segment_summary(df, ["v"], ["g"]).collect()}
    want = pd.DataFrame(rows, columns=["g", "v"]).dropna(subset=["g"]).groupby("g")["v"].median()
    assert got.keys() == {int(g) for g in want.index}
    for g, v in want.items():
        assert (got[g] is None and math.isnan(v)) or got[g] == pytest.approx(v, rel=1e-12), g
    assert "percentile" not in plans(summarize.segment_summary(df, ["v"], ["g"])).lower()


def test_the_zone_is_looked_up_once_a_row(spark):
    df = cal.to_local(spark.createDataFrame([(datetime(2026, 3, 8, 10), 1)], "ts_utc timestamp_ntz, segment_id long"))
    out = filters.assign_time_bins(filters.assign_day_group(df)).where("local_date > DATE '2020-01-01'").groupBy("day_group", "time_bin").count()
    assert out._jdf.queryExecution().optimizedPlan().toString().count("convert_timezone") == 1
    assert df.first()["local_ts"] == datetime(2026, 3, 8, 4)


def series(spark, days=20, step=60, segments=(1, 2), seed=3):
    rng = np.random.default_rng(seed)
    ts = pd.date_range("2026-01-05 07:00", periods=days * 24 * 60 // step, freq=f"{step}min")
    pdf = pd.concat([pd.DataFrame({"segment_id": s, "ts_utc": ts, "travel_time": 10 + s + np.sin(ts.hour / 24 * 6.28) + (ts.dayofweek >= 5) + rng.normal(0, 0.2, len(ts))}) for s in segments])
    return cal.to_local(spark.createDataFrame(pdf).withColumn("ts_utc", F.col("ts_utc").cast("timestamp_ntz")))


def test_decomposition_runs_the_median_once_and_has_its_options(spark):
    df = series(spark)
    options = {"freq_minutes": 60, "min_samples": 40}
    out = decompose.decompose(df, "travel_time", **options)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString()
    assert final.split("Initial Plan")[0].count("FlatMapGroupsInPandas") == 1
    bare = decompose.decompose(df, "travel_time", keep_components=False, **options)
    assert {"prediction", "resid"} <= set(bare.columns) and not {"median", "season_day"} & set(bare.columns)
    flat = decompose.decompose(df, "travel_time", trend=False, **options)
    assert flat.count() == df.count() and flat.select("segment_id", "median").distinct().count() == 2
    assert decompose.decompose(df, "travel_time", min_slot_samples=1000, **options).count() == 0
    with pytest.raises(TypeError):
        decompose.decompose(df.withColumn("travel_time", F.col("travel_time").cast("string")), "travel_time", **options)


def test_comparison_rows_tell_their_evidence(spark):
    df = filters.assign_day_group(series(spark, days=24)).where("segment_id = 1 OR local_ts >= TIMESTAMP_NTZ '2026-01-08 12:00:00'")
    df = df.withColumn("travel_time", F.when((F.col("segment_id") == 1) & (F.col("tod_sec") < 3600), None).otherwise(F.col("travel_time")))
    got = {(r["segment_id"], r["day_group"]): r for r in compare.compare_values(df, "20260106-20260115", "20260116-20260125", "travel_time", by=["day_group"], min_samples=2).collect()}
    row = got[1, "Mon–Thu"]
    assert (row["n_before"], row["n_samples_before"], row["before_days_effective"], row["method"]) == (7, 7 * 23, 10.0, "raw")
    late = got[2, "Mon–Thu"]
    assert late["before_days_effective"] == pytest.approx(7.5) and late["after_days_effective"] == 10.0 and late["n_samples_before"] == 12 + 4 * 24
    raw = compare.compare_values(df, "20260106-20260115", "20260116-20260125", "travel_time", unit="sample").where("segment_id = 1").first()
    assert raw["n_before"] == raw["n_samples_before"] == 230
    adjusted = decompose.adjust(series(spark, days=30), "travel_time", freq_minutes=60, min_samples=40)
    assert compare.compare_adjusted(adjusted, "20260112-20260118", "20260119-20260128", "travel_time").first()["method"] == "decomposed"


def test_bounds_with_a_zone(spark):
    utc = "2026-01-10T03:00:00+00:00"
    assert cal.parse_period((utc, "2026-01-12"), "America/Denver")[0] == datetime(2026, 1, 9, 20)
    with pytest.raises(ValueError):
        cal.parse_period((utc, "2026-01-12"))
    df = series(spark, days=8)
    kept = filters.filter_date_range(df, utc, "2026-01-10", tz="America/Denver").agg(F.min("local_date"), F.max("local_date")).first()
    assert tuple(kept) == (date(2026, 1, 9), date(2026, 1, 10))


def test_colours():
    assert [sinks.colour(c) for c in ("Yellow", "#ff0000", (0, 255, 0), (1, 2, 3, 4), "ff123456")] == ["ffd700", "ff0000", "00ff00", "010203", "563412"]
    assert kml.colour("blue") == "0000ff"
    with pytest.raises(ValueError):
        sinks.colour("not-a-color")


def test_ramps_and_categories(spark):
    df = spark.createDataFrame([(1, 10.0, "S"), (2, 20.0, "N"), (3, None, None), (4, 13.0, "S")], "segment_id long, v double, d string")
    ramp = {r["segment_id"]: r["colour"] for r in sinks.ramp_colours(df, "v").collect()}
    assert ramp == {1: "2b83ba", 2: "d7191c", 3: "0000ff", 4: "5e638a"}
    own = {r["segment_id"]: r["colour"] for r in sinks.ramp_colours(df, "v", ("blue", "red")).collect()}
    assert (own[1], own[2]) == ("0000ff", "ff0000")
    assert sinks.ramp_colours(df.where("segment_id = 1"), "v").first()["colour"] == "814e6b"
    kinds = {r["segment_id"]: r["colour"] for r in sinks.category_colours(df, "d").collect()}
    assert kinds == {1: "0000ff", 2: "ff0000", 3: "0000ff", 4: "0000ff"}
    named = {r["segment_id"]: r["colour"] for r in sinks.category_colours(df, "d", {"N": "green", "S": "purple"}).collect()}
    assert named == {1: "800080", 2: "008000", 3: "0000ff", 4: "800080"}
    assert {r["colour"] for r in sinks.category_colours(df, "d", ["teal"]).where("d IS NOT NULL").collect()} == {"008080"}


def study(spark):
    df = series(spark, days=10)
    lines = spark.createDataFrame([(s, [{"lon": s * 1.0, "lat": 1.0}, {"lon": s + 1.0, "lat": 2.0}], f"Road <{s}>", "N") for s in (1, 2)], f"segment_id long, line {LINE}, name string, direction_group string")
    return Study(df.withColumn("corridor", F.lit("Main")), geometry=lines)


def test_a_map_without_a_comparison_shows_means(spark):
    s = study(spark)
    options = {"freq_minutes": 60, "min_samples": 40}
    means = {r["segment_id"]: r["shown"] for r in analysis.map_values(s, "mean", "travel_time").collect()}
    none = analysis.map_values(s, "delta", "travel_time", "20300101-20300105", "20300106-20300110", members=[2], **options).collect()
    assert {r["segment_id"]: r["shown"] for r in none} == pytest.approx(means) and {r["segment_id"]: r["member"] for r in none} == {1: False, 2: True}
    text = analysis.export_kml(s, "mean", "travel_time", "Map & more", labels=True)
    assert "Road &lt;1&gt;" in text and "<ScreenOverlay>" in text and "<Point>" in text and text.count("<Placemark>") == 2


def test_menus(spark):
    got = analysis.capabilities(study(spark))
    assert (got["corridors"], got["directions"], got["scopes"]) == (["Main"], ["N"], ["segment", "corridor", "network"])


def test_session_keeps_results_and_weighted_scopes(spark):
    s = study(spark)
    s = Study(s.observations.withColumn("speed", 60 / F.col("travel_time")))
    session = analysis.Session(s, volumes=spark.createDataFrame([(1, 100.0), (2, 300.0)], "segment_id long, aadt double"), results=1)
    options = {"freq_minutes": 60, "min_samples": 10, "drop_days": 1}
    weighted = session.adjusted("speed", scope="network", weighted=True, **options)
    assert weighted.count() > 0 and session.adjusted("speed", scope="network", **{**options, "weighted": True}) is weighted
    first = session.compare("20260107-20260108", "20260110-20260111", "travel_time", **options)
    assert session.compare("20260107-20260108", "20260110-20260111", "travel_time", **options) is first
    assert session.compare("20260107-20260108", "20260110-20260112", "travel_time", **options) is not first and len(session._compared) == 1
    session.close()


def test_csv_files(spark, tmp_path):
    sinks.write_csv(spark.range(100).withColumn("v", F.col("id") * 2), f"file:{tmp_path}/out", ["id"])
    assert spark.read.option("header", True).csv(f"file:{tmp_path}/out").agg(F.sum("v")).first()[0] == 9900


def shifted(spark, days=60, at=31.4, by=5.0, step=30, seed=1):
    rng = np.random.default_rng(seed)
    ts = pd.date_range("2026-02-02", periods=days * 1440 // step, freq=f"{step}min")
    level = 10 + by * (np.arange(len(ts)) >= at * 1440 // step)
    pdf = pd.concat([pd.DataFrame({"segment_id": s, "ts_utc": ts, "v": (level if s == 1 else 10.0) + rng.normal(0, 1, len(ts))}) for s in (1, 2)])
    return cal.to_local(spark.createDataFrame(pdf).withColumn("ts_utc", F.col("ts_utc").cast("timestamp_ntz")))


def test_changepoints_tell_the_instant(spark, monkeypatch):
    from wayline.operators import shifts

    df = shifted(spark)
    whole = shifts.changepoints_in_time(df, "v").collect()
    assert [r["segment_id"] for r in whole] == [1]
    shift = datetime(2026, 2, 2) + pd.Timedelta(days=31.4)
    assert abs(whole[0]["changepoint_ts"] - shift) <= pd.Timedelta(hours=2) and whole[0]["pct_change"] == pytest.approx(0.5, abs=0.02)
    monkeypatch.setattr(shifts, "CHUNK_DAYS", 9)  # many chunks, the same
    chunked = shifts.changepoints_in_time(df, "v").collect()
    assert [r["changepoint_ts"] for r in chunked] == [r["changepoint_ts"] for r in whole] and chunked[0]["score"] == pytest.approx(whole[0]["score"])
    robust = shifts.changepoints_in_time(df.withColumn("v", F.when(F.pmod(F.hash("ts_utc"), F.lit(50)) == 0, 500.0).otherwise(F.col("v"))), "v", robust=True).collect()
    assert [r["segment_id"] for r in robust] == [1] and robust[0]["avg_diff"] == pytest.approx(5, abs=0.3)
    assert shifts.changepoints_in_time(df, "v", upper_bound=13.5).count() == 0
    back = df.withColumn("v", F.when(F.col("local_date") >= date(2026, 3, 25), F.col("v") - F.when(F.col("segment_id") == 1, 5.0).otherwise(0.0)).otherwise(F.col("v")))
    kept = [r["avg_diff"] > 0 for r in shifts.changepoints_in_time(back, "v", window_days=7).collect()]
    assert True in kept
    assert all(r["avg_diff"] < 0 for r in shifts.changepoints_in_time(back, "v", window_days=7, recent_days=5).collect())
    assert shifts.changepoints_in_time(df.limit(0), "v").count() == 0
