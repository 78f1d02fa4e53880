"""Row windows in blocks, lines as well-known binary, and the plans of the completeness rules."""

import struct
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayline.functions import wkb
from wayline.operators import completeness, summarize
from wayline.sources import exports

LINE = "array<struct<lon:double,lat:double>>"


def long_series(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s, n in ((1, 900), (2, 7), (None, 40), (3, 1)):
        t = datetime(2026, 1, 1)
        for _ in range(n):
            rows.append((s, t, float(rng.integers(0, 100)) if rng.random() > 0.1 else None, len(rows)))
            t += timedelta(hours=float(rng.choice([1, 5, 700], p=[0.6, 0.39, 0.01])))
    return spark.createDataFrame(rows, "segment_id long, ts_utc timestamp_ntz, v double, id int")


@pytest.mark.parametrize("direction, window", [("trailing", 5), ("leading", 7), ("centered", 4), ("centered", 1)])
def test_blocks_give_the_same_averages(spark, direction, window):
    df = long_series(spark)
    own = summarize.rolling_average(df, "v", window, direction=direction, out="m").orderBy("id").collect()
    blocks = summarize.rolling_average(df, "v", window, direction=direction, out="m", block_rows=11)
    assert blocks.columns == [*df.columns, "m"] and blocks.orderBy("id").collect() == own


def test_a_hot_series_runs_in_many_tasks(spark):
    df = long_series(spark).where("segment_id = 1")
    both = [x.orderBy("id").collect() for x in (summarize.neighbour_averages(df, "v", 3), summarize.neighbour_averages(df, "v", 3, block_rows=20))]
    assert both[0] == both[1]
    spread = summarize.rolling_average(df, "v", 5, block_rows=20)
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan
    with pytest.raises(ValueError):
        summarize.rolling_average(df, "v", 50, block_rows=20)


def test_wkb_round_trip_and_known_bytes(spark):
    lines = [[(-116.0, 43.5), (-116.5, 43.25)], None, [], [(1.0, 2.0)], [(float(k), -float(k)) for k in range(300)]]
    df = spark.createDataFrame([(k, None if p is None else [{"lon": x, "lat": y} for x, y in p]) for k, p in enumerate(lines)], f"id int, line {LINE}")
    got = df.select("id", "line", wkb.to_wkb(F.col("line")).alias("b")).withColumn("back", wkb.from_wkb(F.col("b"))).orderBy("id").collect()
    assert bytes(got[0]["b"]).hex() == "010200000002000000" + struct.pack("<4d", -116.0, 43.5, -116.5, 43.25).hex()
    assert got[1]["b"] is None and got[2]["b"] is None
    assert all(r["back"] == r["line"] for r in got if r["id"] != 2)
    assert wkb.encode(pa.array([], type=pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))).to_pylist() == []


def test_wkb_of_other_writers():
    pair = [{"lon": 1.0, "lat": 2.0}, {"lon": 3.0, "lat": 4.0}]
    big = struct.pack(">BII4d", 0, 2, 2, 1, 2, 3, 4)
    with_z = struct.pack("<BII6d", 1, 1002, 2, 1, 2, 9, 3, 4, 9)
    flagged = struct.pack("<BIII6d", 1, 2 | 0x80000000 | 0x20000000, 4326, 2, 1, 2, 9, 3, 4, 9)
    multi = struct.pack(">BII", 0, 5, 2) + struct.pack("<BII2d", 1, 2, 1, 1, 2) + struct.pack(">BII2d", 0, 2, 1, 3, 4)
    assert wkb.decode(pa.array([big, with_z, None, flagged, multi], type=pa.binary())).to_pylist() == [pair, pair, None, pair, pair]
    with pytest.raises(ValueError):
        wkb.decode(pa.array([struct.pack("<BI2d", 1, 1, 1, 2)], type=pa.binary()))


def test_layers_with_binary_geometry(spark, tmp_path):
    line = [{"lon": -116.0, "lat": 43.0}, {"lon": -116.1, "lat": 43.1}]
    df = spark.createDataFrame([(1, 2024, "12", line), (2, 2023, "x", line)], f"line_id long, year int, aadt string, line {LINE}")
    df.select("line_id", "year", "aadt", F.lit("R").alias("route"), wkb.to_wkb(F.col("line")).alias("geometry")).write.parquet(f"file:{tmp_path}/v")
    got = exports.load_volumes(spark, f"file:{tmp_path}/v", bbox=(-117, 42, -115, 44)).collect()
    assert [(r["line_id"], r["aadt"], r["line"]) for r in got] == [(1, 12.0, line)] or [r.asDict(True)["line"] for r in got] == [line]


def test_documents_written_by_tasks(spark, tmp_path):
    import json
    import xml.etree.ElementTree as ET

    from wayline.sources import kml, sinks

    lines = spark.createDataFrame([(k, [{"lon": -116.0 - k, "lat": 43.0}, {"lon": -116.1, "lat": 43.1}], float(k), f"A & {k}") for k in range(40)], f"segment_id long, line {LINE}, v double, name string").repartition(4)
    sinks.write_geojson(lines, f"file:{tmp_path}/g", "name")
    joined = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    assert json.loads(joined("g")) == json.loads(sinks.to_geojson(lines, "name"))
    coloured = sinks.ramp_colours(lines, "v")
    kml.write_published(coloured, f"file:{tmp_path}/k", "T", "name", "v")
    assert ET.tostring(ET.fromstring(joined("k").replace("\n", ""))) == ET.tostring(ET.fromstring(kml.publish(coloured, "T", "name", "v")))
    sinks.write_geojson(lines.where("segment_id < 0"), f"file:{tmp_path}/none")
    assert json.loads(joined("none"))["features"] == []


def test_bins_and_spans_of_long_segments(spark):
    from wayline.sources.store import area_span, detect_bin

    df = long_series(spark)
    assert detect_bin(df, block_rows=13).collect() == detect_bin(df).collect()
    row = area_span(df).first()
    want = df.agg(F.min("ts_utc"), F.max("ts_utc"), F.count_distinct("segment_id"), F.count("*")).first()
    assert tuple(row) == tuple(want)


def scans(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan") or df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


def test_the_rows_are_read_once(spark, tmp_path):
    rows = [(c, s, datetime(2026, 1, 1, h), 1.0 * s if (s + h) % 5 else None) for c in "ab" for s in range(4) for h in range(12) if (s * h) % 3 or c == "a"]
    spark.createDataFrame(rows, "corridor string, segment_id long, ts_utc timestamp_ntz, travel_time double").write.parquet(f"file:{tmp_path}/o")
    df = spark.read.parquet(f"file:{tmp_path}/o")
    assert scans(completeness.corridor_travel_time(df)) == 1
    got = {(r["corridor"], r["ts_utc"].hour): r for r in completeness.corridor_travel_time(df, require_complete=False).collect()}
    for c in "ab":
        most = max(len({s for k, s, t, _ in rows if k == c and t.hour == h}) for h in range(12))
        for h in range(12):
            own = [v for k, s, t, v in rows if k == c and t.hour == h and v is not None]
            if (c, h) in got:
                assert (got[c, h]["n_segments"], got[c, h]["expected"], got[c, h]["travel_time"]) == (len(own), most, sum(own) if own else None)
