import hashlib
import json
import zipfile
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from wayline.operators import geometry
from wayline.schema import Provenance, Study
from wayline.sources import exports, files, sinks
from wayline.sources.store import Store, area_identity, detect_bin, keep_first
from wayline.streaming import ingest

HEADER = "Date Time,Segment ID,UTC Date Time,Speed(miles/hour),Hist Av Speed(miles/hour),Ref Speed(miles/hour),Travel Time(Minutes),CValue,Pct Score30,Pct Score20,Pct Score10,Road Closure,Corridor/Region Name"
ROWS = [
    "2026-01-15T08:00:00-07:00,1001,2026-01-15T15:00:00Z,30,31,35,1.5,90,100,0,0,F,Main",
    "2026-07-15T08:00:00-06:00,1001,2026-07-15T14:00:00Z,28,31,35,bad,95,100,0,0,T,Main",
    "2026-07-15T08:00:00-06:00,1002,2026-07-15T14:00:00Z,NaN,31,35,2.0,40,100,0,0,,Main",
]


def export(path, rows, decoy=True):
    with zipfile.ZipFile(path, "w") as z:
        if decoy:
            z.writestr("x/metadata.csv", "Segment ID\n1\n")
        z.writestr("x/data.csv", "\n".join([HEADER, *rows]) + "\n")
    return str(path)


def test_zip_in_parts(spark, tmp_path):
    export(tmp_path / "e_part_1.zip", ROWS[:1])
    export(tmp_path / "e_part_2.zip", ROWS[1:2])
    export(tmp_path / "e_part_10.zip", ROWS[2:])
    first = f"file:{tmp_path}/e_part_1.zip"
    assert [p.rsplit("_", 1)[-1] for p in files.discover_parts(spark, first)] == ["1.zip", "2.zip", "10.zip"]
    study = exports.load_observations(spark, first)
    rows = study.observations.orderBy("ts_utc", "segment_id").collect()
    assert study.provenance.units == {"speed": "miles/hour", "travel_time": "Minutes"}
    assert [r["ts_utc"].hour for r in rows] == [15, 14, 14]
    assert [r["road_closure"] for r in rows] == [False, True, False]
    assert rows[1]["travel_time"] is None and rows[2]["speed"] is None and rows[0]["speed"] == 30.0
    assert exports.load_observations(spark, first, nrows=1).observations.count() == 3


def test_plain_csv_and_missing_member(spark, tmp_path):
    (tmp_path / "data.csv").write_text("\n".join([HEADER, *ROWS]) + "\n")
    assert exports.load_observations(spark, f"file:{tmp_path}/data.csv").observations.count() == 3
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("metadata.csv", "a\n1\n")
    with pytest.raises(Exception, match="data.csv"):
        exports.load_observations(spark, f"file:{tmp_path}/bad.zip").observations.count()


def test_metadata_and_names(spark, tmp_path):
    (tmp_path / "metadata.csv").write_text("Segment ID,Road,Direction,Intersection,Segment Length(Miles)\n7,Main  St,,5th / 6th,0.5\n8,Oak,N,,\n")
    rows = exports.load_metadata(spark, f"file:{tmp_path}/metadata.csv").orderBy("segment_id").collect()
    assert [r["combined"] for r in rows] == ["Main St 5th / 6th", "Oak N"] and rows[0]["miles"] == 0.5 and rows[1]["miles"] is None
    (tmp_path / "names.csv").write_text("Segment ID,name\n1,NA\n2,  None \n3,\n")
    assert [r["name"] for r in exports.load_names(spark, f"file:{tmp_path}/names.csv").orderBy("segment_id").collect()] == ["NA", "None", ""]


def observed(spark, minutes, segment=1, value=1.0):
    rows = [(segment, f"2026-01-01 08:{m:02d}:00", "Main", value) for m in minutes]
    return spark.createDataFrame(rows, "segment_id long, ts string, corridor string, speed double").withColumn("ts_utc", F.col("ts").cast("timestamp_ntz")).drop("ts")


def test_store_merges_and_reloads(spark, tmp_path):
    store = Store(spark, f"file:{tmp_path}/store")
    geo = spark.createDataFrame([(1, [{"lon": -116.0, "lat": 43.0}, {"lon": -116.1, "lat": 43.1}])], "segment_id long, line array<struct<lon:double,lat:double>>")
    key, added = store.ingest(Study(observed(spark, [0, 5, 10]), geometry=geo), "Area")
    assert added == 3 and store.area_names() == ["Area"]
    assert store.ingest(Study(observed(spark, [0, 5, 10], value=9.0)))[1] == 0
    assert store.ingest(Study(observed(spark, [10, 15, 20], value=9.0)))[1] == 2
    assert sorted((r["ts_utc"].minute, r["speed"]) for r in store.load(key).observations.collect()) == [(0, 1.0), (5, 1.0), (10, 1.0), (15, 9.0), (20, 9.0)]
    store.ingest(Study(observed(spark, [0, 15, 30])))
    assert store.area_bins(key) == [5, 15]
    with pytest.raises(ValueError):
        store.load(key)
    assert store.load(key, 15).observations.count() == 3
    store.ingest_volumes(key, spark.createDataFrame([(1, 42000.0)], "segment_id long, aadt double"))
    got = store.load(key, 5).geometry.first()
    assert got["aadt"] == 42000.0 and len(got["line"]) == 2
    assert store.ingests().count() == 4 and store.areas().count() == 1
    store.remove(key)
    assert store.areas().count() == 0 and store.area_bins(key) == []


def test_identity_and_bins(spark):
    assert area_identity(observed(spark, [0])).first()["area_name"] == "Main"
    assert detect_bin(observed(spark, [0, 5, 10, 25])).first()["bin_minutes"] == 5
    with pytest.raises(ValueError):
        Store(spark, "/nowhere").ingest(Study(observed(spark, [0])))


def test_keep_first_in_a_batch(spark):
    batch = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (None, 2, "c")], "k int, n int, v string")
    assert [r["v"] for r in keep_first(None, batch, ["k"], ["n"]).collect()] == ["a"]


def test_documents(spark):
    lines = spark.createDataFrame([(1, "A & B", [{"lon": -116.0, "lat": 43.0}, {"lon": -116.1, "lat": 43.1}], 35.0), (2, "C", [{"lon": -116.0, "lat": 43.0}, {"lon": -116.2, "lat": 43.0}], 18.0), (3, "D", None, 5.0)], "segment_id long, name string, line array<struct<lon:double,lat:double>>, speed double")
    doc = json.loads(sinks.to_geojson(lines, "name"))
    assert [f["properties"]["segment_id"] for f in doc["features"]] == [1, 2] and doc["features"][0]["geometry"]["coordinates"][0] == [-116.0, 43.0]
    coloured = sinks.ramp_colours(lines.where("segment_id < 3"), "speed")
    assert {r["segment_id"]: r["colour"] for r in coloured.collect()} == {1: "d7191c", 2: "2b83ba"}
    root = ET.fromstring(sinks.to_kml(coloured, "T"))
    ns = "{http://www.opengis.net/kml/2.2}"
    assert [m.find(f"{ns}name").text for m in root.iter(f"{ns}Placemark")] == ["A & B", "C"] and len(list(root.iter(f"{ns}Style"))) == 2
    assert len({r["colour"] for r in sinks.category_colours(lines, "name").collect()}) == 3
    assert sinks.to_csv(lines.select("segment_id", "name").orderBy("segment_id")).splitlines()[1] == "1,A & B"


def test_connectivity(spark):
    net = spark.createDataFrame([(1, 2, None), (2, None, 1)], "segment_id long, next_id long, previous_id long")
    assert geometry.connectivity(net).collect() == [(1, 2)] and geometry.connectivity(net, "prev").collect() == [(2, 1)]


def test_stream_equals_batch(spark, tmp_path):
    source = f"file:{tmp_path}/in"
    for part in ([0, 5, 10], [10, 15]):
        observed(spark, part).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    store = Store(spark, f"file:{tmp_path}/store")
    query = ingest.into_store(ingest.first_rows(ingest.read_stream(spark, source, schema, 1)), store, f"file:{tmp_path}/check", 5, "Area")
    query.awaitTermination(120)
    key = store.areas().first()["area_key"]
    assert sorted(r["ts_utc"].minute for r in store.load(key).observations.collect()) == [0, 5, 10, 15]
    summary = ingest.tumbling_summary(ingest.read_stream(spark, source, schema), "speed", "5 minutes")
    query = summary.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", f"file:{tmp_path}/check2").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("SELECT sum(count) FROM tumbled").first()[0] == 5


def test_area_identity_of_odd_names(spark):
    rows = spark.createDataFrame([(1, 'I-84: West "Q"'), (2, "Main"), (2, "Main")], "segment_id long, corridor string")
    row = area_identity(rows).first()
    assert (row["area_name"], json.loads(row["corridors"])) == ('I-84: West "Q", Main', ['I-84: West "Q"', "Main"])
    assert row["area_key"] == hashlib.md5(b'corridors:I-84: West "Q"|Main').hexdigest()[:12]
    bare = area_identity(spark.createDataFrame([(10,), (9,), (9,)], "segment_id long")).first()
    assert (bare["area_name"], bare["area_key"]) == ("segments(2)", hashlib.md5(b"segments:9,10").hexdigest()[:12])


def test_units_and_counts_are_kept(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    units = {"speed": "miles/hour", "travel_time": "Minutes"}
    key, added = store.ingest(Study(observed(spark, [0, 5, 10]), provenance=Provenance(units)))
    again = store.ingest(Study(observed(spark, [10, 15]), provenance=Provenance(units)), bin_minutes=5)
    assert (added, again[1]) == (3, 1) and store.load(key).provenance.units == units
    assert sorted((r["n_read"], r["n_added"]) for r in store.ingests().collect()) == [(2, 1), (3, 3)]
