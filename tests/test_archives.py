"""Exports in parts, read by name and streamed, and a store that a killed writer leaves readable."""

import zipfile

import pytest
from pyspark.sql import functions as F

from wayline.schema import Study
from wayline.sources import archives, exports, files
from wayline.sources.store import Store

HEADER = "Date Time,Segment ID,UTC Date Time,Speed(miles/hour),Travel Time(Minutes),CValue,Corridor/Region Name"


def part(path, header, rows, member="x/data.csv"):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/other_data.csv", "never,read\n1,2\n")
        z.writestr(member, "\n".join([header, *rows]) + "\n")


def row(minute, segment=1, speed=30):
    return f"2026-01-15T08:{minute:02d}:00-07:00,{segment},,{speed},1.5,90,Main"


@pytest.mark.parametrize("direct", [True, False])
def test_parts_with_different_columns(spark, tmp_path, monkeypatch, direct):
    """The union of headers by name, whichever part has them, in any order; in one partition a part."""
    if not direct:
        monkeypatch.setattr(archives, "opens", lambda path: False)
    part(tmp_path / "e_part_2.zip", HEADER, [row(m) for m in range(5)])
    part(tmp_path / "e_part_10.zip", "Segment ID,Date Time,Pct Score30,Speed(miles/hour)", ['2,2026-01-15T09:00:00-07:00,7,"41"', '2,2026-01-15T09:05:00-07:00,x,""'])
    part(tmp_path / "e_part_11.zip", HEADER, [])
    source = f"file:{tmp_path}/e_part_2.zip"
    df = exports.load_observations(spark, source).observations
    got = df.orderBy("ts_utc").collect()
    assert len(got) == 7 and got[5]["pct30"] == 7.0 and got[6]["pct30"] is None and got[5]["speed"] == 41.0 and got[6]["speed"] is None
    assert got[0]["pct30"] is None and got[5]["corridor"] is None and got[0]["corridor"] == "Main"
    if direct:
        assert df.rdd.getNumPartitions() == 3
    assert exports.load_observations(spark, source, nrows=1).observations.count() == 2


def test_rows_beyond_a_block_and_quoted_line_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "BLOCK_BYTES", 1 << 12)
    part(tmp_path / "m.zip", "Segment ID,Road", [f'{k},"Main ""St"", {k}\nüber {"x" * 30}"' for k in range(500)], "metadata.csv")
    df, headers = archives.read_parts(spark, [f"file:{tmp_path}/m.zip"], "metadata.csv")
    got = df.orderBy("_line").collect()
    assert headers == ["Segment ID", "Road"] and [r["_line"] for r in got] == list(range(500)) and got[7]["Road"] == f'Main "St", 7\nüber {"x" * 30}'


def test_plain_files_with_different_columns(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "data.csv").write_text("\n".join([HEADER, row(0), row(5)]) + "\n")
    (tmp_path / "b" / "data.csv").write_text("Segment ID,Date Time,Pct Score20\n3,2026-01-15T10:00:00Z,9\n")
    study = exports.load_observations(spark, f"file:{tmp_path}")
    got = study.observations.orderBy("segment_id", "ts_utc").collect()
    assert [(r["segment_id"], r["pct20"], r["speed"]) for r in got] == [(1, None, 30.0), (1, None, 30.0), (3, 9.0, None)]
    assert exports.load_observations(spark, f"file:{tmp_path}", nrows=1).observations.count() == 2
    with pytest.raises(ValueError):
        exports.load_observations(spark, f"file:{tmp_path}/a/nothing")


def test_the_first_part_by_number_wins(spark, tmp_path):
    part(tmp_path / "e_part_2.zip", HEADER, [row(0, speed=22), row(5, speed=22)])
    part(tmp_path / "e_part_10.zip", HEADER, [row(0, speed=10), row(10, speed=10)])
    store = Store(spark, f"file:{tmp_path}/store")
    key, added = store.ingest(exports.load_observations(spark, f"file:{tmp_path}/e_part_10.zip"))
    assert added == 3 and [r["speed"] for r in store.load(key).observations.orderBy("ts_utc").collect()] == [22.0, 22.0, 10.0]


def observed(spark, minutes, segment=1):
    rows = [(segment, f"2026-01-01 08:{m:02d}:00", "Main", 1.0) for m in minutes]
    return spark.createDataFrame(rows, "segment_id long, ts string, corridor string, speed double").withColumn("ts_utc", F.col("ts").cast("timestamp_ntz")).drop("ts")


def registered(store):
    row = store.areas().first()
    return row["first_ts"].minute, row["last_ts"].minute, row["n_rows"], row["n_segments"]


def test_registry_follows_without_reading_the_area(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file:{tmp_path}/store")
    key, _ = store.ingest(Study(observed(spark, [10, 15, 20])))
    assert registered(store) == (10, 20, 3, 1)
    store.ingest(Study(observed(spark, [15, 20, 25, 30])))
    store.ingest(Study(observed(spark, [0, 5, 10], segment=2)))
    assert registered(store) == (0, 30, 8, 2)
    assert store.ingest(Study(observed(spark, [0, 5, 10], segment=2)))[1] == 0 and registered(store) == (0, 30, 8, 2)
    assert not files.exists(spark, f"{store.root}/pending/{key}")


def test_a_killed_ingest_is_counted_again(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file:{tmp_path}/store")
    key, _ = store.ingest(Study(observed(spark, [10, 15, 20])))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(store, "_register", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        store.ingest(Study(observed(spark, [25, 30, 35], segment=2)))
    assert registered(store) == (10, 20, 3, 1) and store.load(key).observations.count() == 6
    assert store.ingest(Study(observed(spark, [25, 30, 40], segment=2)))[1] == 1
    assert registered(store) == (10, 40, 7, 2)


def test_layers_are_swapped_whole(spark, tmp_path):
    line = [{"lon": -116.0, "lat": 43.0}, {"lon": -116.1, "lat": 43.1}]
    geo = lambda *ids: spark.createDataFrame([(i, line) for i in ids], "segment_id long, line array<struct<lon:double,lat:double>>")
    store = Store(spark, f"file:{tmp_path}/store")
    key, _ = store.ingest(Study(observed(spark, [0, 5, 10]), geometry=geo(1)))
    for aadt in (100.0, 200.0, 300.0):
        store.ingest_volumes(key, spark.createDataFrame([(1, aadt, 5.0)], "segment_id long, aadt double, commercial double"))
    store.ingest_geometry(key, geo(1, 2))
    # A version that was never finished doesn't count.
    (tmp_path / "store" / "geo" / f"area_key={key}" / "version=99999999999999999999").mkdir()
    assert sorted((r["segment_id"], r["aadt"]) for r in store.load(key).geometry.collect()) == [(1, 300.0), (2, None)]
    assert len(files.listing(spark, f"{store.root}/geo/area_key={key}/version=*")) == 3


def test_a_killed_removal_leaves_no_area(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file:{tmp_path}/store")
    key, _ = store.ingest(Study(observed(spark, [0, 5, 10])))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(store, "_clear", lambda key: (_ for _ in ()).throw(RuntimeError("killed")))
        store.remove(key)
    assert store.areas().count() == 0
    with pytest.raises(ValueError):
        store.load(key)
    assert store.ingest(Study(observed(spark, [5, 10])))[1] == 2 and registered(store) == (5, 10, 2, 1)
