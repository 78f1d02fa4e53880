import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from wayline.functions import calendar as cal
from wayline.plans import ingestion
from wayline.plans.analysis import Session
from wayline.schema import Study
from wayline.sources import exports, kml, names
from wayline.sources.store import Store

NS = "{http://www.opengis.net/kml/2.2}"
LINES = "segment_id long, name string, line array<struct<lon:double,lat:double>>, colour string, source string, shown double"


def points(*xy):
    return [{"lon": float(x), "lat": float(y)} for x, y in xy]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(
        [(2, "A & <B>", points((0, 0), (3, 0), (3, 1)), "ff0000", "xd", 2.5), (1, None, points((0, 0), (0, 0), (2, 4)), "0000ff", "fallback", 1.0), (3, "C", None, "0000ff", "missing", None)], LINES
    )


def test_published_document(lines):
    root = ET.fromstring(kml.publish(lines, "T & U", "name", "shown", labels=True))
    marks = list(root.iter(f"{NS}Placemark"))
    assert [m.find(f"{NS}name").text for m in marks] == ["1", "A & <B>"]
    assert [m.find(f"{NS}description").text for m in marks] == ["Segment ID: 1<br>Geometry: fallback<br>shown: 1.0", "Segment ID: 2<br>Geometry: xd<br>shown: 2.5"]
    assert [m.find(f".//{NS}Point/{NS}coordinates").text for m in marks] == ["1.000000,2.000000,0", "2.000000,0.000000,0"]
    assert all(m.find(f".//{NS}tessellate").text == "1" for m in marks)
    styles = {s.get("id"): s.find(f"{NS}LineStyle/{NS}color").text for s in root.iter(f"{NS}Style")}
    assert styles == {"c0000ff": "ffff0000", "cff0000": "ff0000ff"} and {m.find(f"{NS}styleUrl").text[1:] for m in marks} == set(styles)
    legend = root.find(f".//{NS}ScreenOverlay/{NS}description").text
    assert "shown = 1<br>" in legend and "shown = 2.5<br>" in legend
    assert root.find(f".//{NS}LabelStyle/{NS}scale").text == "1.0"


def test_legends_and_colours(lines):
    assert kml.legend_rows(lines, "source") == [("source: fallback", "0000ff"), ("source: missing", "0000ff"), ("source: xd", "ff0000")]
    assert kml.legend_rows(lines.where("segment_id = 1"), "shown") == [] and kml.legend_rows(lines.where("segment_id = 3"), "shown") == []
    assert [kml.colour(c) for c in ("Teal", "#0A0b0C", (1, 2, 255), "ff0000ff")] == ["008080", "0a0b0c", "0102ff", "ff0000"]
    with pytest.raises(ValueError):
        kml.colour("no such colour")


def test_names_come_back(spark, tmp_path):
    metadata = spark.createDataFrame([(8, "Oak", "N", "", "Oak N"), (7, "Main", "", '5th "Old" / 6th', "Main 5th")], "segment_id long, road string, direction string, intersection string, combined string")
    path = f"file:{tmp_path}/names"
    names.write_template(metadata, path)
    rows = exports.load_names(spark, path).orderBy("segment_id").collect()
    assert [tuple(r) for r in rows] == [(7, "Main 5th", 'Main & 5th "Old" & 6th'), (8, "Oak N", "Oak")]
    names.write_names(spark.createDataFrame([(9, " NA "), (8, None)], "segment_id long, name string"), path)
    assert [tuple(r) for r in exports.load_names(spark, path).orderBy("segment_id").collect()] == [(8, "", ""), (9, "", "NA")]
    with pytest.raises(ValueError):
        names.write_names(metadata.drop("road"), path)


def test_ingest_study(spark, tmp_path):
    data = "\n".join(["Date Time,Segment ID,Travel Time(Minutes),CValue,Corridor/Region Name", *(f"2026-01-15T08:{m:02d}:00-07:00,{s},1.5,90,Main" for s in (1, 2) for m in (0, 5, 10))])
    meta = "Segment ID,Road,Direction,Intersection,Start Latitude,Start Longitude,End Latitude,End Longitude,Segment Length(Miles)\n1,Main,N,5th,43.6,-116.2,43.61,-116.2,0.7\n2,Main,S,6th,43.7,-116.2,43.69,-116.2,0.7\n"
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("x/data.csv", data + "\n")
        z.writestr("x/metadata.csv", meta)
    source = f"file:{tmp_path}/e.zip"
    network = spark.createDataFrame([(1, points((-116.2, 43.6), (-116.2, 43.61)))], "segment_id long, line array<struct<lon:double,lat:double>>")
    volumes = spark.createDataFrame([(5, 900.0, "R5", points((-116.2, 43.6), (-116.2, 43.61))), (6, 700.0, "R6", points((-110.0, 43.6), (-110.0, 43.61)))], "line_id long, aadt double, route string, line array<struct<lon:double,lat:double>>")
    store = Store(spark, f"file:{tmp_path}/store")
    info = ingestion.ingest_study(store, source, network, volumes)
    assert (info["area_name"], info["bin_minutes"], info["n_rows_added"]) == ("Main", 5, 6)
    assert ingestion.ingest_study(store, source, network, volumes)["n_rows_added"] == 0
    study = store.load(info["area_key"])
    shown = ingestion.decorated(study, spark.createDataFrame([(2, "Second")], "segment_id long, name string")).orderBy("segment_id").collect()
    assert [(r["source"], r["match"], r["aadt"], r["direction_group"], r["direction_sign"], r["name"]) for r in shown] == [("xd", "matched", 900.0, "N", 1, "Main & 5th"), ("fallback", "nearest", None, "S", -1, "Second")]


def test_display_and_members(spark):
    rows = spark.createDataFrame([(1, "N"), (2, "S"), (3, None)], "segment_id long, direction_group string")
    shown = lambda groups: sorted(r["segment_id"] for r in ingestion.display_lines(rows, groups).collect())
    assert (shown(None), shown(["N"]), shown(["N", "S", "E"]), shown(["W"])) == ([1, 2, 3], [1], [1, 2, 3], [1, 2, 3])
    picked = lambda m: ingestion.chosen_members(rows, m)
    assert (picked(None), picked([2, "1", 9]), picked([1, 2, 3]), picked([9])) == (None, [1, 2], None, None)
    assert ingestion.padded_box(spark.createDataFrame([(1, None)], "segment_id long, line array<struct<lon:double,lat:double>>")) is None


def test_decomposition_panel(spark):
    rows = spark.range(24 * 60).select((F.col("id") % 2).alias("segment_id"), (F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("id") / 2).cast("int"))).cast("timestamp_ntz").alias("ts_utc"), (F.lit(5.0) + F.when(F.col("id") > 900, 3.0).otherwise(0.0) + F.rand(1) / 10).alias("travel_time"))
    session = Session(Study(cal.to_local(rows)))
    panel, found = ingestion.decomposition_panel(session, "travel_time", 1, freq_minutes=60, min_samples=10)
    assert {r["segment_id"] for r in panel.select("segment_id").distinct().collect()} == {1} and {"median", "season_day", "season_week", "resid"} <= set(panel.columns)
    assert set(found.columns) >= {"changepoint_date", "score"}
    with pytest.raises(ValueError):
        ingestion.decomposition_panel(session, "travel_time")
    session.close()
