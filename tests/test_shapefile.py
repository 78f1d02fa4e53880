import math
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from wayline.operators import summarize
from wayline.plans import analysis
from wayline.schema import Study
from wayline.sources import shapefile


def box(points):
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


def shx(lines):
    out, at = b"\0" * 100, 100
    for points in lines:
        size = 4 if points is None else 48 + 16 * len(points)
        out += struct.pack(">ii", at // 2, size // 2)
        at += 8 + size
    return out


def shp(lines):
    records = b""
    for k, points in enumerate(lines):
        body = struct.pack("<i", 0) if points is None else struct.pack("<i4dii", 3, *box(points), 1, len(points)) + struct.pack("<i", 0) + b"".join(struct.pack("<dd", *p) for p in points)
        records += struct.pack(">ii", k + 1, len(body) // 2) + body
    return b"\0" * 100 + records


def dbf(names, rows, width=12):
    head = 32 + 32 * len(names) + 1
    out = bytes([3, 24, 1, 1]) + struct.pack("<IHH", len(rows), head, 1 + width * len(names)) + b"\0" * 20
    for n in names:
        out += n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15
    return out + b"\r" + b"".join(b" " + b"".join(str(v).encode().rjust(width) for v in r) for r in rows)


def forward(lon, lat, zone=shapefile.STATE_ZONE, ellipsoid=shapefile.GRS80):
    (lat0, lon0, k0, east, north), (a, f) = zone, ellipsoid
    e2 = f * (2 - f)
    ep2, p, q = e2 / (1 - e2), math.radians(lat), math.radians(lat0)
    arc = lambda z: a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * z - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * z) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * z) - 35 * e2**3 / 3072 * math.sin(6 * z))
    n, t, c, d = a / math.sqrt(1 - e2 * math.sin(p) ** 2), math.tan(p) ** 2, ep2 * math.cos(p) ** 2, math.radians(lon - lon0) * math.cos(p)
    x = east + k0 * n * (d + (1 - t + c) * d**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * d**5 / 120)
    y = north + k0 * (arc(p) - arc(q) + n * math.tan(p) * (d**2 / 2 + (5 - t + 9 * c + 4 * c**2) * d**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * d**6 / 720))
    return x, y


def test_projection_round_trip(spark):
    places = [(-116.2, 43.6), (-114.0, 42.0), (-117.0, 48.9), (-111.1, 44.2)]
    df = spark.createDataFrame([(k, *forward(*p)) for k, p in enumerate(places)], "id int, x double, y double")
    lon, lat = shapefile.inverse_mercator(F.col("x"), F.col("y"))
    for row, (want_lon, want_lat) in zip(df.orderBy("id").select(lon.alias("lon"), lat.alias("lat")).collect(), places):
        assert row["lon"] == pytest.approx(want_lon, abs=1e-7) and row["lat"] == pytest.approx(want_lat, abs=1e-7)


def test_network_layer(spark, tmp_path):
    lines = [[(-116.2, 43.6), (-116.1, 43.7)], None, [(-110.0, 40.0), (-110.1, 40.1)]]
    table = dbf(["XDSegID", "NextXDSegI", "Miles"], [(1, 2, "0.5"), (2, "", "x"), (3, 1, 2)])
    with zipfile.ZipFile(tmp_path / "n.zip", "w") as z:
        z.writestr("d/n.shp", shp(lines))
        z.writestr("d/n.dbf", table)
    got = {r["segment_id"]: r for r in shapefile.network_layer(spark, f"file:{tmp_path}/n.zip").collect()}
    assert got[1]["next_id"] == 2 and got[1]["miles"] == 0.5 and len(got[1]["line"]) == 2
    assert got[2]["next_id"] is None and got[2]["miles"] is None and got[2]["line"] is None
    (tmp_path / "n.shp").write_bytes(shp(lines))
    (tmp_path / "n.dbf").write_bytes(table)
    for source in (f"file:{tmp_path}/n.shp", f"file:{tmp_path}"):
        assert [r["segment_id"] for r in shapefile.network_layer(spark, source, bbox=(-117, 43, -116, 44)).collect()] == [1]
    assert [r["segment_id"] for r in shapefile.network_layer(spark, f"file:{tmp_path}/n.zip", [3]).collect()] == [3]


def test_volume_layer(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("v.shp", shp([[forward(-116.2, 43.6), forward(-116.1, 43.6)]] * 2))
        z.writestr("v.dbf", dbf(["Year", "Route", "AADT"], [(2024, "SH-55", 42000), (2023, "SH-55", 1)]))
    row = shapefile.volume_layer(spark, f"file:{tmp_path}/v.zip").collect()
    assert len(row) == 1 and row[0]["aadt"] == 42000.0 and row[0]["line"][0]["lon"] == pytest.approx(-116.2, abs=1e-7)


@pytest.mark.parametrize("zipped", [True, False])
def test_a_layer_is_read_in_ranges_and_only_decoded_where_it_is_asked_for(spark, tmp_path, monkeypatch, zipped):
    lines = [None if k % 13 == 5 else [forward(-116.5 + k / 50, 43.0 + k / 100), forward(-116.5 + k / 50, 43.01 + k / 100)] for k in range(57)]
    table = dbf(["Year", "Route", "AADT", "Extra"], [(2024 if k % 2 else 2023, f"R{k}", k, "ü") for k in range(57)])
    kinds = {".shp": shp(lines), ".dbf": table, ".shx": shx(lines)}
    if zipped:
        source = f"file:{tmp_path}/v.zip"
        with zipfile.ZipFile(tmp_path / "v.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for kind, content in kinds.items():
                z.writestr(f"d/v{kind}", content)
    else:
        source = f"file:{tmp_path}/v.shp"
        for kind, content in kinds.items():
            (tmp_path / f"v{kind}").write_bytes(content)
    raw = shapefile.load_layer(spark, source, per_partition=10)
    assert raw.rdd.getNumPartitions() == 6 and raw.columns == ["Year", "Route", "AADT", "Extra", "line"]
    got = raw.collect()
    assert [r["Route"] for r in got] == [f"R{k}" for k in range(57)] and [r["line"] is None for r in got] == [x is None for x in lines]
    assert all(r["line"] is None or (r["line"][1]["lon"], r["line"][1]["lat"]) == x[1] for r, x in zip(got, lines))
    bbox = (-116.21, 43.105, -115.895, 43.355)
    found = shapefile.volume_layer(spark, source, bbox=bbox)
    want = [k for k in range(57) if k % 2 and k % 13 != 5 and -116.21 <= -116.5 + k / 50 <= -115.895 and 43.0 + k / 100 <= 43.355 and 43.01 + k / 100 >= 43.105]
    assert sorted(r["route"] for r in found.collect()) == sorted(f"R{k}" for k in want) and "extra" not in found.columns
    near = shapefile.load_layer(spark, source, ["Route"], {"Year": ["2024"]}, shapefile.projected_box(bbox, shapefile.STATE_ZONE))
    assert near.columns == ["Route", "line"] and len(want) <= near.count() <= len(want) + 2
    with monkeypatch.context() as m:
        m.setattr(shapefile, "opens", lambda path: False)
        assert shapefile.load_layer(spark, source, ["Route"], {"Year": ["2024"]}).count() == 28


def test_projected_box_holds_what_the_box_holds():
    w, s, e, n = shapefile.projected_box((-117.0, 42.5, -113.0, 46.0), shapefile.STATE_ZONE)
    for i in range(21):
        for j in range(21):
            x, y = forward(-117.0 + i / 5, 42.5 + 3.5 * j / 20)
            assert w <= x <= e and s <= y <= n


def test_free_flow_choices():
    assert summarize.parse_free_flow("ref") == "ref" and summarize.parse_free_flow("p85") == ("p85", 85.0)
    for bad in ("85", "p", "p101", 3):
        with pytest.raises(ValueError):
            summarize.parse_free_flow(bad)


def test_speed_is_not_summed(spark):
    with pytest.raises(ValueError):
        analysis.analysis_series(Study(spark.createDataFrame([(1,)], "speed int")), "speed", "network")
