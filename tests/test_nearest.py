"""Nearest lines: local bearings, any distance, and the projection that distances are taken in."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayline.functions import projection
from wayline.operators.nearest import PIECE, nearest_line_join, pieces

LINE = "array<struct<lon:double,lat:double>>"
SEGMENT = [(-116.2, 43.61), (-116.2, 43.62)]


def polyline(*points):
    return [{"lon": x, "lat": y} for x, y in points]


def matched(spark, segments, lines, **options):
    s = spark.createDataFrame([(k, None if p is None else polyline(*p), "x") for k, p in enumerate(segments, 1)], f"segment_id long, line {LINE}, aadt string")
    n = spark.createDataFrame([(k, None if p is None else polyline(*p), 100.0 * k, 10.0 * k, f"R{k}") for k, p in enumerate(lines, 10)], f"line_id long, line {LINE}, aadt double, commercial double, route string")
    return {r["segment_id"]: r for r in nearest_line_join(s, n, **options).collect()}


def test_parallel_is_matched_and_crossing_is_not(spark):
    parallel, crossing = [(-116.1999, 43.605), (-116.1999, 43.625)], [(-116.21, 43.615), (-116.19, 43.615)]
    got = matched(spark, [SEGMENT, None, [(-116.2, 43.6)]], [parallel, crossing])
    assert (got[1]["match"], got[1]["line_id"], got[1]["aadt"], got[1]["commercial"]) == ("matched", 10, 1000.0, 100.0)
    assert got[1]["distance"] == pytest.approx(8.08, abs=0.05)
    assert got[2]["match"] == got[3]["match"] == "missing" and got[2]["line_id"] is None
    alone = matched(spark, [SEGMENT], [crossing])[1]
    assert (alone["match"], alone["distance"], alone["aadt"], alone["commercial"], alone["route"]) == ("nearest", 0.0, None, None, "R10")


def test_a_street_that_crosses_and_then_turns_alongside_keeps_its_volume(spark):
    """Its closest approach is the crossing, however well a later part of it agrees within reach."""
    street = [(-116.201, 43.6105), (-116.1997, 43.6105), (-116.1997, 43.62)]
    assert matched(spark, [SEGMENT], [street])[1]["match"] == "nearest"


def test_a_curve_is_matched_by_its_tangent(spark):
    curve = [(-116.2, 43.61), (-116.2, 43.62), (-116.1, 43.62)]
    assert matched(spark, [SEGMENT], [curve])[1]["match"] == "matched"
    # A right-angled corner five metres from the closest place bends the chord too far.
    corner = [(-116.25, 43.605), (-116.2001, 43.605), (-116.2001, 43.6099)]
    assert matched(spark, [SEGMENT], [corner])[1]["match"] == "matched"


def test_nearest_at_any_distance(spark):
    for degrees in (0.11, 1.0, 9.0, 40.0):
        far = [(-116.2 + degrees, 43.61), (-116.2 + degrees, 43.62)]
        farther = [(-116.2 + 1.3 * degrees, 43.61), (-116.2 + 1.3 * degrees, 43.62)]
        got = matched(spark, [SEGMENT], [farther, far])[1]
        assert (got["match"], got["line_id"], got["aadt"], got["route"]) == ("nearest", 11, None, "R11")
        assert got["distance"] == pytest.approx(degrees * 111_320 * math.cos(math.radians(43.62)), rel=0.05 if degrees > 5 else 0.002)
    assert matched(spark, [SEGMENT], [[(0.0, 0.0)], None])[1]["match"] == "missing"


def test_ties_go_to_the_smaller_id(spark):
    twin = [(-116.1999, 43.605), (-116.1999, 43.625)]
    assert matched(spark, [SEGMENT], [twin, twin])[1]["line_id"] == 10


def test_zones_are_the_segments_own(spark):
    """Segments in zones far apart each match the line that lies eight metres beside them."""
    places = [(-121.0, 47.0), (-116.2, 43.6), (-80.3, 26.0), (13.4, 52.5), (151.2, -33.9)]
    segments = [[(x, y), (x, y + 0.01)] for x, y in places]
    beside = [[(x + 8 / (111_320 * math.cos(math.radians(y))), y - 0.005), (x + 8 / (111_320 * math.cos(math.radians(y))), y + 0.02)] for x, y in places]
    got = matched(spark, segments, beside)
    assert [(got[k]["match"], got[k]["line_id"]) for k in range(1, 6)] == [("matched", k) for k in range(10, 15)]
    assert all(r["distance"] == pytest.approx(8, abs=0.06) for r in got.values())


def test_pieces_are_short_and_cover_the_line(spark):
    df = spark.createDataFrame([(1, polyline((-116.2, 43.6), (-116.1, 43.7), (-116.1, 43.7))), (2, polyline((0.0, 0.0)))], f"id long, line {LINE}")
    got = pieces(df, "id").orderBy("edge", "s").collect()
    assert len({r["edge"] for r in got}) == 2 and got[0]["w"] == -116.2 and max(r["e"] for r in got) == pytest.approx(-116.1)
    assert all((r["n"] - r["s"]) * 111_320 <= PIECE for r in got) and len(got) > 20


def test_projection(spark):
    """Known zone coordinates, and distances within a thousandth over two degrees of longitude."""
    x, y = projection.forward_number(-116.2023, 43.6150, -117.0)
    assert (x + 500_000, y) == (pytest.approx(564_367.095, abs=0.01), pytest.approx(4_829_422.282, abs=0.01))
    frame = spark.createDataFrame([(-117.0 + k / 10, 43.0 + k / 20) for k in range(-10, 11)], "lon double, lat double")
    rows = frame.select("lon", "lat", *(F.expr(t) for t in projection.forward("lon", "lat", projection.central_meridian("lon")))).collect()
    for lon, lat, a, b in rows:
        assert (a, b) == pytest.approx(projection.forward_number(lon, lat, math.floor(lon / 6) * 6 + 3), abs=1e-6)
    for lon in (-118.0, -117.0, -116.0):
        a, b = (projection.forward_number(lon, lat, -117.0) for lat in (43.6, 43.61))
        # A hundredth of a degree of the meridian at this latitude.
        assert math.dist(a, b) == pytest.approx(1111.07, rel=1e-3)


def test_nothing_is_broadcast_however_small_the_tables_look(spark):
    """Sizes are estimated before cells multiply the rows; the driver would hold them all."""
    point = lambda lat: f"named_struct('lon', -116.2D + id / 1000, 'lat', {lat}D)"
    s, n = (spark.range(3).selectExpr(f"id AS {key}", f"array({point(43.61)}, {point(43.62)}) AS line", "1.0D AS aadt", "'R' AS route") for key in ("segment_id", "line_id"))
    assert "Broadcast" not in nearest_line_join(s, n)._jdf.queryExecution().executedPlan().toString()


def test_equal_lines_are_measured_once_and_all_segments_told(spark):
    copies = [SEGMENT, SEGMENT, [(-116.2, 43.0), (-116.2, 43.01)], SEGMENT, [(-116.2, 43.0), (-116.2, 43.01)]]
    beside = [(-116.1999, 43.605), (-116.1999, 43.625)]
    got = matched(spark, copies, [[(-116.1998, 43.605), (-116.1998, 43.625)], beside, beside])
    assert [(got[k]["match"], got[k]["line_id"]) for k in range(1, 6)] == [("matched", 11), ("matched", 11), ("nearest", 11), ("matched", 11), ("nearest", 11)]
    # Segments that share an id each have the result of their own line.
    s = spark.createDataFrame([(1, polyline(*p)) for p in (SEGMENT, copies[2])] + [(2, polyline(*SEGMENT)), (None, polyline(*SEGMENT))], f"segment_id long, line {LINE}")
    n = spark.createDataFrame([(10, polyline(*beside), 1.0, "R")], f"line_id long, line {LINE}, aadt double, route string")
    rows = [(r["segment_id"], r["match"]) for r in nearest_line_join(s, n).collect()]
    assert sorted(rows, key=str) == sorted([(1, "matched"), (1, "nearest"), (2, "matched"), (None, "missing")], key=str)


def test_nearest_equals_brute_force(spark):
    """Segments in, beside and far from a cloud of lines."""
    draw = random.Random(7)
    some = lambda lon, lat, spread: [(lon + draw.uniform(-spread, spread), lat + draw.uniform(-spread, spread))]
    lines = [p + [(p[0][0] + draw.uniform(-0.02, 0.02), p[0][1] + draw.uniform(-0.02, 0.02))] for p in (some(-116.2, 43.6, 0.2) for _ in range(150))]
    segments = [p + [(p[0][0] + 0.003, p[0][1] - 0.002)] for spread in (0.1, 0.4, 1.5) for p in (some(-116.2, 43.6, spread) for _ in range(12))]
    got = matched(spark, segments, lines, max_metres=1.0)

    def apart(p, q):
        def foot(c, a, b):
            t = max(0.0, min(1.0, ((c[0] - a[0]) * (b[0] - a[0]) + (c[1] - a[1]) * (b[1] - a[1])) / math.dist(a, b) ** 2))
            return math.dist(c, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))

        side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        if side(*p, q[0]) * side(*p, q[1]) < 0 and side(*q, p[0]) * side(*q, p[1]) < 0:
            return 0.0
        return min(foot(p[0], *q), foot(p[1], *q), foot(q[0], *p), foot(q[1], *p))

    for k, p in enumerate(segments, 1):
        lon0 = math.floor(p[0][0] / 6) * 6 + 3
        plane = lambda line: [projection.forward_number(*c, lon0) for c in line]  # noqa: E731,B023
        best = min((apart(plane(p), plane(q)), n) for n, q in enumerate(lines, 10))
        assert (got[k]["distance"], got[k]["line_id"]) == (pytest.approx(best[0], abs=1e-5), best[1])
