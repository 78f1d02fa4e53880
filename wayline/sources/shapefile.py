"""Polyline shapefiles, zipped or plain, as a partitioned data source, and the transverse Mercator projection that some layers use.

A layer's index (.shx) tells where its records begin: ranges of them are partitions, each of which seeks to
its own (in a zip archive: skips to it). Of a record first the attributes that are filtered by are looked
at, then the box in its header, which is compared in the layer's own system; points are decoded of what is
left alone, and attributes only as far as they are asked for.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.projection import GRS80, forward_number
from ..schema import number
from .archives import open_file, opens
from .exports import within_box
from .files import listing

#: Attribute names of network and volume layers, which the format cuts to ten characters, and canonical columns.
NETWORK = {"XDSegID": "segment_id", "PreviousXD": "previous_id", "NextXDSegI": "next_id", "FRC": "frc", "XDGroup": "group_id", "Miles": "miles"}
VOLUMES = {"Year": "year", "RouteID": "route_id", "Route": "route", "AADT": "aadt", "Commercial": "commercial", "FromMeasur": "from_measure", "ToMeasure": "to_measure"}
#: A state-wide transverse Mercator zone (latitude and longitude of origin, scale, false easting and northing).
STATE_ZONE = (42.0, -114.0, 0.9996, 2_500_000.0, 1_200_000.0)


def inverse_mercator(x: Column, y: Column, zone=STATE_ZONE, ellipsoid=GRS80) -> tuple[Column, Column]:
    """lon and lat of projected metres, by the usual series about the footpoint latitude; millimetres off within a zone."""
    (lat0, lon0, k0, east, north), (a, f) = zone, ellipsoid
    e2 = f * (2 - f)
    ep2, e1 = e2 / (1 - e2), (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))

    def arc(p: float) -> float:
        return a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))

    mu = (F.lit(arc(math.radians(lat0))) + (y - north) / k0) / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
    c, t = ep2 * F.cos(foot) ** 2, F.tan(foot) ** 2
    q = 1 - e2 * F.sin(foot) ** 2
    n, r = a / F.sqrt(q), a * (1 - e2) / F.pow(q, F.lit(1.5))
    d = (x - east) / (n * k0)
    lat = foot - n * F.tan(foot) / r * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep2 - 3 * c**2) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep2 + 24 * t**2) * d**5 / 120) / F.cos(foot)
    return F.degrees(lon) + lon0, F.degrees(lat)


def projected_box(bbox, zone=None, ellipsoid=GRS80) -> tuple[float, float, float, float]:
    """The envelope, in a layer's metres, of a box (w, s, e, n) of degrees: of points all along its sides, since they bend. Degrees without a zone."""
    if zone is None:
        return tuple(float(x) for x in bbox)
    lat0, lon0, k0, east, north = zone
    base = forward_number(lon0, lat0, lon0, k0, ellipsoid)[1]
    w, s, e, n = bbox
    steps = [k / 16 for k in range(17)]
    around = [p for t in steps for p in ((w + t * (e - w), s), (w + t * (e - w), n), (w, s + t * (n - s)), (e, s + t * (n - s)))]
    xs, ys = zip(*(forward_number(lon, lat, lon0, k0, ellipsoid) for lon, lat in around))
    # A sixteenth of a side bends by far less than a hundredth of it.
    slack = 0.01 * max(max(xs) - min(xs), max(ys) - min(ys))
    return east + min(xs) - slack, north + min(ys) - base - slack, east + max(xs) + slack, north + max(ys) - base + slack


class Table:
    """A dBase table's fields, and its rows as stripped text."""

    def __init__(self, file):
        self.file = file
        first = file.read(32)
        self.count, self.head, self.size = int.from_bytes(first[4:8], "little"), int.from_bytes(first[8:10], "little"), int.from_bytes(first[10:12], "little")
        self.fields: dict[str, tuple[int, int]] = {}
        at = 1
        for k in range(0, len(fields := file.read(self.head - 32)), 32):
            if fields[k] == 0x0D:
                break
            self.fields[fields[k : k + 11].split(b"\0")[0].decode("ascii", "replace")] = at, fields[k + 16]
            at += fields[k + 16]

    def rows(self, start: int, stop: int) -> Iterator[bytes]:
        self.file.seek(self.head + start * self.size)
        for _ in range(start, min(stop, self.count)):
            yield self.file.read(self.size)

    def value(self, row: bytes, name: str) -> str:
        at, width = self.fields[name]
        return row[at : at + width].decode("utf-8", "replace").strip()


def index_of(file) -> list[int]:
    """The byte at which each record begins, of an .shx file."""
    content = file.read()[100:]
    return [2 * int.from_bytes(content[k : k + 4], "big") for k in range(0, len(content) - 7, 8)]


def records(shapes, table: Table, start: int, stop: int, at: int, names: list[str], equal: dict[str, list[str]], box) -> Iterator[tuple[list[str], list | None]]:
    """Attributes and points of the records from ``start`` to ``stop``, the first at byte ``at``, whose attributes are among ``equal`` and whose boxes meet ``box``.

    Null and other shapes have no points; they are left out where there is a box.
    """
    shapes.seek(at)
    for row in table.rows(start, stop):
        head = shapes.read(8)
        if len(head) < 8:
            return
        body = shapes.read(2 * int.from_bytes(head[4:8], "big"))
        if any(table.value(row, n) not in wanted for n, wanted in equal.items()):
            continue
        line = None
        if int.from_bytes(body[:4], "little") in (3, 13, 23):
            w, s, e, n = struct.unpack("<4d", body[4:36])
            if box is not None and not (e >= box[0] and w <= box[2] and n >= box[1] and s <= box[3]):
                continue
            parts, points = struct.unpack("<ii", body[36:44])
            line = np.frombuffer(body, dtype="<f8", count=2 * points, offset=44 + 4 * parts).reshape(-1, 2)
        elif box is not None:
            continue
        yield [table.value(row, n) for n in names], line


def batches(found: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Records as Arrow batches: text attributes and line."""
    while rows := list(islice(found, 4096)):
        sizes = [0 if line is None else len(line) for _, line in rows]
        points = np.concatenate([line for _, line in rows if line is not None] or [np.empty((0, 2))])
        pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, k])) for k in (0, 1)], ["lon", "lat"])
        ends = pa.array([None if line is None else end for (_, line), end in zip(rows, np.cumsum([0, *sizes])[:-1].tolist())] + [sum(sizes)], type=pa.int32())
        yield pa.RecordBatch.from_arrays([*(pa.array([v[k] for v, _ in rows], type=pa.string()) for k in range(len(names))), pa.ListArray.from_arrays(ends, pairs)], names=[*names, "line"])


#: Records of a partition.
RANGE = 20_000
LAYER = "wayline_layer"


class _Files:
    """The files of a layer: members of an archive, or what stands beside an .shp."""

    def __init__(self, path: str, whole: dict[str, bytes] | None = None):
        self.path, self.whole = path, whole

    def open(self, kind: str):
        """A seekable file of '.shp', '.dbf' or '.shx'; None if there is none."""
        import io
        import zipfile

        if not self.path.lower().endswith(".zip"):
            if self.whole is not None:
                return io.BytesIO(self.whole[kind]) if kind in self.whole else None
            found = next((p for p in (self.path[:-4] + kind, self.path[:-4] + kind.upper()) if opens(p)), None)
            return None if found is None else open_file(found)
        archive = zipfile.ZipFile(open_file(self.path) if self.whole is None else io.BytesIO(self.whole[".zip"]))
        names = {n.lower(): n for n in archive.namelist()}
        stem = next((n[:-4] for n in names if n.endswith(".shp")), None)
        if stem is None:
            raise ValueError(f"{self.path} holds no .shp")
        return archive.open(names[stem + kind]) if stem + kind in names else None


class Layer(DataSource):
    """Options: path, names, equal, box (JSON) and range."""

    @classmethod
    def name(cls) -> str:
        return LAYER

    def schema(self) -> str:
        return ", ".join([*(f"`{n}` string" for n in json.loads(self.options["names"])), "line array<struct<lon:double,lat:double>>"])

    def reader(self, schema) -> "LayerReader":
        return LayerReader(dict(self.options))


class LayerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.names, self.equal, self.box = options["path"], json.loads(options["names"]), json.loads(options["equal"]), json.loads(options["box"])
        self.range = int(options["range"])

    def partitions(self) -> list[InputPartition]:
        index = _Files(self.path).open(".shx")
        starts = index_of(index) if index is not None else []
        if index is None:
            return [InputPartition((0, 2**31, 100))]
        return [InputPartition((k, k + self.range, starts[k])) for k in range(0, len(starts), self.range)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files = _Files(self.path)
        table = Table(files.open(".dbf"))
        yield from batches(records(files.open(".shp"), table, *partition.value, self.names, self.equal, self.box), self.names)


def load_layer(spark: SparkSession, source: str, names: list[str] | None = None, equal: dict[str, list[str]] | None = None, box=None, per_partition: int = RANGE) -> DataFrame:
    """Text attributes under the layer's ``names`` (those that it has; all by default), and line, of a .zip, a .shp, or a folder with one.

    ``equal``: attributes and the texts that they may have; ``box``: in the layer's own units. Files that
    Python's file systems can't open are read whole by Spark, in one task.
    """
    path = source if source.lower().endswith((".zip", ".shp")) else listing(spark, f"{source.rstrip('/')}/*.shp")[0]
    if opens(path):
        have = list(Table(_Files(path).open(".dbf")).fields)
        names = have if names is None else [n for n in names if n in have]
        spark.dataSource.register(Layer)
        options = {"path": path, "names": json.dumps(names), "equal": json.dumps({n: v for n, v in (equal or {}).items() if n in have}), "box": json.dumps(box), "range": str(per_partition)}
        return spark.read.format(LAYER).options(**options).load()
    paths = [path] if path.lower().endswith(".zip") else [f"{path[:-4]}{kind}" for kind in (".shp", ".dbf")]
    files = spark.read.format("binaryFile").load(paths).select("path", "content").coalesce(1)

    def whole(rows: Iterator[pa.RecordBatch]) -> _Files:
        return _Files(path, {p[-4:].lower(): c.as_py() for batch in rows for p, c in zip(batch.column(0).to_pylist(), batch.column(1))})

    def fields(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(Table(whole(rows).open(".dbf")).fields))], names=["name"])

    have = [r[0] for r in files.mapInArrow(fields, "name string").collect()]
    names = have if names is None else [n for n in names if n in have]
    equal = {n: v for n, v in (equal or {}).items() if n in have}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layer = whole(rows)
        yield from batches(records(layer.open(".shp"), Table(layer.open(".dbf")), 0, 2**31, 100, names, equal, box), names)

    return files.mapInArrow(run, ", ".join([*(f"`{n}` string" for n in names), "line array<struct<lon:double,lat:double>>"]))


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(f"`{raw}`").alias(new) for raw, new in names.items() if raw in df.columns), "line")


def network_layer(spark: SparkSession, source: str, segment_ids=None, bbox=None) -> DataFrame:
    """Typed network lines; what is no number becomes NULL. ``segment_ids`` and ``bbox`` (w, s, e, n) restrict what is decoded."""
    ids = None if segment_ids is None else sorted({int(i) for i in segment_ids})
    df = _renamed(load_layer(spark, source, list(NETWORK), None if ids is None else {"XDSegID": [str(i) for i in ids]}, None if bbox is None else projected_box(bbox)), NETWORK)
    whole = [c for c in df.columns if c not in ("miles", "line")]
    df = df.withColumns({c: F.expr(f"try_cast({c} AS bigint)") for c in whole} | ({"miles": number("miles")} if "miles" in df.columns else {}))
    return within_box(df, bbox)


def volume_layer(spark: SparkSession, source: str, year: int = 2024, bbox=None, zone=STATE_ZONE) -> DataFrame:
    """Volume lines of one year with line_id, in degrees; ``zone`` is None for layers that are in degrees already. The box, moved to the zone, restricts what is decoded."""
    df = _renamed(load_layer(spark, source, list(VOLUMES), {"Year": [str(year), f"{year}.0"]}, None if bbox is None else projected_box(bbox, zone)), VOLUMES)
    df = df.withColumns({c: number(c) for c in df.columns if c in ("aadt", "commercial", "from_measure", "to_measure")}).withColumn("year", F.expr("try_cast(try_cast(year AS double) AS int)")).where(F.col("year") == year)
    if zone is not None:
        df = df.withColumn("line", F.transform("line", lambda p: F.struct(*(c.alias(n) for n, c in zip(("lon", "lat"), inverse_mercator(p["lon"], p["lat"], zone))))))
    return within_box(df.withColumn("line_id", F.xxhash64(*[c for c in df.columns if c != "line"], F.to_json("line"))), bbox)
