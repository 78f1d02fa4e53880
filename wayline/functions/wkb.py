"""Lines as well-known binary, both ways, in Arrow batches: what GeoParquet and spatial databases store."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Geometry types, and the flags of extended forms (Z, M, a reference system's number).
LINE, MULTI = 2, 5
_Z, _M, _SRID = 0x80000000, 0x40000000, 0x20000000
TYPE = "array<struct<lon:double,lat:double>>"


def encode(lines: pa.Array) -> pa.Array:
    """Little-endian LineStrings of lists of (lon, lat); null and empty lines are null."""
    sizes = np.asarray(lines.value_lengths().fill_null(0), dtype=np.int64)
    points = lines.flatten()
    pairs = np.stack([np.asarray(points.field(k), dtype="<f8") for k in ("lon", "lat")], axis=1) if len(points) else np.empty((0, 2))
    lengths = np.where(sizes > 0, 9 + 16 * sizes, 0)
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    some = np.flatnonzero(sizes)
    begin = (ends - lengths)[some]
    head = np.empty((len(some), 9), dtype=np.uint8)
    head[:, :5] = np.frombuffer(struct.pack("<BI", 1, LINE), dtype=np.uint8)
    head[:, 5:] = sizes[some].astype("<u4").view(np.uint8).reshape(-1, 4)
    inside = np.ones(len(out), dtype=bool)
    at = begin[:, None] + np.arange(9)
    out[at] = head
    inside[at] = False
    out[inside] = pairs.view(np.uint8).ravel()
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [_bits(sizes > 0), pa.py_buffer(offsets), pa.py_buffer(out)])


def _bits(valid: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.packbits(valid, bitorder="little"))


def _points(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The points of the geometry at a byte, and where it ends."""
    order = "<" if data[at] == 1 else ">"
    kind = struct.unpack_from(f"{order}I", data, at + 1)[0]
    at += 5 + (4 if kind & _SRID else 0)
    bare = kind & 0xFFFF
    width = 2 + bool(kind & _Z) + bool(kind & _M) + (0, 1, 1, 2)[bare // 1000]
    count = struct.unpack_from(f"{order}I", data, at)[0]
    at += 4
    if bare % 1000 == LINE:
        size = 8 * width * count
        return np.frombuffer(data, dtype=f"{order}f8", count=width * count, offset=at).reshape(count, width)[:, :2].astype("<f8"), at + size
    if bare % 1000 != MULTI:
        raise ValueError(f"not a line: geometry type {kind}")
    parts = []
    for _ in range(count):
        part, at = _points(data, at)
        parts.append(part)
    return np.concatenate(parts or [np.empty((0, 2))]), at


def decode(values: pa.Array) -> pa.Array:
    """Lists of (lon, lat) of LineStrings, and of MultiLineStrings, whose parts follow each other; of either byte order; further dimensions are left out."""
    found = [None if v is None else _points(v, 0)[0] for v in values.to_pylist()]
    points = np.concatenate([p for p in found if p is not None] or [np.empty((0, 2))])
    ends = np.cumsum([0, *(0 if p is None else len(p) for p in found)])
    pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, k])) for k in (0, 1)], ["lon", "lat"])
    return pa.ListArray.from_arrays(pa.array([None if p is None else e for p, e in zip(found, ends[:-1].tolist())] + [int(ends[-1])], type=pa.int32()), pairs)


def to_wkb(line: Column) -> Column:
    @F.arrow_udf("binary")
    def run(lines: pa.Array) -> pa.Array:
        return encode(lines)

    return run(line)


def from_wkb(value: Column) -> Column:
    @F.arrow_udf(TYPE)
    def run(values: pa.Array) -> pa.Array:
        return decode(values)

    return run(value)
