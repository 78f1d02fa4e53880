"""Readers of exported observations and segment metadata: CSV files, directories, and zip archives, alone or in parts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import collapse
from ..functions.wkb import from_wkb
from ..schema import Provenance, Study, number, pin_utc
from .archives import read_parts
from .files import discover_parts, members_below

#: Raw headers, or their beginnings before a unit in parentheses, and the canonical columns.
HEADERS = {
    "Date Time": "ts", "Segment ID": "segment_id", "UTC Date Time": "ts_utc_check", "Speed": "speed", "Hist Av Speed": "hist_speed",
    "Ref Speed": "ref_speed", "Travel Time": "travel_time", "CValue": "cvalue", "Pct Score30": "pct30", "Pct Score20": "pct20",
    "Pct Score10": "pct10", "Road Closure": "road_closure", "Corridor/Region Name": "corridor",
}
METADATA = {
    "Segment ID": "segment_id", "Road": "road", "Direction": "direction", "Intersection": "intersection", "Start Latitude": "start_lat",
    "Start Longitude": "start_lon", "End Latitude": "end_lat", "End Longitude": "end_lon", "State/Region": "region", "District": "district",
    "Postal Code": "postal_code", "Segment Length(Miles)": "miles",
}
NUMBERS = ("speed", "hist_speed", "ref_speed", "travel_time", "cvalue", "pct30", "pct20", "pct10")


def canonical(header: str) -> str:
    """The canonical name of a raw header; unknown ones stay as they are, in lower case with underscores."""
    bare = re.sub(r"\([^)]*\)\s*$", "", header).strip()
    return HEADERS.get(header.strip()) or HEADERS.get(bare) or re.sub(r"\W+", "_", header.strip().lower())


def detect_units(headers: list[str]) -> dict[str, str]:
    """Units that the headers of speed and travel time carry."""
    out = {}
    for h in headers:
        if found := re.match(r"(Speed|Travel Time)\(([^)]*)\)", h.strip()):
            out[canonical(h)] = found[2]
    return out


def read_member(spark: SparkSession, source: str | list[str], member: str, nrows: int | None = None) -> tuple[DataFrame, list[str]]:
    """Text columns under raw headers plus _path and _line, and the headers: the union of all parts', by name. ``nrows`` caps each part.

    Parts of zipped exports are partitions of a data source. Plain CSV files and directories use Spark's
    own reader and split, those of each distinct header by themselves; for a preview they are parts too.
    """
    parts = discover_parts(spark, source)
    if all(p.lower().endswith(".zip") for p in parts):
        return read_parts(spark, parts, member, nrows)
    files = [f for p in parts for f in ([p] if p.lower().endswith(".csv") else members_below(spark, p, member))]
    if not files:
        raise ValueError(f"{source} holds no {member}")
    if nrows is not None:
        return read_parts(spark, files, member, nrows)
    reader = spark.read.option("header", True)
    groups: dict[tuple, list[str]] = {}
    for file in files:
        groups.setdefault(tuple(reader.csv(file).columns), []).append(file)
    frames = [reader.csv(own).select("*", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_line")) for own in groups.values()]
    headers = list(dict.fromkeys(h for own in groups for h in own))
    raw = frames[0]
    for other in frames[1:]:
        raw = raw.unionByName(other, allowMissingColumns=True)
    return raw.select(*(F.col(f"`{h}`") for h in headers), "_path", "_line"), headers


def load_observations(spark: SparkSession, source: str | list[str], nrows: int | None = None) -> Study:
    """Typed observations: instants in UTC, bad numbers as NULL, closures as booleans, units noted.

    ``nrows`` caps each part, for previews.
    """
    pin_utc(spark)
    raw, headers = read_member(spark, source, "data.csv", nrows)
    named = raw.select(*(F.col(f"`{h}`").alias(canonical(h)) for h in headers), "_path", "_line")
    have = set(named.columns)
    columns = {"ts_utc": F.expr("try_cast(ts AS timestamp)").cast("timestamp_ntz"), "segment_id": F.expr("try_cast(segment_id AS bigint)")}
    columns |= {n: number(n) for n in NUMBERS if n in have}
    columns["road_closure"] = F.coalesce(F.upper(F.trim("road_closure")) == "T", F.lit(False)) if "road_closure" in have else F.lit(False)
    typed = named.withColumns(columns).drop("ts", "ts_utc_check")
    return Study(typed, provenance=Provenance(units=detect_units(headers)))


def load_metadata(spark: SparkSession, source: str) -> DataFrame:
    """One typed row a segment, with ``combined``: road, direction and intersection in one line."""
    raw, headers = read_member(spark, source, "metadata.csv")
    df = raw.select(*(F.col(f"`{h}`").alias(METADATA.get(h.strip(), re.sub(r"\W+", "_", h.strip().lower()))) for h in headers))
    have = set(df.columns)
    df = df.withColumn("segment_id", F.expr("try_cast(segment_id AS bigint)"))
    df = df.withColumns({n: number(n) for n in ("start_lat", "start_lon", "end_lat", "end_lon", "miles") if n in have})
    parts = [F.nullif(F.trim(n), F.lit("")) for n in ("road", "direction", "intersection") if n in have]
    return df.withColumn("combined", collapse(F.concat_ws(" ", *parts)))


def load_names(spark: SparkSession, path: str) -> DataFrame:
    """segment_id, seed_label and name of a names CSV; 'NA' and 'None' are names like any other."""
    raw = spark.read.option("header", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    have = {c.strip(): c for c in raw.columns}
    if "Segment ID" not in have or "name" not in have:
        raise ValueError("a names file has the columns 'Segment ID' and 'name'")
    label = next((c for k, c in have.items() if k.endswith("_label")), None)
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    return raw.select(F.expr(f"try_cast(`{have['Segment ID']}` AS bigint)").alias("segment_id"), (text(label) if label else F.lit("")).alias("seed_label"), text(have["name"]).alias("name"))


def names_rows(df: DataFrame) -> DataFrame:
    """The rows of a names file, in its column order and sorted by segment."""
    return df.select(F.col("segment_id").alias("Segment ID"), "seed_label", "name").orderBy("Segment ID")


def load_network(spark: SparkSession, path: str, segment_ids=None, bbox=None) -> DataFrame:
    """Network lines (segment_id, previous_id, next_id, miles, line ...) of a Parquet layer; ids and bbox (w, s, e, n) restrict what is read."""
    df = _with_line(spark.read.parquet(path))
    ids = [c for c in ("segment_id", "previous_id", "next_id", "frc", "group_id") if c in df.columns]
    df = df.withColumns({c: F.expr(f"try_cast({c} AS bigint)") for c in ids} | ({"miles": number("miles")} if "miles" in df.columns else {}))
    if segment_ids is not None:
        df = df.where(F.col("segment_id").isin([int(i) for i in segment_ids]))
    return within_box(df, bbox)


def load_volumes(spark: SparkSession, path: str, year: int = 2024, bbox=None) -> DataFrame:
    """Volume lines (line_id, year, route, aadt, line) of one year of a Parquet layer."""
    df = _with_line(spark.read.parquet(path).where(F.col("year") == year))
    return within_box(df.withColumn("aadt", number("aadt")), bbox)


def _with_line(df: DataFrame) -> DataFrame:
    """A layer whose lines are well-known binary in ``geometry`` has them as points; one that has points is left as it is."""
    kinds = dict(df.dtypes)
    if "line" in kinds or kinds.get("geometry") != "binary":
        return df
    return df.withColumn("line", from_wkb(F.col("geometry"))).drop("geometry")


def within_box(df: DataFrame, bbox) -> DataFrame:
    """Lines whose own box meets (w, s, e, n)."""
    if bbox is None:
        return df
    w, s, e, n = bbox
    lon, lat = F.transform("line", lambda p: p["lon"]), F.transform("line", lambda p: p["lat"])
    return df.where((F.array_max(lon) >= w) & (F.array_min(lon) <= e) & (F.array_max(lat) >= s) & (F.array_min(lat) <= n))
