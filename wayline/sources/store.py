"""Persistent areas: merged observations, metadata and geometry in partitioned Parquet, with two small registries.

    <root>/obs/area_key=.../bin_minutes=.../   observations, keep-first on (segment_id, ts_utc)
    <root>/meta/area_key=.../version=.../      one row a segment; the newest whole version counts
    <root>/geo/area_key=.../version=.../       one row a segment, likewise
    <root>/segs/area_key=.../                  the distinct segments, by which an area's are counted
    <root>/areas/<version>, <root>/ingests/    registries; the newest whole version of areas counts
    <root>/pending/<area_key>                  an ingest that has begun and not been registered

Merging is an anti-join against the partition that it adds to, then an append: re-ingesting adds no row.
Duplicates inside a batch keep their first row by file order, and a batch whose bin can't be told is
rejected. One writer at a time.

Whatever is replaced is written beside and then counts by being whole: a writer that is killed leaves a
readable store. An area's span, rows and segments are kept from ingest to ingest, from what the rows
tell while they are written; only after a killed ingest, which its pending mark tells, is the area read
once to count anew. An area is taken from the registry before its files go; files that no registered
area has are cleared before their key is used again.
"""

from __future__ import annotations

import json
import time
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.blocks import in_blocks
from ..schema import Provenance, Study
from .files import delete, exists, listing, touch

SCHEMA_VERSION = 2
#: What is replaced by a new version.
LAYERS = ("meta", "geo")
AREAS = "area_key string, area_name string, corridors string, units string, first_ts timestamp_ntz, last_ts timestamp_ntz, n_segments long, n_rows long, created_at long, updated_at long, schema_version int"
INGESTS = "area_key string, source string, bin_minutes int, n_read long, n_added long, at long"


def area_identity(df: DataFrame) -> DataFrame:
    """One row, area_name, area_key and corridors (JSON): an md5 of the sorted distinct corridors, or of the segments in numeric order where there are none."""
    if "corridor" not in df.columns:
        df = df.withColumn("corridor", F.lit(None).cast("string"))
    # Distinct pairs first: what is collected into one row is names, never observations.
    pairs = df.select(F.col("corridor").cast("string").alias("corridor"), F.when(F.col("corridor").isNull(), F.col("segment_id").cast("long")).alias("segment_id")).distinct()
    sets = pairs.agg(F.array_sort(F.collect_set("corridor")).alias("c"), F.array_sort(F.collect_set("segment_id")).alias("s"))
    named, joined = F.size("c") > 0, lambda c, by: F.array_join(F.transform(c, lambda x: x.cast("string")), by)
    identity = F.when(named, F.concat(F.lit("corridors:"), joined("c", "|"))).otherwise(F.concat(F.lit("segments:"), joined("s", ",")))
    name = F.when(named, joined("c", ", ")).otherwise(F.concat(F.lit("segments("), F.size("s").cast("string"), F.lit(")")))
    return sets.select(name.alias("area_name"), F.substring(F.md5(identity), 1, 12).alias("area_key"), F.to_json("c").alias("corridors"))


def area_span(df: DataFrame, by=()) -> DataFrame:
    """first_ts, last_ts, n_segments and n_rows (by ``by``) of observations, from one row a segment."""
    segments = df.groupBy(*by, "segment_id").agg(F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"), F.count("*").alias("n_rows"))
    return segments.groupBy(*by).agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.count("segment_id").alias("n_segments"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))


def detect_bin(df: DataFrame, by=(), block_rows: int | None = None) -> DataFrame:
    """bin_minutes (by ``by``): the commonest positive step between consecutive rows of a segment, the smaller of equally common ones, in minutes.

    Steps are counted before the mode is taken. With ``block_rows`` a segment's rows are gone through in
    blocks, so that one that holds most of all rows runs in many tasks.
    """
    group, micros = [*by, "segment_id"], F.unix_micros(F.col("ts_utc").cast("timestamp"))
    if block_rows is None:
        rows, w = df.select(*group, "ts_utc"), Window.partitionBy(*group).orderBy("ts_utc")
        steps = rows.select(*by, (micros - F.lag(micros).over(w)).alias("step"))
    else:
        rows, _ = in_blocks(df.select(*group, "ts_utc"), group, ["ts_utc"], -1, 0, block_rows)
        steps = rows.withColumn("step", micros - F.lag(micros).over(Window.partitionBy(*group, "_block").orderBy("_place"))).where("_own").select(*by, "step")
    steps = steps.where("step > 0").groupBy(*by, "step").agg(F.count("*").alias("n"))
    return steps.groupBy(*by).agg(F.bround(F.min_by("step", F.struct(-F.col("n"), F.col("step"))) / 60_000_000).cast("int").alias("bin_minutes"))


def keep_first(existing: DataFrame | None, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows of ``batch`` that are new: none with a missing key, one a key (the first by ``order``), none that ``existing`` has."""
    batch = batch.dropna(subset=keys)
    if order:
        batch = batch.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_first = 1").drop("_first")
    else:
        batch = batch.dropDuplicates(keys)
    return batch if existing is None else batch.join(existing.select(*keys), keys, "left_anti")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, kind: str, key: str) -> DataFrame | None:
        path = f"{self.root}/{kind}/area_key={key}"
        if kind in LAYERS:
            whole = sorted(v for v in listing(self.spark, f"{path}/version=*") if exists(self.spark, f"{v}/_SUCCESS"))
            return self.spark.read.parquet(whole[-1]) if whole else None
        return self.spark.read.option("mergeSchema", True).option("basePath", f"{self.root}/{kind}").parquet(path) if exists(self.spark, path) else None

    def _replace(self, kind: str, key: str, frame: DataFrame) -> None:
        """A new version beside the old ones, of which the last but one goes."""
        path = f"{self.root}/{kind}/area_key={key}"
        old = sorted(listing(self.spark, f"{path}/version=*"))
        frame.write.parquet(f"{path}/version={time.time_ns():020d}")
        for version in old[:-1]:
            delete(self.spark, version)

    def areas(self) -> DataFrame:
        """The registry, latest first."""
        versions = sorted(p for p in listing(self.spark, f"{self.root}/areas/*") if exists(self.spark, f"{p}/_SUCCESS"))
        df = self.spark.read.schema(AREAS).parquet(versions[-1]) if versions else self.spark.createDataFrame([], AREAS)
        return df.orderBy(F.desc("updated_at"), "area_name")

    def area_names(self) -> list[str]:
        return [r[0] for r in self.areas().select("area_name").collect()]

    def ingests(self) -> DataFrame:
        path = f"{self.root}/ingests"
        return self.spark.read.schema(INGESTS).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], INGESTS)

    def area_bins(self, key: str) -> list[int]:
        """The bins that an area has, by its folders."""
        return sorted(int(p.rsplit("=", 1)[-1]) for p in listing(self.spark, f"{self.root}/obs/area_key={key}/bin_minutes=*"))

    def _resolve_bin(self, key: str, minutes: int | None) -> int:
        bins = self.area_bins(key)
        if minutes is None and len(bins) == 1:
            return bins[0]
        if minutes not in bins:
            raise ValueError(f"choose one of the bins {bins}")
        return minutes

    def ingest(self, study: Study, name: str | None = None, source: str = "", bin_minutes: int | None = None) -> tuple[str, int]:
        """Merges a study; gives the area's key and the number of rows added."""
        obs = study.observations
        identity = area_identity(obs).first()
        key = identity["area_key"]
        if bin_minutes is None:
            found = detect_bin(obs).first()
            bin_minutes = found["bin_minutes"] if found else None
        if bin_minutes is None:
            raise ValueError("the bin length can't be told from fewer than two rows of a segment")
        registered = [r for r in self.areas().collect() if r["area_key"] == key]
        pending = f"{self.root}/pending/{key}"
        recount = bool(registered) and exists(self.spark, pending)
        if not registered and not exists(self.spark, pending):
            self._clear(key)
        touch(self.spark, pending)
        recount = recount or not registered
        stored = self._read("obs", key)
        same = None if stored is None else stored.where(F.col("bin_minutes") == bin_minutes)
        order = None
        if "_path" in obs.columns:
            # Numbers in paths count as numbers: part_2 comes before part_10.
            numbers = F.transform(F.regexp_extract_all("_path", F.lit(r"(\d+)"), F.lit(1)), lambda d: F.lpad(d, 20, "0"))
            order = [numbers, F.col("_path"), *([F.col("_line")] if "_line" in obs.columns else [])]
        # Both numbers are counted while the rows are written.
        read, added = Observation(), Observation()
        counted = [F.count(F.lit(1)).alias("n"), F.min("ts_utc").cast("string").alias("first"), F.max("ts_utc").cast("string").alias("last")]
        new = keep_first(same, obs.observe(read, F.count(F.lit(1)).alias("n")), ["segment_id", "ts_utc"], order).drop("_path", "_line").observe(added, *counted)
        new.withColumn("area_key", F.lit(key)).withColumn("bin_minutes", F.lit(bin_minutes)).write.mode("append").partitionBy("area_key", "bin_minutes").parquet(f"{self.root}/obs")
        for kind, frame in (("meta", study.metadata), ("geo", study.geometry)):
            if frame is not None:
                self._merge_dimension(kind, key, frame)
        found = Observation()
        segments = keep_first(self._read("segs", key), obs.select("segment_id"), ["segment_id"]).observe(found, F.count(F.lit(1)).alias("n"))
        segments.withColumn("area_key", F.lit(key)).write.mode("append").partitionBy("area_key").parquet(f"{self.root}/segs")
        if recount:
            row = area_span(self._read("obs", key)).first()
            span, number = (row["first_ts"], row["last_ts"], row["n_rows"]), row["n_segments"]
        else:
            old, ends = registered[0], [datetime.fromisoformat(x) for x in (added.get["first"], added.get["last"]) if x]
            span = min([old["first_ts"], *ends[:1]]), max([old["last_ts"], *ends[1:]]), old["n_rows"] + added.get["n"]
            number = old["n_segments"] + found.get["n"]
        self._register(key, name or identity["area_name"], identity["corridors"], study.provenance, span, number)
        self.spark.createDataFrame([(key, source, bin_minutes, read.get["n"], added.get["n"], time.time_ns())], INGESTS).coalesce(1).write.mode("append").parquet(f"{self.root}/ingests")
        delete(self.spark, pending)
        return key, added.get["n"]

    def _merge_dimension(self, kind: str, key: str, frame: DataFrame) -> None:
        """Adds rows of segments that have none yet, in a new version; nothing is written where there are none."""
        old = self._read(kind, key)
        new = keep_first(old, frame, ["segment_id"])
        if old is None or not new.isEmpty():
            self._replace(kind, key, new if old is None else old.unionByName(new, allowMissingColumns=True))

    def _register(self, key: str, name: str, corridors: str, provenance: Provenance, span: tuple, segments: int) -> None:
        old = [r for r in self.areas().collect() if r["area_key"] == key]
        now = time.time_ns()
        row = (key, name, corridors, json.dumps(provenance.units, sort_keys=True), span[0], span[1], segments, span[2], old[0]["created_at"] if old else now, now, SCHEMA_VERSION)
        self._write_areas(self.areas().where(F.col("area_key") != key).union(self.spark.createDataFrame([row], AREAS)))

    def _write_areas(self, df: DataFrame) -> None:
        """A new version beside the old ones; readers take the newest that is whole."""
        df.coalesce(1).write.parquet(f"{self.root}/areas/{time.time_ns():020d}")

    def ingest_geometry(self, key: str, geometry: DataFrame) -> None:
        """Adds lines of segments that have none yet."""
        self._merge_dimension("geo", key, geometry)

    def ingest_volumes(self, key: str, volumes: DataFrame) -> None:
        """Sets aadt, match and route of the stored lines, which stay as they are, in a new version."""
        fields = [c for c in ("aadt", "match", "route", "commercial", "line_id", "distance") if c in volumes.columns]
        self._replace("geo", key, self._read("geo", key).drop(*fields).join(volumes.select("segment_id", *fields), "segment_id", "left"))

    def load(self, key: str, bin_minutes: int | None = None) -> Study:
        """Observations of one bin (its partition alone is read), metadata and geometry."""
        minutes = self._resolve_bin(key, bin_minutes)
        obs = self._read("obs", key).where(F.col("bin_minutes") == minutes).drop("area_key", "bin_minutes")
        drop = lambda df: None if df is None else df.drop("area_key")
        row = self.areas().where(F.col("area_key") == key).first()
        if row is None:
            raise ValueError(f"no area {key!r}")
        if row and row["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"the area was written by a later version of the store: {row['schema_version']}")
        units = json.loads(row["units"]) if row and (row["units"] or "").startswith("{") else {}
        study = Study(obs, drop(self._read("meta", key)), drop(self._read("geo", key)), Provenance(units))
        return replace(study, provenance=study.provenance.noted(bin_minutes=minutes))

    def remove(self, key: str) -> None:
        """Takes an area from the registry, which ends it, and then its files."""
        self._write_areas(self.areas().where(F.col("area_key") != key))
        self._clear(key)

    def _clear(self, key: str) -> None:
        for kind in ("obs", "segs", *LAYERS):
            delete(self.spark, f"{self.root}/{kind}/area_key={key}")
