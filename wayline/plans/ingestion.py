"""An export with its lines, volumes, names and directions: ingested in one call, decorated and chosen from for display."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import geometry, shifts
from ..operators.nearest import nearest_line_join
from ..schema import Study
from ..sources import exports
from ..sources.store import Store
from .analysis import WHOLE, Session


def padded_box(lines: DataFrame, pad: float = 0.01) -> tuple[float, float, float, float] | None:
    """West, south, east and north of all lines, widened by ``pad`` degrees: one small aggregate. None without lines."""
    lon, lat = F.transform("line", lambda p: p["lon"]), F.transform("line", lambda p: p["lat"])
    row = lines.agg(*(f(g(c)).alias(f"{n}_{axis}") for axis, c in (("lon", lon), ("lat", lat)) for n, f, g in (("low", F.min, F.array_min), ("high", F.max, F.array_max)))).first()
    if row["low_lon"] is None:
        return None
    return row["low_lon"] - pad, row["low_lat"] - pad, row["high_lon"] + pad, row["high_lat"] + pad


def segment_layer(metadata: DataFrame, network: DataFrame, volumes: DataFrame | None = None, pad: float = 0.01) -> DataFrame:
    """The lines of the metadata's segments and, of the volume lines about them, those that match."""
    metadata = metadata.dropDuplicates(["segment_id"])
    lines = geometry.segment_geometry(metadata.select("segment_id"), network, metadata)
    box = padded_box(lines, pad) if volumes is not None else None
    if box is None:
        return lines
    matched = nearest_line_join(lines, exports.within_box(volumes, box))
    return lines.join(matched, "segment_id", "left")


def ingest_study(store: Store, source: str | list[str], network: DataFrame | None = None, volumes: DataFrame | None = None, name: str | None = None, bin_minutes: int | None = None) -> dict:
    """Merges an export into its area, with metadata, lines and volumes; the spatial join runs here and not on loading.

    Gives area_key, area_name, bin_minutes and n_rows_added. A layer that can't be read or joined raises.
    """
    metadata = exports.load_metadata(store.spark, source)
    study = replace(exports.load_observations(store.spark, source), metadata=metadata)
    if network is not None:
        study = replace(study, geometry=segment_layer(metadata, network, volumes))
    key, added = store.ingest(study, name, source=source if isinstance(source, str) else ",".join(source), bin_minutes=bin_minutes)
    area = store.areas().where(F.col("area_key") == key).first()
    logged = store.ingests().where(F.col("area_key") == key).agg(F.max_by("bin_minutes", "at")).first()
    return {"area_key": key, "area_name": area["area_name"], "bin_minutes": logged[0], "n_rows_added": added}


def decorated(study: Study, names: DataFrame | None = None) -> DataFrame:
    """The study's lines with combined, direction, its group and sign, and a readable name; none of these is stored."""
    out = study.geometry.join(study.metadata.select("segment_id", "combined"), "segment_id", "left")
    if "direction" in study.metadata.columns:
        out = labels.attach_directions(out, study.metadata)
    return labels.apply_names(out, names, study.metadata)


def display_lines(lines: DataFrame, groups=None, latitude: float | None = None) -> DataFrame:
    """Lines of some direction groups; all of them if none or all that occur are asked for. With a latitude, lines that run against each other move apart."""
    if groups and "direction_group" in lines.columns:
        asked = sorted(set(groups))
        keep = F.array(*(F.lit(g) for g in asked))
        # One row of at most four groups.
        present = lines.agg(F.collect_set("direction_group").alias("_present"))
        some = F.arrays_overlap("_present", keep) & (F.size(F.array_except("_present", keep)) > 0)
        lines = lines.crossJoin(F.broadcast(present)).where(~some | F.coalesce(F.col("direction_group").isin(asked), F.lit(False))).drop("_present")
    return lines if latitude is None else geometry.offset_overlapping(lines, latitude)


def chosen_members(segments: DataFrame, members) -> list[int] | None:
    """Chosen ids that exist, in order; None where they are none or all of the segments: one small aggregate."""
    wanted = sorted({int(m) for m in members or ()})
    if not wanted:
        return None
    known = F.when(F.col("segment_id").isin(wanted), F.col("segment_id"))
    row = segments.select("segment_id").distinct().agg(F.count("segment_id").alias("n"), F.array_sort(F.collect_set(known)).alias("found")).first()
    return row["found"] if 0 < len(row["found"]) < row["n"] else None


def decomposition_panel(session: Session, value: str, segment: int | None = None, **scope) -> tuple[DataFrame, DataFrame]:
    """One entity's decomposition and its level shifts, both of the session's kept series."""
    entity = segment if scope.get("scope", "segment") == "segment" else WHOLE
    if entity is None:
        raise ValueError("choose a segment, or a corridor or the network")
    rows = session.adjusted(value, **scope).where(F.col("segment_id") == entity)
    return rows, shifts.changepoints_in_time(rows, f"{value}_adj")
