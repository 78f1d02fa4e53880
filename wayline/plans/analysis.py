"""Whole analyses: a scope of a study as one series, its comparison, and the panels and maps made of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import compare, completeness, decompose, filters, geometry, shifts, summarize, weights
from ..operators.nearest import nearest_line_join
from ..schema import METRICS, Study, default_metric
from ..sources.kml import publish
from ..sources.sinks import ramp_colours

#: The entity of an aggregate series.
WHOLE = -1
#: Metrics whose sum over segments means something.
SUMMABLE = ("travel_time", "delay")


def open_study(study: Study, tz: str = "America/Denver", threshold: float | None = 80, start=None, end=None, lengths: DataFrame | None = None) -> Study:
    """Local calendar, confidence filter, date range and, where it can be computed, delay: one lazy plan."""
    df = cal.to_local(study.observations, tz)
    if threshold is not None and "cvalue" in df.columns:
        df = filters.filter_confidence(df, threshold)
    df = filters.filter_date_range(df, start, end, tz)
    if {"travel_time", "ref_speed"} <= set(df.columns) and (lengths is not None or "speed" in df.columns):
        df = summarize.segment_delay(df, lengths)
    return Study(df, study.metadata, study.geometry, study.provenance.noted(tz=tz, cvalue_threshold=threshold, date_range=(start, end)))


def spans(study: Study) -> tuple:
    """First and last local day: one small aggregate."""
    return tuple(study.observations.agg(F.min("local_date"), F.max("local_date")).first())


def analysis_series(study: Study, value: str, scope: str = "segment", corridor: str | None = None, window=None, days=None, members=None, volumes: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """segment_id, ts_utc, value and the local columns of a scope.

    Filters come first. 'segment' keeps the rows; 'corridor' and 'network' sum complete timestamps into
    one entity, explicit members as a network of their own; ``weighted`` takes the volume-weighted speed.
    """
    if scope in ("corridor", "network") and not weighted and value not in SUMMABLE:
        raise ValueError(f"{value} can't be summed over segments")
    df = filters.filter_when(study.observations, window, days)
    if scope == "segment" and not weighted:
        return df
    if weighted:
        if volumes is None:
            raise ValueError("a weighted speed needs volumes")
        out = weights.weighted_speed_by_time(filters.filter_members(df, members), volumes, "speed").select("ts_utc", F.col("weighted_speed").alias(value))
    elif scope == "corridor" and not members:
        out = completeness.corridor_travel_time(df.where(F.col("corridor") == corridor), value=value).select("ts_utc", value)
    elif scope in ("corridor", "network"):
        out = completeness.network_travel_time(df, value=value, label=corridor or "Network", members=members).select("ts_utc", value)
    else:
        raise ValueError(f"unknown scope: {scope!r}")
    return cal.to_local(out.withColumn("segment_id", F.lit(WHOLE).cast("long")), study.provenance.fact("tz", "America/Denver"))


@dataclass
class Session:
    """Keeps the costly half of comparisons for a study, adjusted series by their canonical key, ``capacity`` at most, and ``results`` comparisons.

    ``volumes`` (segment_id, aadt) serve the weighted speed of the aggregate scopes.
    """

    study: Study
    capacity: int = 2
    volumes: DataFrame | None = None
    results: int = 16
    _kept: dict = field(default_factory=dict)
    _compared: dict = field(default_factory=dict)

    @staticmethod
    def _key(value: str, scope: str, corridor, window, days, members, weighted: bool, options: dict) -> tuple:
        chosen = tuple(sorted(members)) if members and scope != "segment" else None
        return value, scope, corridor if scope == "corridor" else None, filters.window_key(window, days), chosen, bool(weighted), tuple(sorted(options.items()))

    @staticmethod
    def _recent(kept: dict, key, limit: int, make):
        """The kept frame of a key, made and kept on disk if there is none; the least recently used goes beyond ``limit``."""
        kept[key] = kept.pop(key) if key in kept else make().persist(StorageLevel.DISK_ONLY_2)
        while len(kept) > limit:
            kept.pop(next(iter(kept))).unpersist()
        return kept[key]

    def adjusted(self, value: str, scope: str = "segment", corridor=None, window=None, days=None, members=None, weighted: bool = False, **options) -> DataFrame:
        def make() -> DataFrame:
            return decompose.adjust(analysis_series(self.study, value, scope, corridor, window, days, members, self.volumes, weighted), value, **options)

        return self._recent(self._kept, self._key(value, scope, corridor, window, days, members, weighted, options), self.capacity, make)

    def compare(self, before, after, value: str, unit: str = "day", scope: str = "segment", corridor=None, window=None, days=None, members=None, weighted: bool = False, **options) -> DataFrame:
        """Periods are checked before anything is computed; a comparison asked for again is not computed again."""
        periods = cal.check_periods(before, after)
        own = {"scope": scope, "corridor": corridor, "window": window, "days": days, "members": members, "weighted": weighted}
        key = (periods, unit, self._key(value, scope, corridor, window, days, members, weighted, options))
        return self._recent(self._compared, key, self.results, lambda: compare.compare_adjusted(self.adjusted(value, **own, **options), before, after, value, unit=unit))

    def changepoints(self, value: str, detection: dict | None = None, **scope) -> DataFrame:
        """Level shifts of the kept series; ``detection``: options of shifts.changepoints_in_time."""
        return shifts.changepoints_in_time(self.adjusted(value, **scope), f"{value}_adj", **(detection or {}))

    def close(self) -> None:
        for kept in (self._compared, self._kept):
            while kept:
                kept.popitem()[1].unpersist()


def daytime_summary(df: DataFrame, value: str) -> DataFrame:
    """Default day groups and bins."""
    return summarize.segment_summary(filters.assign_time_bins(filters.assign_day_group(df)), [value])


def panel_summary(df: DataFrame, value: str, before=None, after=None) -> DataFrame:
    """The day-time summary of the whole, or of each of two valid periods, with ``period``."""
    try:
        first, second = cal.check_periods(before, after) if before and after else (None, None)
    except ValueError:
        first = None
    if first is None:
        return daytime_summary(df, value).withColumn("period", F.lit("all"))
    period = F.when(filters.between(*first), F.lit("before")).when(filters.between(*second), F.lit("after"))
    rows = filters.assign_time_bins(filters.assign_day_group(df)).withColumn("period", period)
    return summarize.segment_summary(rows, [value], ("segment_id", "day_group", "time_bin", "period"))


def panel_forest(result: DataFrame, level: float = 0.05) -> DataFrame:
    """A comparison sorted by effect, with ``significant``."""
    return result.withColumn("significant", F.coalesce(F.col("q_value") <= level, F.lit(False))).orderBy("effect", "segment_id")


def _chosen(lines: DataFrame, members) -> DataFrame:
    """Adds ``member``: whether a segment is among the chosen ones, all where none are chosen."""
    if not members:
        return lines.withColumn("member", F.lit(True))
    return lines.withColumn("member", F.coalesce(F.col("segment_id").isin(sorted({int(m) for m in members})), F.lit(False)))


def map_values(study: Study, mode: str, value: str, before=None, after=None, volumes: DataFrame | None = None, window=None, days=None, members=None, **options) -> DataFrame:
    """segment_id, shown and member, of the rows in a window of the day and on some days: the mean, the seasonally adjusted change between two periods, or vehicle hours of delay.

    'delta' shows the mean if the periods are missing or not valid, or if no segment can be compared: as
    one plan, in which a comparison without rows lets the means through. ``members`` are flagged, not
    filtered. options: those of the decomposition.
    """
    series = analysis_series(study, value, window=window, days=days)
    means = summarize.segment_means(series, value)
    if mode == "vhd":
        return _chosen(weights.vehicle_hours_of_delay(means, volumes).select("segment_id", F.col("vehicle_hours").alias("shown")), members)
    shown = means.select("segment_id", F.col("mean").alias("shown"))
    if mode == "delta" and before and after:
        try:
            cal.check_periods(before, after)
        except ValueError:  # overlapping or empty periods
            return _chosen(shown, members)
        changes = compare.compare_adjusted(decompose.adjust(series, value, **options), before, after, value, inference=False).select("segment_id", F.col("effect").alias("shown"))
        # One row, which says whether there is any comparison.
        some = changes.agg((F.count("*") > 0).alias("_some"))
        shown = changes.unionByName(shown.crossJoin(F.broadcast(some)).where(~F.col("_some")).drop("_some"))
    return _chosen(shown, members)


def export_kml(study: Study, mode: str, value: str, title: str = "Segments", labels: bool = False, **options) -> str:
    """The map's lines, coloured by what they show, as a published KML document with labels, descriptions and a legend."""
    shown = map_values(study, mode, value, **options)
    names = [F.col("name")] if "name" in study.geometry.columns else []
    lines = study.geometry.drop("shown", "member", "colour").join(shown, "segment_id", "left").withColumn("name", F.coalesce(*names, F.col("segment_id").cast("string")))
    return publish(ramp_colours(lines, "shown"), title, "name", "shown", labels)


def segment_table(study: Study, names: DataFrame, value: str | None = None) -> DataFrame:
    """Metadata, names and coverage in percent with one decimal."""
    coverage = completeness.segment_coverage(study.observations, study.metadata.select("segment_id"), value)
    out = study.metadata.join(names.select("segment_id", "name"), "segment_id", "left").join(coverage, "segment_id", "left")
    return out.withColumn("coverage_pct", F.bround(F.col("coverage") * 100, 1))


def capabilities(study: Study, store=None, area: str | None = None) -> dict:
    """What can be asked of a study: metrics, scopes, map modes, corridors and directions; with a store also its areas and, of one of them, the bins.

    The lists are what a menu shows: as many entries as there are corridors, directions and areas.
    """
    columns = set(study.observations.columns)
    corridors = [r[0] for r in study.observations.select("corridor").where("corridor IS NOT NULL").distinct().orderBy("corridor").collect()] if "corridor" in columns else []
    volumes = study.geometry is not None and "aadt" in study.geometry.columns
    metrics = [m for m in METRICS if m in columns]
    directions = []
    if study.geometry is not None and "direction_group" in study.geometry.columns:
        directions = [r[0] for r in study.geometry.select("direction_group").where("direction_group IS NOT NULL").distinct().orderBy("direction_group").collect()]
    out = {"metrics": metrics, "scopes": ["segment", *(["corridor"] if corridors else []), "network"], "corridors": corridors, "directions": directions, "map_modes": ["mean", "delta", *(["vhd"] if volumes and "delay" in columns else [])], "weighted_speed": volumes and "speed" in columns, "default_metric": default_metric(study.observations)}
    if store is not None:
        out["areas"] = [(r["area_key"], r["area_name"]) for r in store.areas().select("area_key", "area_name").collect()]
        out["bins"] = store.area_bins(area) if area is not None else []
    return out


def build_geometry(study: Study, network: DataFrame, volumes: DataFrame | None) -> DataFrame:
    """Lines of the study's segments with volumes of the nearest lines, for T1-style ingestion."""
    lines = geometry.segment_geometry(study.metadata.select("segment_id"), network, study.metadata)
    if volumes is None:
        return lines
    return lines.join(nearest_line_join(lines, volumes), "segment_id", "left")
