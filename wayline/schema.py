"""Canonical columns, provenance and the study that carries both.

Observations are one row per (segment_id, ts_utc). ``ts_utc`` is TIMESTAMP_NTZ in UTC and identifies a
row; everything that depends on the calendar uses the local columns that ``calendar.to_local`` adds.
Missing values are NULL: sources turn NaN into NULL once, since Spark holds NaN larger than any number.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metric columns in the order in which a default metric is looked for.
METRICS = ("travel_time", "speed", "hist_speed", "ref_speed", "delay")
OBSERVATION_COLUMNS = ("segment_id", "ts_utc", "speed", "hist_speed", "ref_speed", "travel_time", "cvalue", "pct30", "pct20", "pct10", "road_closure", "corridor")


def pin_utc(spark: SparkSession) -> SparkSession:
    """All instants are shown and cast in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def number(column: Column | str) -> Column:
    """A double; text that is no number, NaN and missing become NULL."""
    value = F.expr(f"try_cast({column} AS double)") if isinstance(column, str) else column.try_cast("double")
    return F.when(~F.isnan(value), value)


def metric_columns(df: DataFrame) -> list[str]:
    return [m for m in METRICS if m in df.columns]


def default_metric(df: DataFrame) -> str:
    """Travel time if there is one, else speed."""
    for name in ("travel_time", "speed"):
        if name in df.columns:
            return name
    raise ValueError("the frame has neither travel_time nor speed")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def numeric(df: DataFrame, *names: str) -> None:
    """Raises unless the named columns hold numbers."""
    for name in names:
        kind = dict(df.dtypes)[name]
        if not kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
            raise TypeError(f"{name} holds {kind}, not numbers")


@dataclass(frozen=True)
class Provenance:
    """What has been done to a frame; every operator of a study returns a new one."""

    units: dict = field(default_factory=dict)
    tz: str | None = None
    notes: tuple = ()
    warnings: tuple = ()

    def noted(self, **facts) -> "Provenance":
        return replace(self, notes=self.notes + tuple(sorted(facts.items())))

    def fact(self, name: str, default=None):
        """The latest value noted under a name."""
        return next((v for k, v in reversed(self.notes) if k == name), default)

    def warned(self, text: str) -> "Provenance":
        return replace(self, warnings=self.warnings + (text,))


@dataclass(frozen=True)
class Study:
    """Observations with their dimensions: metadata and geometry hold one row a segment."""

    observations: DataFrame
    metadata: DataFrame | None = None
    geometry: DataFrame | None = None
    provenance: Provenance = Provenance()

    def then(self, operator, *args, **kwargs) -> "Study":
        """This study with ``operator(observations, ...)`` applied and noted."""
        return replace(self, observations=operator(self.observations, *args, **kwargs), provenance=self.provenance.noted(**{operator.__name__: (args, tuple(sorted(kwargs.items())))}))
