"""Readable segment names and directions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Compass words that a road name may begin or end with.
COMPASS = "(?:northbound|southbound|eastbound|westbound|north|south|east|west|nb|sb|eb|wb|ne|nw|se|sw|n|s|e|w)"
#: Route prefixes that a cross street may begin with.
ROUTES = "(?:US|I|SR|ID|SH|CR)"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def combined(road: Column, direction: Column, intersection: Column) -> Column:
    """Road, direction and intersection in one line, without what is missing."""
    return collapse(F.concat_ws(" ", road, direction, intersection))


def road_core(road: Column) -> Column:
    """What stands after the last ' / ', without a compass word at either end."""
    core = F.trim(F.element_at(F.split(road, " / "), -1))
    bare = F.trim(F.regexp_replace(F.regexp_replace(core, rf"(?i)^{COMPASS}\s+", ""), rf"(?i)\s+{COMPASS}$", ""))
    return F.when(bare != "", bare).otherwise(core)


def clean_cross(text: Column) -> Column:
    """A cross street without its route number."""
    return F.trim(F.regexp_replace(F.trim(text), rf"(?i)^{ROUTES}-\d+\s+", ""))


def _has(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def simplify_label(road: Column, intersection: Column) -> Column:
    """The road's core and its cross streets, joined by ' & ': those that repeat or hold the core go, as do repeats whatever their case."""
    core = road_core(F.coalesce(road, F.lit("")))
    parts = F.transform(F.split(F.coalesce(intersection, F.lit("")), " / "), lambda x: clean_cross(x))
    fresh = F.filter(parts, lambda x: (x != "") & ~((core != "") & _has(x, core)))
    names = F.filter(F.concat(F.array(core), fresh), lambda x: x != "")
    low = F.transform(names, lambda x: F.lower(x))
    first = F.filter(F.transform(names, lambda x, i: F.when(F.array_position(low, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    return F.array_join(first, " & ")


def direction_group(label: Column) -> Column:
    """The first of N, E, S and W that stands anywhere in the label, else NULL."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(label)), "[NESW]", 0), F.lit(""))


def direction_sign(label: Column) -> Column:
    """1 northward or eastward, -1 southward or westward, else 0."""
    group = direction_group(label)
    return F.when(group.isin("N", "E"), 1).when(group.isin("S", "W"), -1).otherwise(0)


def seed_names(metadata: DataFrame) -> DataFrame:
    """segment_id, seed_label and name of metadata (segment_id, road, intersection, combined): the simplified label, else combined, else the id."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    label = simplify_label(F.col("road"), F.col("intersection"))
    return metadata.select("segment_id", F.col("combined").alias("seed_label"), F.coalesce(blank(label), blank(F.col("combined")), F.col("segment_id").cast("string")).alias("name"))


def apply_names(df: DataFrame, names: DataFrame | None, metadata: DataFrame) -> DataFrame:
    """Adds name: the given one unless it is blank, then the seeded one, then the id."""
    seeds = seed_names(metadata).select("segment_id", F.col("name").alias("_seed"))
    df = df.join(seeds, "segment_id", "left")
    given = F.lit(None).cast("string")
    if names is not None:
        df = df.join(names.select("segment_id", F.col("name").alias("_given")), "segment_id", "left")
        given = F.nullif(F.trim("_given"), F.lit(""))
    return df.withColumn("name", F.coalesce(given, F.col("_seed"), F.col("segment_id").cast("string"))).drop("_seed", "_given")


def attach_directions(geometry: DataFrame, directions: DataFrame) -> DataFrame:
    """Adds direction, direction_group and direction_sign from directions (segment_id, direction)."""
    out = geometry.join(directions.select("segment_id", "direction"), "segment_id", "left")
    return out.withColumns({"direction_group": direction_group(F.col("direction")), "direction_sign": direction_sign(F.col("direction"))})
