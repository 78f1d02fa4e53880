"""Small-result sinks: CSV, GeoJSON and KML documents. Rows are built by column expressions; only the finished rows reach the driver."""

from __future__ import annotations

import csv
import io
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Named colours as red, green and blue; the names that categories cycle through; the ends of a ramp from least to most.
NAMED = {
    "blue": (0, 0, 255), "red": (255, 0, 0), "green": (0, 128, 0), "orange": (255, 165, 0), "purple": (128, 0, 128), "yellow": (255, 215, 0),
    "black": (0, 0, 0), "gray": (128, 128, 128), "grey": (128, 128, 128), "white": (255, 255, 255), "teal": (0, 128, 128), "magenta": (255, 0, 255),
}
PALETTE = ("blue", "red", "green", "orange", "purple", "teal", "magenta", "gray")
RAMP = ((43, 131, 186), (215, 25, 28))


def colour(spec) -> str:
    """rrggbb of a name, '#rrggbb', 'rrggbb', three or four numbers, or KML's own 'aabbggrr'."""
    if isinstance(spec, (tuple, list)):
        return "".join(f"{int(part):02x}" for part in spec[:3])
    text = spec.strip().lower()
    if text in NAMED:
        return colour(NAMED[text])
    text = text.removeprefix("#")
    if len(text) not in (6, 8) or set(text) - set("0123456789abcdef"):
        raise ValueError(f"unknown colour: {spec!r}")
    return text if len(text) == 6 else text[6:8] + text[4:6] + text[2:4]


def feature(properties: Column) -> Column:
    """A GeoJSON feature of the row's line, as JSON text."""
    coordinates = F.transform("line", lambda p: F.array(p["lon"], p["lat"]))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def geojson_rows(lines: DataFrame, *properties: str) -> DataFrame:
    """segment_id and feature; rows without a line have none."""
    return lines.where(F.size("line") >= 2).select("segment_id", feature(F.struct("segment_id", *properties)).alias("feature"))


def to_geojson(lines: DataFrame, *properties: str) -> str:
    """A whole FeatureCollection, in segment order."""
    rows = geojson_rows(lines, *properties).orderBy("segment_id").toLocalIterator()
    return '{"type":"FeatureCollection","features":[' + ",".join(r["feature"] for r in rows) + "]}"


def write_document(head: str, pieces: DataFrame, tail: str, path: str, between: str = "") -> None:
    """A document of any size as text files in a folder, which joined in the order of their names are the document.

    ``pieces``: segment_id and text, a line each, in segment order with ``between`` before all but the first; tasks write them.
    """
    spark = pieces.sparkSession
    lead = pieces.agg(F.min(F.struct("segment_id", "text")).alias("_first"))
    own = pieces.crossJoin(F.broadcast(lead)).select(F.lit(1).alias("_k"), "segment_id", F.when(F.struct("segment_id", "text") == F.col("_first"), F.col("text")).otherwise(F.concat(F.lit(between), "text")).alias("value"))
    ends = spark.createDataFrame([(0, None, head), (2, None, tail)], own.schema)
    own.union(ends).orderBy("_k", "segment_id", "value").select("value").write.mode("overwrite").text(path)


def write_geojson(lines: DataFrame, path: str, *properties: str) -> None:
    """A FeatureCollection as by ``to_geojson``, written by the tasks."""
    rows = geojson_rows(lines, *properties).select("segment_id", F.col("feature").alias("text"))
    write_document('{"type":"FeatureCollection","features":[', rows, "]}", path, ",")


def coordinate_text(line: Column) -> Column:
    return F.array_join(F.transform(line, lambda p: F.format_string("%.6f,%.6f,0", p["lon"], p["lat"])), " ")


def kml_colour(rgb: Column) -> Column:
    """KML's aabbggrr, opaque, of rrggbb."""
    return F.concat(F.lit("ff"), F.substring(rgb, 5, 2), F.substring(rgb, 3, 2), F.substring(rgb, 1, 2))


def ramp_colours(lines: DataFrame, value: str, ramp=RAMP, default="blue") -> DataFrame:
    """Adds colour, between two ends by the value's place from least to most, channels cut to whole numbers; a constant column stands in the middle, NULL gets the default."""
    low, high = (tuple(int(colour(end)[k : k + 2], 16) for k in (0, 2, 4)) for end in ramp)
    span = lines.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    out = lines.crossJoin(F.broadcast(span))
    place = F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.lit(0.5))
    part = lambda k: F.lower(F.lpad(F.hex(F.floor(F.lit(float(low[k])) + (high[k] - low[k]) * place).cast("int")), 2, "0"))
    return out.withColumn("colour", F.when(F.col(value).isNull(), F.lit(colour(default))).otherwise(F.concat(part(0), part(1), part(2)))).drop("_low", "_high")


def category_colours(lines: DataFrame, value: str, palette=PALETTE, default="blue") -> DataFrame:
    """Adds colour by category: of a mapping from values to colours, or in the order of each category's smallest segment_id, cycling through a list; others get the default."""
    if isinstance(palette, dict):
        own = F.lit(colour(default))
        for kind, spec in palette.items():
            own = F.when(F.col(value) == kind, F.lit(colour(spec))).otherwise(own)
        return lines.withColumn("colour", own)
    kinds = lines.where(F.col(value).isNotNull()).groupBy(value).agg(F.min("segment_id").alias("_first"))
    # One row a category, of a list that a legend shows.
    kinds = kinds.withColumn("_k", F.row_number().over(Window.orderBy("_first", value)) - 1).drop("_first")
    colours = F.array(*(F.lit(colour(c)) for c in palette))
    return lines.join(kinds, value, "left").withColumn("colour", F.coalesce(F.get(colours, F.col("_k") % len(palette)), F.lit(colour(default)))).drop("_k")


def placemark_rows(lines: DataFrame, name: str = "name") -> DataFrame:
    """segment_id, colour and placemark (KML text) of lines (segment_id, line, colour and a name)."""
    text = F.replace(F.replace(F.replace(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mark = F.concat(F.lit("<Placemark><name>"), text, F.lit("</name><styleUrl>#c"), F.col("colour"), F.lit("</styleUrl><LineString><coordinates>"), coordinate_text(F.col("line")), F.lit("</coordinates></LineString></Placemark>"))
    return lines.where(F.size("line") >= 2).select("segment_id", "colour", mark.alias("placemark"))


def to_kml(lines: DataFrame, title: str, name: str = "name", width: int = 4) -> str:
    """A KML document: one style a colour, then the placemarks in segment order."""
    rows = placemark_rows(lines, name)
    colours = [r[0] for r in rows.select("colour").distinct().orderBy("colour").collect()]
    styles = "".join(f'<Style id="c{c}"><LineStyle><color>ff{c[4:6]}{c[2:4]}{c[0:2]}</color><width>{width}</width></LineStyle></Style>' for c in colours)
    marks = "".join(r["placemark"] for r in rows.orderBy("segment_id").toLocalIterator())
    return f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{escape(title)}</name>{styles}{marks}</Document></kml>'


def to_csv(df: DataFrame) -> str:
    """A small result as CSV text with a header."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(tuple(r) for r in df.toLocalIterator())
    return out.getvalue()


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A result of any size as CSV files with headers in a folder, written by the tasks; with ``order``, sorted from file to file."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)
