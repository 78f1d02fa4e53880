"""Published KML: lines with labels at their midpoints, descriptions, one style a colour, and a legend."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sinks import colour, coordinate_text, write_document  # noqa: F401

#: Fixed values, here and below: the elements of a placemark, a style and the legend, and the texts of descriptions, are those of the published format.


def xml_text(value: Column) -> Column:
    """A column as XML text, NULL as nothing."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def midpoint(line: Column) -> Column:
    """The point half-way along a line of at least two points, measured in its own coordinates."""
    later, earlier = F.slice(line, 2, F.size(line) - 1), F.slice(line, 1, F.size(line) - 1)
    edge = lambda a, b: F.struct(a["lon"].alias("x"), a["lat"].alias("y"), (b["lon"] - a["lon"]).alias("dx"), (b["lat"] - a["lat"]).alias("dy"), F.hypot(b["lon"] - a["lon"], b["lat"] - a["lat"]).alias("d"))
    edges = F.zip_with(earlier, later, edge)
    whole = F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["d"])
    at = lambda left, x, y: F.struct(left.alias("left"), x.alias("lon"), y.alias("lat"))

    def walk(s, e):
        step = F.least(s["left"], e["d"])
        part = F.when(e["d"] > 0, step / e["d"]).otherwise(F.lit(0.0))
        return F.when(s["left"] > 0, at(s["left"] - step, e["x"] + part * e["dx"], e["y"] + part * e["dy"])).otherwise(s)

    first = F.element_at(line, 1)
    end = F.aggregate(edges, at(whole / 2, first["lon"], first["lat"]), walk)
    return F.struct(end["lon"].alias("lon"), end["lat"].alias("lat"))


def published_rows(lines: DataFrame, name: str | None = None, value: str | None = None) -> DataFrame:
    """segment_id, colour and placemark of lines (segment_id, line, colour as rrggbb): label, description, the line and a point to carry the label.

    Without a name the id is the label. The description tells the id, the line's source if there is one, and
    ``value``. Lines of fewer than two points are left out.
    """
    lines = lines.where(F.size("line") >= 2)
    told = [F.concat(F.lit("Segment ID: "), F.col("segment_id").cast("string"))]
    told += [F.concat(F.lit(f"{title}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for title, c in (("Geometry", "source"), (value, value)) if c in lines.columns]
    label = F.coalesce(*(F.col(c).cast("string") for c in (name, "segment_id") if c))
    middle = midpoint(F.col("line"))
    mark = F.concat(
        F.lit("<Placemark><name>"), xml_text(label), F.lit("</name><description>"), xml_text(F.concat_ws("<br>", *told)), F.lit("</description><styleUrl>#c"), F.col("colour"),
        F.lit("</styleUrl><MultiGeometry><LineString><tessellate>1</tessellate><coordinates>"), coordinate_text(F.col("line")), F.lit("</coordinates></LineString><Point><coordinates>"),
        F.format_string("%.6f,%.6f,0", middle["lon"], middle["lat"]), F.lit("</coordinates></Point></MultiGeometry></Placemark>"),
    )
    return lines.select("segment_id", "colour", mark.alias("placemark"))


def legend_rows(lines: DataFrame, value: str) -> list[tuple[str, str]]:
    """Texts and colours: the least and most of a number (none if they are equal), each category otherwise, in sorted order."""
    known = lines.where(F.col(value).isNotNull())
    if dict(lines.dtypes)[value] in ("string", "boolean"):
        return [(f"{value}: {r[0]}", r[1]) for r in known.groupBy(value).agg(F.min("colour").alias("colour")).orderBy(value).collect()]
    ends = known.agg(F.min(F.struct(value, "colour")).alias("a"), F.max(F.struct(value, "colour")).alias("b")).first()
    if ends["a"] is None or ends["a"][0] == ends["b"][0]:
        return []
    return [(f"{value} = {x[0]:g}", x[1]) for x in ends]


def _frame(lines: DataFrame, rows: DataFrame, title: str, value: str | None, labels: bool, width: int) -> tuple[str, str]:
    """A document's beginning, with a style for each colour and the legend, and its end: as many rows reach the driver as there are colours."""
    styles = ""
    for (c,) in rows.select("colour").distinct().orderBy("colour").collect():
        own = f"ff{c[4:6]}{c[2:4]}{c[0:2]}"
        styles += f'<Style id="c{c}"><LineStyle><color>{own}</color><width>{width}</width></LineStyle><LabelStyle><color>{own}</color><scale>{1.0 if labels else 0}</scale></LabelStyle><IconStyle><scale>0</scale><Icon/></IconStyle></Style>'
    legend = "".join(f"<font color='#{c}'>&#9632;</font> {escape(text)}<br>" for text, c in (legend_rows(lines, value) if value else []))
    overlay = f'<ScreenOverlay><name>Legend</name><description>{escape(f"<b>Legend</b><br>{legend}")}</description><overlayXY x="0" y="1" xunits="fraction" yunits="fraction"/><screenXY x="0.05" y="0.95" xunits="fraction" yunits="fraction"/></ScreenOverlay>' if legend else ""
    return f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{escape(title)}</name>{styles}{overlay}', "</Document></kml>"


def publish(lines: DataFrame, title: str, name: str | None = None, value: str | None = None, labels: bool = False, width: int = 3) -> str:
    """A KML document of coloured lines, in segment order; labels: always shown, not on hovering alone. For a map that a viewer opens."""
    rows = published_rows(lines, name, value)
    head, tail = _frame(lines, rows, title, value, labels, width)
    return head + "".join(r["placemark"] for r in rows.orderBy("segment_id").toLocalIterator()) + tail


def write_published(lines: DataFrame, path: str, title: str, name: str | None = None, value: str | None = None, labels: bool = False, width: int = 3) -> None:
    """The same document, of any size, written by the tasks as text files whose names give their order."""
    rows = published_rows(lines, name, value)
    head, tail = _frame(lines, rows, title, value, labels, width)
    write_document(head, rows.select("segment_id", F.col("placemark").alias("text")), tail, path)
