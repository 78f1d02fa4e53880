"""The nearest line of each segment: local bearings at the closest approach, and no limit to the distance.

Distances are metres of the six-degree transverse Mercator zone of each segment's first point. Lines are cut
into pieces of at most ``PIECE`` metres, so that a piece meets few cells however long and slanting its line is. Cells are
bands of latitude, cut by longitude into widths that shrink with the band's latitude; a pyramid of them
doubles its cells from level to level. Joins are equi-joins on cells; they are sort-merge joins by a hint, since Spark's
estimates know nothing of the rows that cells make of a line, and would broadcast them. Equal lines are measured once. Lines don't meet across 180 degrees,
and places nearer to a pole than fifteen degrees aren't provided for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import central_meridian, forward_steps
from .geometry import shapes

#: Metres of a cell's side at level 0, and of a piece of a line.
PIECE = 500.0
#: Levels of the pyramid, of cells from 500 m to 2000 km, and one whose cells hold everything.
LEVELS, WHOLE = 13, 18
#: Parts that the lines of a cell are dealt over, where many segments may meet many lines in one cell.
PARTS = 16
#: Levels between a cell and those of the pieces that stand for it; metres by which an edge that is straight in the plane may bend away from its pieces (one of 30 km does).
FINER, BENT = 5, 20.0
#: Metres of a degree of latitude, where it is shortest; a lower bound of any cosine that cells are cut by.
_DEGREE, _LEAST_COS = 110_500.0, 0.01


def _edges(lines: DataFrame, key: str, *carried: str) -> DataFrame:
    """(key, edge, lon1, lat1, lon2, lat2) of each line of two points or more."""
    ends = F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("a"), F.slice("line", 2, F.size("line") - 1).alias("b"))
    out = lines.where(F.size("line") >= 2).select(key, *carried, F.posexplode(ends).alias("edge", "e"))
    return out.select(key, *carried, "edge", F.col("e.a.lon").alias("lon1"), F.col("e.a.lat").alias("lat1"), F.col("e.b.lon").alias("lon2"), F.col("e.b.lat").alias("lat2"))


def pieces(lines: DataFrame, key: str, *carried: str) -> DataFrame:
    """The edges of ``lines`` (key, edge, lon1, lat1, lon2, lat2), a row for each piece of at most PIECE metres that an edge is evenly cut into: w, s, e and n are a piece's box."""
    cut = _edges(lines, key, *carried).withColumn("_n", F.expr(f"greatest(ceil(hypot((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), lat2 - lat1) * 111700 / {PIECE}), 1L)"))
    cut = cut.withColumn("_k", F.expr("explode(sequence(0L, _n - 1))"))
    at = lambda c, k: f"{c}1 + ({c}2 - {c}1) * (_k + {k}) / _n"
    box = {n: F.expr(f"{f}({at(c, 0)}, {at(c, 1)})") for n, f, c in (("w", "least", "lon"), ("s", "least", "lat"), ("e", "greatest", "lon"), ("n", "greatest", "lat"))}
    return cut.withColumns(box).drop("_n", "_k")


#: Columns of a piece's box.
_BOX = ("w", "s", "e", "n")


def cells(metres: str, widen: str) -> Column:
    """The cells, of sides of ``metres``, that a piece's box meets when it is widened by ``widen`` metres on all sides; both are SQL."""
    tall, wider = f"(({metres}) / {_DEGREE}D)", f"(({widen}) / {_DEGREE}D)"
    cosine = f"greatest(least(cos(radians(least(abs(s - {wider}), 90.0D))), cos(radians(least(abs(n + {wider}), 90.0D)))), {_LEAST_COS}D)"
    # A band's cells are cut where a degree of longitude is shortest.
    wide = f"({tall} / greatest(cos(radians(least(greatest(abs(j * {tall}), abs((j + 1) * {tall})), 90.0D))), {_LEAST_COS}D))"
    row = f"transform(sequence(floor((w - {wider} / {cosine}) / {wide}), floor((e + {wider} / {cosine}) / {wide})), i -> named_struct('i', i, 'j', j))"
    return F.expr(f"explode(flatten(transform(sequence(floor((s - {wider}) / {tall}), floor((n + {wider}) / {tall})), j -> {row})))")


def _stepwise(df: DataFrame, steps: list[dict[str, str]], *kept: str) -> DataFrame:
    """Adds the columns ``kept`` of steps of SQL, each step by the names of those before: plans stay small where one text would repeat its parts."""
    for step in steps:
        df = df.withColumns({n: F.expr(v) for n, v in step.items()})
    return df.drop(*(n for step in steps for n in step if n not in kept))


def _projected(df: DataFrame, names: tuple[str, str], prefix: str) -> DataFrame:
    """Adds x and y in metres of the zone ``lon0``, named with ``prefix``, of both ends whose degrees have ``names`` as prefixes."""
    ends = [forward_steps(f"{names[0]}{k}", f"{names[1]}{k}", "lon0", f"{prefix}{{}}{k}") for k in (1, 2)]
    return _stepwise(df, [one | two for one, two in zip(*ends)], *(f"{prefix}{c}{k}" for k in (1, 2) for c in "xy"))


def _along(px: str, py: str, x: str, y: str, dx: str, dy: str) -> str:
    """How far along an edge from (x, y), from 0 to 1, it is closest to a point."""
    return f"CASE WHEN {dx} * {dx} + {dy} * {dy} > 0 THEN greatest(least((({px} - {x}) * {dx} + ({py} - {y}) * {dy}) / ({dx} * {dx} + {dy} * {dy}), 1.0D), 0.0D) ELSE 0.0D END"


def closest(df: DataFrame, a: str = "a_", b: str = "b_") -> DataFrame:
    """Adds near, a struct of the distance of two edges in the plane and of the mutually nearest points (ax, ay) and (bx, by); a crossing counts first, then ends by order."""
    dx, dy = {p: f"_{p}dx" for p in (a, b)}, {p: f"_{p}dy" for p in (a, b)}
    named = lambda d, o, *points: f"named_struct('distance', {d}, 'order', {o}, " + ", ".join(f"'{n}', {v}" for n, v in zip(("ax", "ay", "bx", "by"), points)) + ")"
    sides = {names[p]: f"{p}{c}2 - {p}{c}1" for c, names in (("x", dx), ("y", dy)) for p in (a, b)}
    places, feet, found = {"_turn": f"nullif({dx[a]} * {dy[b]} - {dy[a]} * {dx[b]}, 0.0D)"}, {}, []
    for p, q in ((a, b), (b, a)):
        for k in (1, 2):
            o = len(found) + 1
            px, py, foot = f"{p}x{k}", f"{p}y{k}", (f"_fx{o}", f"_fy{o}")
            places[f"_t{o}"] = _along(px, py, f"{q}x1", f"{q}y1", dx[q], dy[q])
            feet |= {foot[0]: f"{q}x1 + _t{o} * {dx[q]}", foot[1]: f"{q}y1 + _t{o} * {dy[q]}"}
            points = (px, py, *foot) if p == a else (*foot, px, py)
            found.append(named(f"hypot({px} - {foot[0]}, {py} - {foot[1]})", o, *points))
    feet |= {n: f"(({b}x1 - {a}x1) * {dy[p]} - ({b}y1 - {a}y1) * {dx[p]}) / _turn" for n, p in (("_s", b), ("_t", a))}
    point = f"({a}x1 + _s * {dx[a]})", f"({a}y1 + _s * {dy[a]})"
    crossing = f"CASE WHEN _s > 0 AND _s < 1 AND _t > 0 AND _t < 1 THEN {named('0.0D', 0, *point, *point)} END"
    return _stepwise(df, [sides, places, feet, {"near": f"least({crossing}, {', '.join(found)})"}], "near")


def let(name: str, value: str, use: str) -> str:
    """SQL for ``use`` of a value that is computed once, however often it is named and wherever the optimiser moves the whole."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def path(line: str, lon0: str) -> str:
    """SQL for a line's edges in metres: x, y, dx, dy and len of each."""
    first, second, last = forward_steps("p.lon", "p.lat", lon0, "z.{}")
    struct = lambda step: "named_struct(" + ", ".join(f"'{n[2:]}', {v}" for n, v in step.items()) + ")"
    points = f"transform({line}, p -> {let('z', struct(first), let('z', struct(second), struct(last)))})"
    edge = "named_struct('x', u.x, 'y', u.y, 'dx', v.x - u.x, 'dy', v.y - u.y, 'len', hypot(v.x - u.x, v.y - u.y))"
    return let("w", points, f"zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (u, v) -> {edge})")


def measure(edges: str, px: str, py: str) -> str:
    """SQL for how many metres along a path it is first closest to a point."""
    t = _along(px, py, "e.x", "e.y", "e.dx", "e.dy")
    near = let("t", t, f"named_struct('d', hypot({px} - e.x - t * e.dx, {py} - e.y - t * e.dy), 'at', acc.s + t * e.len)")
    step = let("f", near, "named_struct('d', least(f.d, acc.d), 'at', CASE WHEN f.d < acc.d THEN f.at ELSE acc.at END, 's', acc.s + e.len)")
    return f"aggregate({edges}, named_struct('d', double('infinity'), 'at', 0.0D, 's', 0.0D), (acc, e) -> {step}, acc -> acc.at)"


def along(edges: str, metres: str) -> str:
    """SQL for the point (x, y) so many metres along a path, kept within it."""
    t = f"CASE WHEN e.len > 0 THEN greatest(least(({metres} - acc.s) / e.len, 1.0D), 0.0D) ELSE 0.0D END"
    step = let("t", t, f"named_struct('s', acc.s + e.len, 'x', CASE WHEN {metres} > acc.s THEN e.x + t * e.dx ELSE acc.x END, 'y', CASE WHEN {metres} > acc.s THEN e.y + t * e.dy ELSE acc.y END)")
    return f"aggregate({edges}, named_struct('s', 0.0D, 'x', {edges}[0].x, 'y', {edges}[0].y), (acc, e) -> {step}, acc -> named_struct('x', acc.x, 'y', acc.y))"


def local_bearing(edges: str, px: str, py: str, reach: float = 5.0) -> str:
    """SQL for the undirected direction, in degrees from 0 to 180, of a path where it is closest to a point: of the chord from ``reach`` metres before that place to as many after it, of the whole path where that chord is a point, else NULL."""
    turn = lambda d: let("d", d, "CASE WHEN d.x != 0 OR d.y != 0 THEN pmod(degrees(atan2(d.y, d.x)), 180.0D) END")
    ends = f"named_struct('p', {along('g', f'(m - {reach}D)')}, 'q', {along('g', f'(m + {reach}D)')})"
    chord = turn(let("c", ends, "named_struct('x', c.q.x - c.p.x, 'y', c.q.y - c.p.y)"))
    whole = turn("named_struct('x', g[size(g) - 1].x + g[size(g) - 1].dx - g[0].x, 'y', g[size(g) - 1].y + g[size(g) - 1].dy - g[0].y)")
    return let("g", edges, f"coalesce({let('m', measure('g', px, py), chord)}, {whole})")


def bearing_difference(a: str, b: str) -> str:
    """SQL for the 0 to 90 degrees between undirected bearings; 180 if one is unknown."""
    return f"coalesce({let('o', f'abs({a} - {b})', 'least(pmod(o, 180.0D), 180.0D - pmod(o, 180.0D))')}, 180.0D)"


def _joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that never broadcasts."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def _widened(df: DataFrame, widen: str) -> DataFrame:
    """Boxes widened by ``widen`` (SQL) metres on all sides, as ``cells`` widens them."""
    wider = f"(({widen}) / {_DEGREE}D)"
    aside = f"({wider} / greatest(least(cos(radians(least(abs(s - {wider}), 90.0D))), cos(radians(least(abs(n + {wider}), 90.0D)))), {_LEAST_COS}D))"
    return df.withColumns({"w": F.expr(f"w - {aside}"), "s": F.expr(f"s - {wider}"), "e": F.expr(f"e + {aside}"), "n": F.expr(f"n + {wider}")})


def _met(own: DataFrame, lines: DataFrame, *on: str, touching: bool = True) -> DataFrame:
    """Pieces of segments and of lines that share ``on`` and, unless told otherwise, whose boxes touch, with near, the closest approach of their edges."""
    # Few rows may meet many: dealt out by number, since their size says nothing about the work.
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _joined(own.repartition(tasks, *on), lines.repartition(tasks, *on), list(on))
    if touching:
        met = met.where("b_w <= e AND b_e >= w AND b_s <= n AND b_n >= s")
    return closest(_projected(met, ("b_lon", "b_lat"), "b_"))


def _own(distinct: DataFrame) -> DataFrame:
    own = pieces(distinct.withColumn("lon0", F.expr(central_meridian("line[0].lon"))), "shape", "lon0")
    return _projected(own, ("lon", "lat"), "a_").withColumnRenamed("edge", "a_edge").drop("lon1", "lat1", "lon2", "lat2")


def nearest_line_join(segments: DataFrame, lines: DataFrame, max_metres: float = 35.0, max_bearing: float = 45.0) -> DataFrame:
    """Attributes of the nearest line (line_id, line, aadt, route and, where there is one, commercial) of each segment (segment_id, line).

    'matched': of the lines within ``max_metres`` whose local bearing agrees with the segment's within
    ``max_bearing`` degrees, the closest. Bearings are chords of five metres to either side of the
    mutually nearest points. 'nearest': otherwise the closest of all lines, however far, is named with its
    route and distance, but has no aadt; 'missing': there is no line, or the segment has none. Ties go to
    the smaller line_id. Lines of fewer than two points don't count.

    All is found for distinct lines; of equal ones the smallest line_id counts, and equal segments share what is found.
    The first join meets lines within ``max_metres``. For segments that it leaves open, the cells that
    hold any line are looked up around them on all levels of the pyramid at once. In the cells of the first level that
    has one, a piece of a line for each cell of a finer level is measured; the closest bounds the distance, and only lines within that bound are met.
    """
    distinct = shapes(segments, "segment_id")
    ways = lines.where(F.size("line") >= 2).groupBy("line").agg(F.min("line_id").alias("line_id"))
    own = _own(distinct)
    others = pieces(ways, "line_id").withColumnsRenamed({"edge": "b_edge", "lon1": "b_lon1", "lat1": "b_lat1", "lon2": "b_lon2", "lat2": "b_lat2"})
    boxes = {n: f"b_{n}" for n in _BOX}
    side = max(PIECE, 2 * max_metres)
    listed = lambda df, metres: df.withColumn("_cell", cells(metres, "0D"))
    met = _met(listed(_widened(own, f"{1.01 * max_metres + BENT}D"), f"{side}D"), listed(others, f"{side}D").withColumnsRenamed(boxes), "_cell")
    near = met.groupBy("shape", "line_id").agg(F.min_by("near", F.struct(F.col("near.distance"), "a_edge", "b_edge")).alias("near")).where(F.col("near.distance") <= max_metres)
    both = _joined(_joined(near, distinct.select("shape", F.col("line").alias("_a")), "shape"), ways.select("line_id", F.col("line").alias("_b")), "line_id")
    lon0 = central_meridian("_a[0].lon")
    # Each path is measured from the other's nearest point.
    turns = local_bearing(path("_a", lon0), "near.bx", "near.by"), local_bearing(path("_b", lon0), "near.ax", "near.ay")
    gated = both.where(F.expr(bearing_difference(*turns)) <= max_bearing)
    best = F.min(F.struct(F.col("near.distance").alias("distance"), "line_id"))
    matched = gated.groupBy("shape").agg(best.alias("m"))

    # Not an anti-join: it would need other columns of what is matched, which would then be found twice.
    open_ = _joined(own, matched, "shape", "left").where(F.col("m").isNull()).drop("m")
    metres = f"({PIECE}D * power(2, level))"
    leveled = lambda df: df.withColumn("level", F.explode(F.array(*(F.lit(k) for k in (*range(LEVELS), WHOLE)))))
    ring = lambda df: listed(df, metres).withColumn("_cell", F.struct("level", "_cell"))
    around, held = ring(_widened(leveled(open_), metres)), ring(leveled(others))
    first = _joined(around.select("shape", "_cell").distinct(), held.select("_cell").distinct(), "_cell").groupBy("shape").agg(F.min("_cell.level").alias("level"))

    ends = ("b_lon1", "b_lat1", "b_lon2", "b_lat2")
    fine = held.withColumn("_fine", cells(f"({PIECE}D * power(2, greatest(level - {FINER}, 0)))", "0D"))
    samples = fine.groupBy("_cell", "_fine").agg(F.min(F.struct(*ends)).alias("b")).select("_cell", "b.*")
    seen = _met(ring(_widened(_joined(own, first, "shape"), metres)).drop("level"), samples, "_cell", touching=False)
    bound = seen.groupBy("shape").agg(F.min("near.distance").alias("bound"))
    # Eight cells to the bound, or more where it is short.
    level = F.expr(f"CASE WHEN bound > {8 * PIECE * 2 ** (LEVELS - 1)}D THEN {WHOLE} ELSE CAST(greatest(ceil(log2(greatest(bound, 1.0D) / {8 * PIECE}D)), 0L) AS INT) END")
    reach = ring(_widened(_joined(own, bound, "shape").withColumn("level", level), f"1.02D * bound + {PIECE}D"))
    # A cell's lines are dealt over parts, and its segments meet them all.
    reach = reach.drop("bound", "level").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    found = _met(reach, held.drop("level").withColumnsRenamed(boxes).withColumn("_part", F.pmod(F.hash("line_id"), F.lit(PARTS))), "_cell", "_part")
    reported = found.groupBy("shape").agg(best.alias("r"))

    told = _joined(_joined(distinct, matched, "shape", "left"), reported, "shape", "left").select("line", "m", "r")
    known = segments.select("segment_id", F.when(F.col("segment_id").isNotNull(), F.col("line")).alias("line"))
    named = _joined(known, told, "line", "left")
    state = F.when(F.col("m").isNotNull(), "matched").when(F.col("r").isNotNull(), "nearest").otherwise("missing")
    picked = named.select("segment_id", F.coalesce("m.line_id", "r.line_id").alias("line_id"), F.coalesce("m.distance", "r.distance").alias("distance"), state.alias("match"))
    carried = [c for c in ("aadt", "commercial") if c in lines.columns]
    out = _joined(picked, lines.select("line_id", "route", *carried), "line_id", "left")
    return out.select("segment_id", "match", "line_id", "distance", *(F.when(F.col("match") == "matched", F.col(c)).alias(c) for c in carried), "route")
