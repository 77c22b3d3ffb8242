"""Planar geometry as struct columns.

A geometry is ``STRUCT<type STRING, srid INT, rings ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>>``:
a point is one ring of one vertex, a line one ring, a polygon an outer ring followed by its
holes. Predicates are SQL expressions over higher-order array functions, so they run in the
JVM and need no Python worker. Arithmetic is plain double precision.

Every function exists as a column function here and, after ``register(spark)``, as a SQL
function of the same name (``pg_st_setsrid`` for ``st_setsrid``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

GEOMETRY_TYPE = "struct<type:string,srid:int,rings:array<array<struct<x:double,y:double>>>>"
WGS84 = 4326
WEB_MERCATOR = 3857
EARTH_RADIUS = 6378137.0


# --- SQL text of the building blocks ------------------------------------------------
# Lambda variable names are unique along every nesting path.


def _first(g: str) -> str:
    return f"get(get({g}.rings, 0), 0)"


def _bound(g: str, axis: str, pick: str) -> str:
    return (
        f"CASE WHEN {g}.type = 'Point' THEN {_first(g)}.{axis} "
        f"ELSE {pick}(transform(flatten({g}.rings), v -> v.{axis})) END"
    )


def _edges(rings: str) -> str:
    """All segments of all rings; a lone vertex gives one degenerate segment."""
    ends = "'ax', get(r, i - 1).x, 'ay', get(r, i - 1).y, 'bx', get(r, least(i, size(r) - 1)).x, 'by', get(r, least(i, size(r) - 1)).y"
    return f"flatten(transform({rings}, r -> transform(sequence(1, greatest(size(r) - 1, 1)), i -> named_struct({ends}))))"


def _side(e: str, px: str, py: str) -> str:
    return f"(({e}.bx - {e}.ax) * ({py} - {e}.ay) - ({e}.by - {e}.ay) * ({px} - {e}.ax))"


def _on_segment(px: str, py: str, e: str) -> str:
    return (
        f"({px} BETWEEN least({e}.ax, {e}.bx) AND greatest({e}.ax, {e}.bx) AND "
        f"{py} BETWEEN least({e}.ay, {e}.by) AND greatest({e}.ay, {e}.by) AND {_side(e, px, py)} = 0)"
    )


def _on_boundary(px: str, py: str, edges: str) -> str:
    return f"exists({edges}, ob -> {_on_segment(px, py, 'ob')})"


def _locate(px: str, py: str, edges: str) -> str:
    """0 outside, 1 inside, 2 on the boundary; even-odd over every ring, so holes are outside."""
    straddles = f"(le.ay > {py}) != (le.by > {py})"
    crosses = f"{px} < (le.bx - le.ax) * ({py} - le.ay) / (le.by - le.ay) + le.ax"
    step = (
        f"CASE WHEN at = 2 OR {_on_segment(px, py, 'le')} THEN 2 "
        f"WHEN {straddles} THEN CASE WHEN {crosses} THEN 1 - at ELSE at END ELSE at END"
    )
    return f"aggregate({edges}, 0, (at, le) -> {step})"


def _meet(e: str, f: str) -> str:
    ends_on = " OR ".join(
        [
            _on_segment(f"{f}.ax", f"{f}.ay", e),
            _on_segment(f"{f}.bx", f"{f}.by", e),
            _on_segment(f"{e}.ax", f"{e}.ay", f),
            _on_segment(f"{e}.bx", f"{e}.by", f),
        ]
    )
    cross = (
        f"signum({_side(e, f'{f}.ax', f'{f}.ay')}) * signum({_side(e, f'{f}.bx', f'{f}.by')}) < 0 AND "
        f"signum({_side(f, f'{e}.ax', f'{e}.ay')}) * signum({_side(f, f'{e}.bx', f'{e}.by')}) < 0"
    )
    return f"(({cross}) OR {ends_on})"


def _let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once per row and use it as ``name`` inside ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _overlap(a: str, b: str) -> str:
    return " AND ".join(
        [
            f"{_bound(a, 'x', 'array_min')} <= {_bound(b, 'x', 'array_max')}",
            f"{_bound(a, 'x', 'array_max')} >= {_bound(b, 'x', 'array_min')}",
            f"{_bound(a, 'y', 'array_min')} <= {_bound(b, 'y', 'array_max')}",
            f"{_bound(a, 'y', 'array_max')} >= {_bound(b, 'y', 'array_min')}",
        ]
    )


# --- SQL text of the predicates over s.a and s.b ------------------------------------


def _point_meets(point: str, other: str, edges: str) -> str:
    area = f"{_locate('p.x', 'p.y', 'es')} > 0"
    body = f"CASE WHEN {other}.type = 'Polygon' THEN {area} ELSE {_on_boundary('p.x', 'p.y', 'es')} END"
    return _let(_first(point), "p", _let(edges, "es", body))


def _both(ea: str, eb: str) -> str:
    return f"named_struct('a', {ea}, 'b', {eb})"


def _intersects_sql(a: str, b: str, ea: str, eb: str) -> str:
    general = _let(
        _both(ea, eb),
        "g",
        f"exists(g.a, e -> exists(g.b, f -> {_meet('e', 'f')}))"
        f" OR ({b}.type = 'Polygon' AND {_locate(f'{_first(a)}.x', f'{_first(a)}.y', 'g.b')} > 0)"
        f" OR ({a}.type = 'Polygon' AND {_locate(f'{_first(b)}.x', f'{_first(b)}.y', 'g.a')} > 0)",
    )
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a}.type = 'Point' THEN {_point_meets(a, b, eb)} "
        f"WHEN {b}.type = 'Point' THEN {_point_meets(b, a, ea)} WHEN {_overlap(a, b)} THEN {general} ELSE false END"
    )


def _point_within(a: str, b: str, eb: str) -> str:
    last = f"element_at(get({b}.rings, 0), -1)"
    same = lambda q, r: f"({q}.x = {r}.x AND {q}.y = {r}.y)"
    is_end = f"(NOT {same(_first(b), last)} AND ({same('p', _first(b))} OR {same('p', last)}))"
    area = _let(eb, "es", f"{_locate('p.x', 'p.y', 'es')} = 1")
    body = (
        f"CASE WHEN {b}.type = 'Point' THEN {same('p', _first(b))} "
        f"WHEN {b}.type = 'LineString' THEN NOT {is_end} AND {_on_boundary('p.x', 'p.y', eb)} ELSE {area} END"
    )
    return _let(_first(a), "p", body)


def _cuts(e: str, f: str) -> str:
    """Positions along ``e`` where segment ``f`` crosses it or ends on it."""
    dx, dy, gx, gy = f"({e}.bx - {e}.ax)", f"({e}.by - {e}.ay)", f"({f}.bx - {f}.ax)", f"({f}.by - {f}.ay)"
    det, length2 = f"({dx} * {gy} - {dy} * {gx})", f"({dx} * {dx} + {dy} * {dy})"
    along = lambda x, y: f"(({x} - {e}.ax) * {dx} + ({y} - {e}.ay) * {dy}) / {length2}"
    return (
        f"CASE WHEN {det} != 0 THEN array((({f}.ax - {e}.ax) * {gy} - ({f}.ay - {e}.ay) * {gx}) / {det}) "
        f"WHEN {length2} != 0 THEN array({along(f'{f}.ax', f'{f}.ay')}, {along(f'{f}.bx', f'{f}.by')}) "
        "ELSE CAST(array() AS array<double>) END"
    )


def _piece_middles(e: str, edges: str) -> str:
    """Midpoints of the pieces of ``e`` after cutting it at every segment of ``edges``."""
    cuts = f"filter(flatten(transform({edges}, cf -> {_cuts(e, 'cf')})), t -> t > 0 AND t < 1)"
    marks = f"array_sort(array_distinct(concat(array(0D, 1D), {cuts})))"
    at = lambda axis: f"{e}.a{axis} + ({e}.b{axis} - {e}.a{axis}) * (get(m, k - 1) + get(m, k)) / 2"
    middles = f"transform(sequence(1, size(m) - 1), k -> named_struct('x', {at('x')}, 'y', {at('y')}))"
    return _let(marks, "m", middles)


def _inner_point(ring: str) -> str:
    """A point strictly inside a ring: on a scan line between its two lowest vertex heights."""
    crossing = "(ix.bx - ix.ax) * (iy - ix.ay) / (ix.by - ix.ay) + ix.ax"
    cut = f"filter({_edges(f'array({ring})')}, ic -> (ic.ay > iy) != (ic.by > iy))"
    xs = f"array_sort(transform({cut}, ix -> {crossing}))"
    at = _let(xs, "xs", "named_struct('x', (get(xs, 0) + get(xs, 1)) / 2, 'y', iy)")
    heights = f"array_sort(array_distinct(transform({ring}, iv -> iv.y)))"
    return _let(_let(heights, "hs", "(get(hs, 0) + get(hs, 1)) / 2"), "iy", at)


def _pieces_within(a: str, b: str, ea: str, eb: str) -> str:
    """Lines and polygons: every piece of ``a`` between crossings with ``b`` lies in ``b``."""
    covered = f"forall(mid, q -> {_locate('q.x', 'q.y', 'g.b')} > 0)"
    reaches = f"exists(mid, q -> {_locate('q.x', 'q.y', 'g.b')} = 1)"
    on_line = f"forall(mid, q -> {_on_boundary('q.x', 'q.y', 'g.b')})"
    # With the boundary of ``a`` in ``b``, a hole lies in ``a`` wholly or not at all: one inner point decides.
    holes = f"slice({b}.rings, 2, greatest(size({b}.rings) - 1, 0))"
    hole_in_a = f"exists({holes}, h -> {_let(_inner_point('h'), 'hp', 'coalesce(' + _locate('hp.x', 'hp.y', 'g.a') + ' = 1, false)')})"
    judged = (
        f"CASE WHEN {a}.type = 'LineString' AND {b}.type = 'Polygon' THEN {covered} AND {reaches} "
        f"WHEN {a}.type = 'LineString' THEN {on_line} "
        f"WHEN {b}.type = 'Polygon' THEN {covered} AND NOT {hole_in_a} ELSE false END"
    )
    middles = f"flatten(transform(g.a, e -> {_piece_middles('e', 'g.b')}))"
    return _let(_both(ea, eb), "g", _let(middles, "mid", judged))


def _within_sql(a: str, b: str, ea: str, eb: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a}.type = 'Point' THEN {_point_within(a, b, eb)} "
        f"WHEN {b}.type = 'Point' THEN false WHEN {_overlap(a, b)} THEN {_pieces_within(a, b, ea, eb)} ELSE false END"
    )


def _segment_distance2(px: str, py: str, e: str) -> str:
    dx, dy = f"({e}.bx - {e}.ax)", f"({e}.by - {e}.ay)"
    length2 = f"({dx} * {dx} + {dy} * {dy})"
    t = f"greatest(0D, least(1D, (({px} - {e}.ax) * {dx} + ({py} - {e}.ay) * {dy}) / {length2}))"
    position = f"CASE WHEN {length2} = 0 THEN 0D ELSE {t} END"
    square = f"pow({px} - ({e}.ax + u * {dx}), 2) + pow({py} - ({e}.ay + u * {dy}), 2)"
    return _let(position, "u", square)


def _point_distance(point: str, other: str, edges: str) -> str:
    nearest = f"sqrt(array_min(transform(es, e -> {_segment_distance2('p.x', 'p.y', 'e')})))"
    body = f"CASE WHEN {other}.type = 'Polygon' AND {_locate('p.x', 'p.y', 'es')} > 0 THEN 0D ELSE {nearest} END"
    return _let(_first(point), "p", _let(edges, "es", body))


def _distance_sql(a: str, b: str, ea: str, eb: str) -> str:
    pair = ", ".join(
        [
            _segment_distance2("f.ax", "f.ay", "e"),
            _segment_distance2("f.bx", "f.by", "e"),
            _segment_distance2("e.ax", "e.ay", "f"),
            _segment_distance2("e.bx", "e.by", "f"),
        ]
    )
    general = _let(
        _both(ea, eb),
        "g",
        f"sqrt(array_min(transform(g.a, e -> array_min(transform(g.b, f -> least({pair}))))))",
    )
    points = f"sqrt(pow({_first(a)}.x - {_first(b)}.x, 2) + pow({_first(a)}.y - {_first(b)}.y, 2))"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a}.type = 'Point' AND {b}.type = 'Point' THEN {points} "
        f"WHEN {a}.type = 'Point' THEN {_point_distance(a, b, eb)} WHEN {b}.type = 'Point' THEN {_point_distance(b, a, ea)} "
        f"WHEN {_intersects_sql(a, b, ea, eb)} THEN 0D ELSE {general} END"
    )


def _transform_sql(g: str, srid: str) -> str:
    radius, quarter, half = f"{EARTH_RADIUS}D", f"{math.pi / 4!r}D", f"{math.pi / 2!r}D"
    moved = lambda x, y: f"transform({g}.rings, r -> transform(r, v -> named_struct('x', {x}, 'y', {y})))"
    forward = moved(f"radians(v.x) * {radius}", f"ln(tan({quarter} + radians(v.y) / 2)) * {radius}")
    backward = moved(f"degrees(v.x / {radius})", f"degrees(atan(exp(v.y / {radius})) * 2 - {half})")
    built = lambda rings: f"named_struct('type', {g}.type, 'srid', CAST({srid} AS int), 'rings', {rings})"
    return (
        f"CASE WHEN {g} IS NULL THEN NULL WHEN {g}.srid = {srid} THEN {g} "
        f"WHEN {g}.srid = {WGS84} AND {srid} = {WEB_MERCATOR} THEN {built(forward)} "
        f"WHEN {g}.srid = {WEB_MERCATOR} AND {srid} = {WGS84} THEN {built(backward)} "
        f"ELSE CAST(raise_error('unsupported reprojection ' || {g}.srid || ' -> ' || {srid}) AS {GEOMETRY_TYPE}) END"
    )


def _from_geojson_sql(text: str, srid: int) -> str:
    coords = f"get_json_object({text}, '$.coordinates')"
    kind = f"get_json_object({text}, '$.type')"
    pair = lambda p: f"named_struct('x', CAST(get({p}, 0) AS double), 'y', CAST(get({p}, 1) AS double))"
    rings = (
        f"CASE {kind} WHEN 'Point' THEN array(array({pair(f'''from_json({coords}, 'array<double>')''')})) "
        f"WHEN 'LineString' THEN array(transform(from_json({coords}, 'array<array<double>>'), p -> {pair('p')})) "
        f"WHEN 'Polygon' THEN transform(from_json({coords}, 'array<array<array<double>>>'), r -> transform(r, p -> {pair('p')})) END"
    )
    return _let(rings, "rs", f"CASE WHEN rs IS NOT NULL THEN named_struct('type', {kind}, 'srid', {srid}, 'rings', rs) END")


def _as_geojson_sql(g: str) -> str:
    pairs = f"transform({g}.rings, r -> transform(r, v -> array(v.x, v.y)))"
    doc = lambda c: f"to_json(named_struct('type', {g}.type, 'coordinates', {c}))"
    return _let(
        pairs,
        "ps",
        f"CASE {g}.type WHEN 'Point' THEN {doc('get(get(ps, 0), 0)')} WHEN 'LineString' THEN {doc('get(ps, 0)')} "
        f"WHEN 'Polygon' THEN {doc('ps')} END",
    )


# --- column functions ---------------------------------------------------------------


def _bind(text: str, **columns: Column) -> Column:
    """Evaluate the columns once per row into ``s`` and compute ``text`` over it."""
    bound = F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))
    return F.get(F.call_function("transform", bound, F.expr(f"s -> {text}")), F.lit(0))


def _same_srid(a: str, b: str, body: str, returns: str) -> str:
    """``body``, failing for geometries of different reference systems, whose coordinates mean different things."""
    wrong = f"raise_error('geometries of SRID ' || {a}.srid || ' and ' || {b}.srid || ' do not compare')"
    return f"CASE WHEN {a}.srid <> {b}.srid THEN CAST({wrong} AS {returns}) ELSE {body} END"


def _bind_pair(sql: Callable[[str, str, str, str], str], a: Column, b: Column, returns: str = "boolean") -> Column:
    """Predicate over two geometries; the segments of a polygon constant are constants too."""
    sides = {"a": a, "b": b}
    segments = {f"e{k}": g.__dict__["_segments"] for k, g in sides.items() if "_segments" in g.__dict__}
    text = lambda k: f"s.e{k}" if f"e{k}" in segments else _edges(f"s.{k}.rings")
    return _bind(_same_srid("s.a", "s.b", sql("s.a", "s.b", text("a"), text("b")), returns), **sides, **segments)


def _vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _geometry(kind: str, srid: int, rings: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(srid).cast("int").alias("srid"), rings.alias("rings"))


def st_point(x: Column, y: Column, srid: int = 0) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), _geometry("Point", srid, F.array(F.array(_vertex(x, y)))))


def st_makebox(xmin: Column, ymin: Column, xmax: Column, ymax: Column, srid: int = WGS84) -> Column:
    """Axis-aligned rectangle polygon from its corners."""
    corners = ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin))
    return _geometry("Polygon", srid, F.array(F.array(*[_vertex(x, y) for x, y in corners])))


def polygon(rings: list[list[tuple[float, float]]], srid: int = WGS84) -> Column:
    """Polygon constant from closed rings of ``(x, y)`` pairs; the optimizer folds it to a literal."""
    listed = [F.array(*[_vertex(F.lit(float(x)), F.lit(float(y))) for x, y in ring]) for ring in rings]
    constant = _geometry("Polygon", srid, F.array(*listed))
    ends = [(*p, *q) for ring in rings for p, q in zip(ring, ring[1:])]
    named = [F.struct(*[F.lit(float(v)).alias(k) for v, k in zip(e, ("ax", "ay", "bx", "by"))]) for e in ends]
    constant.__dict__["_segments"] = F.array(*named)
    return constant


def st_geomfromgeojson(text: Column, srid: int = WGS84) -> Column:
    """GeoJSON ``Point``, ``LineString`` or ``Polygon`` text; NULL for anything else."""
    return _bind(_from_geojson_sql("s.j", srid), j=text)


def st_asgeojson(geom: Column) -> Column:
    """GeoJSON text of a geometry column."""
    return _bind(_as_geojson_sql("s.g"), g=geom)


def st_setsrid(geom: Column, srid: int) -> Column:
    return geom.withField("srid", F.lit(srid).cast("int"))


def st_xmin(geom: Column) -> Column:
    return _bind(_bound("s.g", "x", "array_min"), g=geom)


def st_xmax(geom: Column) -> Column:
    return _bind(_bound("s.g", "x", "array_max"), g=geom)


def st_ymin(geom: Column) -> Column:
    return _bind(_bound("s.g", "y", "array_min"), g=geom)


def st_ymax(geom: Column) -> Column:
    return _bind(_bound("s.g", "y", "array_max"), g=geom)


def st_extent(geom: Column) -> Column:
    """Aggregate bounding box; NULL over no geometries."""
    box = F.struct(
        F.min(st_xmin(geom)).alias("xmin"),
        F.min(st_ymin(geom)).alias("ymin"),
        F.max(st_xmax(geom)).alias("xmax"),
        F.max(st_ymax(geom)).alias("ymax"),
    )
    return F.when(F.count(geom) > 0, box)


def st_intersects(a: Column, b: Column) -> Column:
    """The geometries share at least one point; touching boundaries count."""
    return _bind_pair(_intersects_sql, a, b)


def st_within(a: Column, b: Column) -> Column:
    """``a`` lies in ``b`` and their interiors meet; lying only on the boundary does not count."""
    return _bind_pair(_within_sql, a, b)


def st_contains(a: Column, b: Column) -> Column:
    return st_within(b, a)


def st_distance(a: Column, b: Column) -> Column:
    """Planar distance; zero when the geometries intersect."""
    return _bind_pair(_distance_sql, a, b, "double")


def st_transform(geom: Column, srid: int) -> Column:
    """Reproject between WGS 84 (4326) and Web Mercator (3857); other systems raise."""
    if srid not in (WGS84, WEB_MERCATOR):
        raise ValueError(f"unsupported target SRID {srid}")
    return _bind(_transform_sql("s.g", str(srid)), g=geom)


# --- SQL functions ------------------------------------------------------------------


def register(spark: SparkSession) -> None:
    """Create the geometry functions as temporary SQL functions of the session."""
    g, two = f"g {GEOMETRY_TYPE}", f"a {GEOMETRY_TYPE}, b {GEOMETRY_TYPE}"
    vertex = "named_struct('x', x, 'y', y)"
    point = f"named_struct('type', 'Point', 'srid', 0, 'rings', array(array({vertex})))"
    ea, eb = _edges("a.rings"), _edges("b.rings")
    definitions = {
        "st_point": ("x double, y double", GEOMETRY_TYPE, f"CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN {point} END"),
        # Spark keeps ``st_setsrid`` for its own geometry type, so the SQL name carries a prefix.
        "pg_st_setsrid": (
            f"{g}, srid int",
            GEOMETRY_TYPE,
            "CASE WHEN g IS NOT NULL THEN named_struct('type', g.type, 'srid', srid, 'rings', g.rings) END",
        ),
        "st_geomfromgeojson": ("j string", GEOMETRY_TYPE, _from_geojson_sql("j", WGS84)),
        "st_asgeojson": (g, "string", _as_geojson_sql("g")),
        "st_xmin": (g, "double", _bound("g", "x", "array_min")),
        "st_ymin": (g, "double", _bound("g", "y", "array_min")),
        "st_xmax": (g, "double", _bound("g", "x", "array_max")),
        "st_ymax": (g, "double", _bound("g", "y", "array_max")),
        "st_intersects": (two, "boolean", _same_srid("a", "b", _intersects_sql("a", "b", ea, eb), "boolean")),
        "st_within": (two, "boolean", _same_srid("a", "b", _within_sql("a", "b", ea, eb), "boolean")),
        "st_contains": (two, "boolean", _same_srid("a", "b", _within_sql("b", "a", eb, ea), "boolean")),
        "st_distance": (two, "double", _same_srid("a", "b", _distance_sql("a", "b", ea, eb), "double")),
        "st_transform": (f"{g}, srid int", GEOMETRY_TYPE, _transform_sql("g", "srid")),
    }
    for name, (arguments, returns, body) in definitions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
