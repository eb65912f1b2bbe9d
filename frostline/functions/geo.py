"""Geometry: earth-centred coordinates, distances, polygons, WKT and WKB.

A geometry is a struct of its kind and its vertices: parts, rings, points. A point is one part of one ring of
one vertex, a line one part of one ring, a polygon one part of its rings; of several points, lines or
polygons each is a part; of a collection the members' parts follow each other, and members tells each
member's kind and number of parts. An empty geometry has no part. Coordinates are degrees, x the longitude;
further dimensions and reference systems are dropped."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The sphere of earth-centred coordinates, that of great-circle distances, metres of a degree in box searches.
RADIUS, MEAN_RADIUS, DEGREE = 6_371_000.0, 6_371_008.8, 111_320.0

VERTEX = "STRUCT<x: DOUBLE, y: DOUBLE>"
GEOMETRY = f"STRUCT<kind: STRING, parts: ARRAY<ARRAY<ARRAY<{VERTEX}>>>, members: ARRAY<STRUCT<kind: STRING, n: INT>>>"
NO_MEMBERS = "CAST(NULL AS ARRAY<STRUCT<kind: STRING, n: INT>>)"


def ecef(lon: Column, lat: Column) -> list[Column]:
    """Earth-centred x, y, z as 32-bit floats; null for missing coordinates."""
    a, o = F.radians(lat), F.radians(lon)
    return [(F.lit(RADIUS) * F.cos(a) * F.cos(o)).cast("float"), (F.lit(RADIUS) * F.cos(a) * F.sin(o)).cast("float"), (F.lit(RADIUS) * F.sin(a)).cast("float")]


def ecef_of(lat: float, lon: float) -> tuple[float, float, float]:
    a, o = math.radians(lat), math.radians(lon)
    return RADIUS * math.cos(a) * math.cos(o), RADIUS * math.cos(a) * math.sin(o), RADIUS * math.sin(a)


def chord_squared(xyz: list[Column], lat: float, lon: float) -> Column:
    """Square of the straight distance in metres, in 32-bit floats."""
    d = [F.lit(c).cast("float") - x for c, x in zip(ecef_of(lat, lon), xyz, strict=True)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def latitude(z: Column) -> Column:
    return F.degrees(F.asin(z.cast("double") / RADIUS))


def longitude(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(y.cast("double"), x.cast("double")))


def around(lat: float, lon: float, radius: float) -> tuple[float, float, list[tuple[float, float]]]:
    """Latitudes and ranges of longitudes that hold all points within a straight distance, with room for
    the rounding of 32-bit coordinates."""
    angle = 2 * math.asin(min(1.0, (radius + 5) / (2 * RADIUS)))
    low, high = lat - math.degrees(angle), lat + math.degrees(angle)
    if low <= -90 or high >= 90:
        return max(low, -90.0), min(high, 90.0), [(-180.0, 180.0)]
    wide = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat)))))
    west, east = lon - wide, lon + wide
    if west < -180:
        return low, high, [(west + 360, 180.0), (-180.0, east)]
    if east > 180:
        return low, high, [(west, 180.0), (-180.0, east - 360)]
    return low, high, [(west, east)]


def haversine(x: Column, y: Column, lon: float, lat: float) -> Column:
    a = F.radians(y)
    h = F.pow(F.sin((a - math.radians(lat)) / 2), 2) + F.cos(a) * F.lit(math.cos(math.radians(lat))) * F.pow(F.sin(F.radians(x - lon) / 2), 2)
    return F.lit(2 * MEAN_RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def vertices(geometry: Column) -> Column:
    return F.flatten(F.flatten(geometry["parts"]))


def envelope(geometry: Column) -> list[Column]:
    """Least x, least y, greatest x, greatest y."""
    v = vertices(geometry)
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def _sides(ring: Column) -> Column:
    n = F.size(ring)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.element_at(ring, i).alias("p"), F.element_at(ring, i + 1).alias("q")))).otherwise(F.transform(ring, lambda v: F.struct(v.alias("p"), v.alias("q"))))


def _crossings(ring: Column, lon: float, lat: float) -> Column:
    """Sides that a ray to the east from the point crosses."""

    def crossed(side: Column) -> Column:
        p, q = side["p"], side["q"]
        return ((p["y"] > lat) != (q["y"] > lat)) & (F.lit(lon) < (q["x"] - p["x"]) * (F.lit(lat) - p["y"]) / (q["y"] - p["y"]) + p["x"])

    return F.size(F.filter(_sides(ring), crossed))


def contains(geometry: Column, lon: float, lat: float) -> Column:
    """If the point is in a polygon and in none of its holes: an odd number of its sides are crossed."""
    return F.exists(geometry["parts"], lambda polygon: F.aggregate(polygon, F.lit(0), lambda n, ring: n + _crossings(ring, lon, lat)) % 2 == 1)


def boundary_distance(geometry: Column, lon: float, lat: float) -> Column:
    """Great-circle metres to the point of the boundary that is nearest in the plane of degrees."""

    def nearest(side: Column) -> Column:
        p, q = side["p"], side["q"]
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.lit(lon) - p["x"]) * dx + (F.lit(lat) - p["y"]) * dy) / square))).otherwise(0.0)
        x, y = p["x"] + t * dx, p["y"] + t * dy
        return F.struct(((x - lon) * (x - lon) + (y - lat) * (y - lat)).alias("d"), x.alias("x"), y.alias("y"))

    sides = F.flatten(F.transform(F.flatten(geometry["parts"]), _sides))
    best = F.array_min(F.transform(sides, nearest))
    return haversine(best["x"], best["y"], lon, lat)


def polygon_distance(geometry: Column, lon: float, lat: float) -> Column:
    return F.when(contains(geometry, lon, lat), F.lit(0.0)).otherwise(boundary_distance(geometry, lon, lat))


#: Kinds of geometry by their number in well-known binary.
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}
NO_PARTS = f"CAST(array() AS ARRAY<ARRAY<ARRAY<{VERTEX}>>>)"


def _parts(text: str, kind: str) -> str:
    """SQL for the parts of a geometry that is no collection. text: SQL for its well-known text, blanks around brackets
    and commas taken out."""
    body = f"regexp_replace({text}, '^[^(]*\\\\(|\\\\)$', '')"

    def vertex(v: str) -> str:
        return f"named_struct('x', CAST(split({v}, ' +')[0] AS DOUBLE), 'y', CAST(split({v}, ' +')[1] AS DOUBLE))"

    def ring(s: str) -> str:
        return f"transform(split(regexp_replace({s}, '^\\\\(|\\\\)$', ''), ','), v -> {vertex('v')})"

    def rings(s: str) -> str:
        return f"transform(split({s}, '(?<=\\\\)),(?=\\\\()'), ring -> {ring('ring')})"

    some = {
        "POINT": f"array(array({ring(body)}))",
        "LINESTRING": f"array(array({ring(body)}))",
        "POLYGON": f"array({rings(body)})",
        "MULTIPOINT": f"transform(filter(split({body}, ','), m -> NOT upper(m) LIKE '%EMPTY'), m -> array({ring('m')}))",
        "MULTILINESTRING": f"transform({rings(body)}, line -> array(line))",
        "MULTIPOLYGON": f"transform(split({body}, '(?<=\\\\)\\\\)),(?=\\\\(\\\\()'), polygon -> {rings("regexp_replace(polygon, '^\\\\(|\\\\)$', '')")})",
    }
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in some.items())
    return f"CASE WHEN upper({text}) LIKE '%EMPTY' THEN {NO_PARTS} ELSE CASE {kind} {cases} END END"


def _from_text() -> str:
    """SQL for the geometry of a well-known text; text that is none is an error that names it."""
    number = r"[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?"
    vertices = rf"{number}(?: {number}){{1,3}}(?:,{number}(?: {number}){{1,3}})*+"
    line, points = rf"\\({vertices}\\)", rf"(?:\\({number}(?: {number}){{1,3}}\\)|{number}(?: {number}){{1,3}}|EMPTY)"
    polygon = rf"\\({line}(?:,{line})*+\\)"
    shape = "(?:" + "|".join([
        rf"POINT(?: ?Z?M?)(?:\\({number}(?: {number}){{1,3}}\\)| ?EMPTY)", rf"LINESTRING(?: ?Z?M?)(?:{line}| ?EMPTY)", rf"POLYGON(?: ?Z?M?)(?:{polygon}| ?EMPTY)",
        rf"MULTIPOINT(?: ?Z?M?)(?:\\({points}(?:,{points})*+\\)| ?EMPTY)", rf"MULTILINESTRING(?: ?Z?M?)(?:\\({line}(?:,{line})*+\\)| ?EMPTY)", rf"MULTIPOLYGON(?: ?Z?M?)(?:\\({polygon}(?:,{polygon})*+\\)| ?EMPTY)",
    ]) + ")"
    whole = rf"(?i)^(?:{shape}|GEOMETRYCOLLECTION(?: ?Z?M?)(?:\\({shape}(?:,{shape})*+\\)| ?EMPTY))$"

    def kind(t: str) -> str:
        return f"upper(regexp_extract({t}, '^(?i)(MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|POINT|LINESTRING|POLYGON|GEOMETRYCOLLECTION)', 1))"

    body = "regexp_replace(t, '^[^(]*\\\\(|\\\\)$', '')"
    members = f"CASE WHEN upper(t) RLIKE '^[A-Z ]+EMPTY$' THEN CAST(array() AS ARRAY<STRING>) ELSE split({body}, ',(?=[A-Za-z])(?!(?i)EMPTY)') END"
    of_members = f"transform({members}, t -> named_struct('kind', {kind('t')}, 'parts', {_parts('t', kind('t'))}))"
    one = f"named_struct('kind', {kind('t')}, 'parts', {_parts('t', kind('t'))}, 'members', {NO_MEMBERS})"
    many = f"transform(array({of_members}), m -> named_struct('kind', 'GEOMETRYCOLLECTION', 'parts', coalesce(flatten(transform(m, x -> x.parts)), {NO_PARTS}), 'members', transform(m, x -> named_struct('kind', x.kind, 'n', size(x.parts)))))[0]"
    plain = "trim(regexp_replace(regexp_replace(regexp_replace(wkt, '^\\\\s*(?i)SRID\\\\s*=\\\\s*\\\\d+\\\\s*;', ''), '\\\\s+', ' '), ' ?([(),]) ?', '$1'))"
    told = f"CASE WHEN NOT t RLIKE '{whole}' THEN CAST(raise_error(concat('this is no well-known text: ', t)) AS {GEOMETRY}) WHEN {kind('t')} = 'GEOMETRYCOLLECTION' THEN {many} ELSE {one} END"
    return f"CASE WHEN wkt IS NOT NULL THEN transform(array({plain}), t -> {told})[0] END"


#: SQL functions for source queries. Names follow the usual spatial SQL.
SQL_FUNCTIONS = {
    "st_point(x DOUBLE, y DOUBLE)": (GEOMETRY, f"CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN named_struct('kind', 'POINT', 'parts', array(array(array(named_struct('x', x, 'y', y)))), 'members', {NO_MEMBERS}) END"),
    "st_geomfromtext(wkt STRING)": (GEOMETRY, _from_text()),
    f"st_x(g {GEOMETRY})": ("DOUBLE", "g.parts[0][0][0].x"),
    f"st_y(g {GEOMETRY})": ("DOUBLE", "g.parts[0][0][0].y"),
    f"st_geometrytype(g {GEOMETRY})": ("STRING", "g.kind"),
} | {f"st_{axis}{m}(g {GEOMETRY})": ("DOUBLE", f"array_{m}(transform(flatten(flatten(g.parts)), v -> v.{axis}))") for m in ("min", "max") for axis in "xy"}


def register(spark: SparkSession) -> None:
    for signature, (kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    spark.udf.register("st_aswkb", F.udf(to_wkb, "binary", useArrow=True))
    spark.udf.register("st_geomfromwkb", F.udf(from_wkb, GEOMETRY, useArrow=True))


def from_wkb(data: bytes | None) -> dict | None:
    """A geometry from well-known binary, of any byte order; further dimensions are dropped. A collection takes in the
    members of the collections within it, at any depth."""
    if data is None:
        return None
    geometry, _ = _read_wkb(bytes(data), 0)
    return geometry


def to_wkb(geometry: object) -> bytes | None:
    """Well-known binary, little-endian, of a geometry."""
    if geometry is None:
        return None
    kind, parts, members = geometry["kind"], geometry["parts"], geometry["members"]
    number = next(n for n, k in KINDS.items() if k == kind)
    head = struct.pack("<BI", 1, number)

    def line(ring: list) -> bytes:
        return struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", v["x"], v["y"]) for v in ring)

    if kind == "POINT":
        return head + (struct.pack("<dd", parts[0][0][0]["x"], parts[0][0][0]["y"]) if parts else struct.pack("<dd", math.nan, math.nan))
    if kind == "LINESTRING":
        return head + (line(parts[0][0]) if parts else struct.pack("<I", 0))
    if kind == "POLYGON":
        return head + (struct.pack("<I", len(parts[0])) + b"".join(map(line, parts[0])) if parts else struct.pack("<I", 0))
    if kind == "GEOMETRYCOLLECTION":
        ends = [0]
        for m in members:
            ends.append(ends[-1] + m["n"])
        own = [{"kind": m["kind"], "parts": parts[a:b], "members": None} for m, a, b in zip(members, ends, ends[1:], strict=False)]
    else:
        own = [{"kind": kind.removeprefix("MULTI"), "parts": [p], "members": None} for p in parts]
    return head + struct.pack("<I", len(own)) + b"".join(map(to_wkb, own))


def _read_wkb(data: bytes, at: int) -> tuple[dict, int]:
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    width = 2 + bool(code & 0x80000000 or code % 0x10000000 // 1000 in (1, 3)) + bool(code & 0x40000000 or code % 0x10000000 // 1000 in (2, 3))
    kind = code & 0xFFFF if code & 0xE0000000 else code % 1000

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        return n

    def line(n: int) -> list[dict]:
        nonlocal at
        out = [dict(zip("xy", struct.unpack_from(order + "dd", data, at + 8 * width * k), strict=True)) for k in range(n)]
        at += 8 * width * n
        return out

    def shape(parts: list, members: list | None = None) -> tuple[dict, int]:
        return {"kind": KINDS[kind], "parts": [p for p in parts if p and p[0]], "members": members}, at

    if kind == 1:
        place = line(1)
        return shape([] if math.isnan(place[0]["x"]) else [[place]])
    if kind == 2:
        return shape([[line(count())]])
    if kind == 3:
        return shape([[line(count()) for _ in range(count())]])
    if kind not in KINDS:
        raise ValueError(f"geometry type {kind} is not supported")
    parts, members = [], []
    for _ in range(count()):
        one, at = _read_wkb(data, at)
        parts += one["parts"]
        members += [{"kind": one["kind"], "n": len(one["parts"])}] if one["members"] is None else one["members"]
    return shape(parts, members if kind == 7 else None)


def geometry_from_wkb(column: Column) -> Column:
    @F.udf(GEOMETRY, useArrow=True)
    def read(data: bytes | None) -> dict | None:
        return from_wkb(data)

    return read(column)


def geojson(geometry: Column) -> Column:
    """The geometry as GeoJSON; an empty one has no coordinates."""

    def place(v: Column) -> Column:
        return F.array(v["x"], v["y"])

    def text(coordinates: Column) -> Column:
        return F.to_json(coordinates)

    def coordinates(kind: Column, polygons: Column) -> Column:
        parts = F.transform(polygons, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, place)))
        one = {"POINT": parts[0][0][0], "LINESTRING": parts[0][0], "POLYGON": parts[0], "MULTIPOINT": F.transform(parts, lambda p: p[0][0]), "MULTILINESTRING": F.transform(parts, lambda p: p[0])}
        out = text(parts)
        for name, value in one.items():
            out = F.when(kind == name, text(value)).otherwise(out)
        return F.when(F.size(polygons) == 0, F.lit("[]")).otherwise(out)

    def shape(kind: Column, polygons: Column) -> Column:
        shown = F.lit(None).cast("string")
        for name, title in SHOWN.items():
            shown = F.when(kind == name, title).otherwise(shown)
        return F.concat(F.lit('{"type":"'), shown, F.lit('","coordinates":'), coordinates(kind, polygons), F.lit("}"))

    def member(m: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(geometry["members"], F.lit(1), i), F.lit(0), lambda a, x: a + x["n"])
        return shape(m["kind"], F.slice(geometry["parts"], before + 1, m["n"]))

    collection = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(F.transform(geometry["members"], member), ","), F.lit("]}"))
    whole = F.when(geometry["kind"] == "GEOMETRYCOLLECTION", collection).otherwise(shape(geometry["kind"], geometry["parts"]))
    return F.when(geometry.isNotNull(), whole)


#: Kinds of geometry as GeoJSON calls them.
SHOWN = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
