"""Spatial conditions and distances. Points use straight distances between earth-centred 32-bit
coordinates; polygons great-circle distances to their boundary, 0 inside. Each exact test comes with
plain comparisons of latitude and longitude or of the envelope, which push down to the scan and prune
row groups, as the stage is sorted by them. Rows without geometry match no spatial condition."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from frostline.functions import geo

#: Half the side in degrees of the box that a centre without a radius looks polygons up in.
LOOKUP = 1e-4
CELL_LIMIT = 64


def cell_step(resolution: int) -> float:
    """Degrees to a side of a grid cell; each resolution has cells of half the side."""
    return 45.0 / 2**resolution


def cell(lon: Column, lat: Column, resolution: int) -> Column:
    step = cell_step(resolution)
    return F.floor((lat + 90) / step) * math.ceil(360 / step + 1) + F.floor((lon + 180) / step)


def covering(low: float, high: float, west: float, east: float, resolution: int) -> list[int] | None:
    """Cells that hold a box, or None if they are too many to list."""
    step = cell_step(resolution)
    rows = range(math.floor((low + 90) / step), math.floor((high + 90) / step) + 1)
    cols = range(math.floor((west + 180) / step), math.floor((east + 180) / step) + 1)
    if len(rows) * len(cols) > CELL_LIMIT:
        return None
    return [r * math.ceil(360 / step + 1) + c for r in rows for c in cols]


def xyz() -> list[Column]:
    return [F.col("_ex"), F.col("_ey"), F.col("_ez")]


def point_in_box(box: tuple[float, float, float, float]) -> Column:
    min_lon, min_lat, max_lon, max_lat = box
    return F.col("_lat").between(min_lat, max_lat) & F.col("_lon").between(min_lon, max_lon)


def point_in_radius(lat: float, lon: float, radius: float, resolution: int) -> Column:
    low, high, ranges = geo.around(lat, lon, radius)
    near = F.col("_lat").between(low, high) & reduce(Column.__or__, (F.col("_lon").between(w, e) for w, e in ranges))
    cells = [covering(low, high, w, e, resolution) for w, e in ranges]
    if all(c is not None for c in cells):
        near = near & F.col("_cell").isin(*(x for c in cells for x in c))
    limit = F.lit(radius).cast("float") * F.lit(radius).cast("float")
    return near & (geo.chord_squared(xyz(), lat, lon) <= limit)


def point_distance(lat: float, lon: float, single: bool = True) -> Column:
    """Metres; the root is taken in 32 bits, or in 64 of the 32-bit square."""
    square = geo.chord_squared(xyz(), lat, lon)
    return F.sqrt(square).cast("float").cast("double") if single else F.sqrt(square.cast("double"))


def envelope_meets(box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return (F.col("_xmin") <= east) & (F.col("_xmax") >= west) & (F.col("_ymin") <= north) & (F.col("_ymax") >= south)


def polygon_box(lat: float, lon: float, radius: float | None) -> tuple[float, float, float, float]:
    if radius is None:
        return lon - LOOKUP, lat - LOOKUP, lon + LOOKUP, lat + LOOKUP
    high = radius / geo.DEGREE
    wide = radius / (geo.DEGREE * math.cos(math.radians(lat)))
    return lon - wide, lat - high, lon + wide, lat + high


def polygon_distance(lat: float, lon: float) -> Column:
    return geo.polygon_distance(F.col("_geom"), lon, lat)
