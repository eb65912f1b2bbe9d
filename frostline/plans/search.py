"""Search: text and attribute conditions and a box or radius, all joined by AND; then the first rows of each
group or overall, by distance or id. One lazy DataFrame: conditions reach the scan, nothing is collected."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions import geo
from frostline.operators import filters, ranking, spatial, text
from frostline.plans.stage import POINT, POLYGON, Staged

Number = float | int | str | None
log = logging.getLogger(__name__)


def number(value: Number) -> float | None:
    """A parameter as a number; what can't be read counts as missing."""
    try:
        return None if value is None else float(value)
    except ValueError:
        return None


def whole(value: Number) -> int | None:
    """A limit; only digits are one."""
    return int(value) if value is not None and re.fullmatch(r"\d+", str(value)) else None


def matches(
    staged: Staged, q: str | None = None, filter_by: str | None = None, lat: Number = None, lon: Number = None, radius: Number = None,
    min_lat: Number = None, min_lon: Number = None, max_lat: Number = None, max_lon: Number = None, single: bool = True,
) -> tuple[DataFrame, bool]:
    """All rows that meet the conditions, with __distance (0 without a centre); if distances order them. A centre
    needs both lat and lon, a box all four sides, a radius a centre. Rows without geometry meet no box or centre."""
    p, rows, geometry = staged.profile, staged.rows, staged.geometry
    lat, lon, radius = number(lat), number(lon), number(radius)
    box = (number(min_lon), number(min_lat), number(max_lon), number(max_lat))
    has_box, has_centre = None not in box, lat is not None and lon is not None

    if q is not None:
        log.debug("%s: words %s", p.collection, text.words(q, p))
        rows = text.by_postings(rows, staged.postings, q, p, staged.bases) if staged.postings is not None else rows.where(text.condition(q, p))
    if (where := filters.conjunction(parsed := filters.parse(filter_by), p)) is not None:
        log.debug("%s: conditions %s", p.collection, parsed)
        rows = rows.where(where)
    if has_box:
        rows = rows.where(F.lit(False) if geometry is None else spatial.envelope_meets(box) if geometry == POLYGON else spatial.point_in_box(box))
    log.debug("%s: box %s, centre %s, radius %s", p.collection, box if has_box else None, (lat, lon) if has_centre else None, radius)
    if not has_centre or geometry is None:
        return rows.withColumn("__distance", F.lit(0.0)), False
    if geometry == POLYGON:
        rows = rows if has_box else rows.where(spatial.envelope_meets(spatial.polygon_box(lat, lon, radius)))
        rows = rows.withColumn("__distance", spatial.polygon_distance(lat, lon))
        return (rows if radius is None else rows.where(F.col("__distance") <= radius)), True
    rows = rows.where(F.col("_ex").isNotNull())
    if radius is not None:
        rows = rows.where(spatial.point_in_radius(lat, lon, radius, p.of("geo")[0].resolution))
    return rows.withColumn("__distance", spatial.point_distance(lat, lon, single)), True


def search(staged: Staged, group_by: str | None = None, top_n: Number = None, **conditions: Number) -> DataFrame:
    """_doc_id, the stored columns, __distance, and the coordinates of points, of the first rows that meet the
    conditions of matches(): by distance or id, top_n of each group or of all. Grouping needs a bitmap
    index, or nothing is found."""
    p, limit = staged.profile, whole(top_n)
    log.debug("%s: group_by=%s top_n=%s %s", p.collection, group_by, limit, conditions)
    rows, by_distance = matches(staged, **conditions, single=group_by is None)
    if group_by is None:
        rows = ranking.first(rows, by_distance, limit)
    elif p.index(group_by, "bitmap"):
        rows = ranking.first_of_groups(rows, f"_key_{group_by}", by_distance, limit)
    else:
        rows = rows.where(F.lit(False))
    place = [geo.latitude(F.col("_ez")).alias("_latitude"), geo.longitude(F.col("_ex"), F.col("_ey")).alias("_longitude")] if staged.geometry not in (None, POLYGON) else []
    return rows.select("_doc_id", *(F.col(f"`{c}`") for c in p.columns), "__distance", *place)


def is_nearest(staged: Staged, lat: Number = None, lon: Number = None, radius: Number = None, top_n: Number = None, group_by: str | None = None, **conditions: Number) -> bool:
    """If a search asks for the nearest points with a limit, and nothing else bounds the place."""
    box = [number(conditions.get(k)) for k in ("min_lat", "min_lon", "max_lat", "max_lon")]
    return staged.geometry == POINT and group_by is None and None not in (number(lat), number(lon)) and number(radius) is None and (whole(top_n) or 0) > 0 and None in box


def nearest(staged: Staged, lat: Number, lon: Number, top_n: Number, start: float = 500.0, radius: Number = None, group_by: str | None = None, **conditions: Number) -> DataFrame:
    """search() for the nearest points, for large written tables: the radius doubles until it holds enough rows
    that meet the conditions, which are then all that the final search looks at, so that most row groups
    are never read. The rows are those of search(); each step is a job that stops at top_n rows."""
    if not is_nearest(staged, lat, lon, radius, top_n, group_by, **conditions):
        return search(staged, group_by, lat=lat, lon=lon, radius=radius, top_n=top_n, **conditions)
    reach, wanted = start, whole(top_n)
    while reach < 2 * geo.RADIUS:
        within, _ = matches(staged, lat=lat, lon=lon, radius=reach, **conditions)
        if within.select("_ex").limit(wanted).count() == wanted:
            return search(staged, lat=lat, lon=lon, radius=reach, top_n=top_n, **conditions)
        log.debug("%s: fewer than %d within %d m", staged.profile.collection, wanted, reach)
        reach *= 2
    return search(staged, lat=lat, lon=lon, top_n=top_n, **conditions)
