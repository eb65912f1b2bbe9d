"""Results as JSON and GeoJSON. Stored values get their types from their looks, as values.rendered() says;
nulls are left out; a stored field named id takes the place of the internal one, and __distance, lat
and lon that of stored fields of these names."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions import geo, values
from frostline.plans.stage import POLYGON, Staged


def _object(parts: dict[str, Column]) -> Column:
    """A JSON object of pieces of JSON; null pieces are left out."""
    pieces = (F.when(v.isNotNull(), F.concat(F.lit(_quoted(k) + ":"), v)) for k, v in parts.items())
    return F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))


def _quoted(name: str) -> str:
    return json.dumps(name, ensure_ascii=False)


def _fields(staged: Staged, kinds: dict) -> dict[str, Column]:
    p = staged.profile
    geo_columns = {i.column for i in p.of("geo")}
    parts = {"id": F.col("_doc_id").cast("string")}
    for c in p.columns:
        if c not in geo_columns:
            last = [i.type for i in p.indexes if i.column == c]
            parts[c] = values.rendered(values.key(F.col(f"`{c}`"), kinds[c]), last[-1] if last else None)
    return parts


def _stored_geometry(staged: Staged) -> Column | None:
    stored = [i.column for i in staged.profile.of("geo") if i.column in staged.profile.columns]
    return geo.geojson(F.col(f"`{stored[0]}`")) if stored else None


def json_documents(found: DataFrame, staged: Staged) -> DataFrame:
    """_doc_id, document: a JSON object of each result."""
    parts = _fields(staged, {f.name: f.dataType for f in found.schema})
    if (geometry := _stored_geometry(staged)) is not None:
        parts["geometry"] = geometry
    if "__distance" in found.columns:
        parts["__distance"] = F.col("__distance").cast("string")
    if staged.geometry not in (None, POLYGON) and "_latitude" in found.columns:
        parts |= {"lat": F.col("_latitude").cast("string"), "lon": F.col("_longitude").cast("string")}
    return found.select("_doc_id", _object(parts).alias("document"))


def features(found: DataFrame, staged: Staged) -> DataFrame:
    """_doc_id, feature: a GeoJSON feature of each result. Points that aren't stored come from their earth-centred coordinates."""
    parts = _fields(staged, {f.name: f.dataType for f in found.schema})
    if "__distance" in found.columns:
        parts["__distance"] = F.col("__distance").cast("string")
    geometry = _stored_geometry(staged)
    if "_latitude" in found.columns:
        point = F.when(F.col("_latitude").isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array("_longitude", "_latitude").alias("coordinates"))))
        geometry = point if geometry is None else F.coalesce(geometry, point)
    shape = F.lit("null") if geometry is None else F.coalesce(geometry, F.lit("null"))
    return found.select("_doc_id", _object({"type": F.lit('"Feature"'), "geometry": shape, "properties": _object(parts)}).alias("feature"))


def rendered(found: DataFrame, staged: Staged, output: str = "geojson") -> Iterator[str]:
    """All results of a search in their order, as the pieces of one text. Rows come partition by partition, so any
    number of groups passes through."""
    shown = json_documents(found, staged).select("document") if output == "json" else features(found, staged).select("feature")
    yield "[" if output == "json" else '{"type":"FeatureCollection","features":['
    for k, row in enumerate(shown.toLocalIterator()):
        yield row[0] if k == 0 else "," + row[0]
    yield "]" if output == "json" else "]}"
