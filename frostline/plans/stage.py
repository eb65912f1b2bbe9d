"""Staging: a source query becomes a table with ids, keys, tokens, numbers and geometry; building writes it."""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline import storage
from frostline.functions import geo, textnorm, values
from frostline.operators import indexes, spatial
from frostline.sources import readers
from frostline.sources.profile import Profile

log = logging.getLogger(__name__)
POINT, POLYGON = "point", "polygon"


@dataclass(frozen=True)
class Staged:
    """A staged table, lazy or written, and what is known about it."""

    rows: DataFrame
    profile: Profile
    geometry: str | None = None
    bounds: dict[str, list[float]] | None = None
    size: int | None = None
    bases: list[int] | None = None
    postings: DataFrame | None = None


def geometry_kind(rows: DataFrame, column: str = "_geom") -> str:
    """point or polygon, from the different kinds there are; both together are an error."""
    kinds = {r[0] for r in rows.where(F.col(column).isNotNull()).select(F.col(column)["kind"]).distinct().collect()}
    polygons = {k for k in kinds if k.endswith("POLYGON")}
    if polygons and kinds - polygons:
        raise ValueError(f"a geo column has points or polygons, not both: {', '.join(sorted(kinds))}")
    return POLYGON if polygons else POINT


def located(rows: DataFrame, profile: Profile) -> DataFrame:
    """The rows with the geometry of the profile's geo index and its envelope, if there is one."""
    kinds = {f.name: f.dataType for f in rows.schema}
    for i in profile.of("geo"):
        column, kind = F.col(f"`{i.column}`"), kinds[i.column]
        if not isinstance(kind, T.StructType | T.BinaryType):
            raise ValueError(f"geo index: {i.column!r} is no geometry")
        rows = rows.withColumn("_geom", geo.geometry_from_wkb(column) if isinstance(kind, T.BinaryType) else column)
        rows = rows.withColumns(dict(zip(("_xmin", "_ymin", "_xmax", "_ymax"), geo.envelope(F.col("_geom")), strict=True)))
    return rows


def checked(rows: DataFrame, profile: Profile) -> DataFrame:
    """The rows, if they have all columns that the profile names."""
    if missing := [c for c in [profile.primary_key, *profile.columns, *(i.column for i in profile.indexes)] if c not in rows.columns]:
        raise ValueError(f"the source query has no column {', '.join(dict.fromkeys(missing))}")
    return rows


def derived(rows: DataFrame, profile: Profile) -> DataFrame:
    """The rows with the derived columns of the profile's indexes, without ids."""
    return indexed(located(checked(rows, profile), profile), profile)


def indexed(rows: DataFrame, profile: Profile) -> DataFrame:
    """located() rows with the other derived columns."""
    kinds = {f.name: f.dataType for f in rows.schema}
    new = {"_pk": values.key(F.col(f"`{profile.primary_key}`"), kinds[profile.primary_key])}
    for i in profile.indexes:
        column, kind = F.col(f"`{i.column}`"), kinds[i.column]
        if i.type == "bitmap":
            new[f"_key_{i.column}"] = values.key(column, kind)
        elif i.type == "text":
            new[f"_tok_{i.column}"] = textnorm.tokens(values.key(column, kind), list(i.stopwords))
        elif i.type != "geo":
            new[f"_num_{i.column}"] = values.number(column, kind, i.type)
    rows = rows.withColumns(new)
    for i in profile.of("geo"):
        rows = rows.withColumns({"_lon": F.col("_xmin"), "_lat": F.col("_ymin")})
        rows = rows.withColumns(dict(zip(("_ex", "_ey", "_ez"), geo.ecef(F.col("_lon"), F.col("_lat")), strict=True)) | {"_cell": spatial.cell(F.col("_lon"), F.col("_lat"), i.resolution)})
    return rows


def stage(rows: DataFrame, profile: Profile, kind: str | None = None, path: str | None = None) -> Staged:
    """The rows with all derived columns and ids, written to `path` or the shared folder. Ids go by place (least
    y, then x) and key where there is geometry, else by key; nulls first. Equal keys go by the other stored
    numbers, dates and times in turn, then by a hash of all stored values: rows sampled for the ranges go to the
    driver and stay small. Rows are dealt out as the source has them; tokens and keys are derived behind the
    exchange. Each range is a file: by key it is in order of its ids, by place it is a strip of latitudes in order
    of longitude, so that row groups prune boxes on both sides."""
    kinds = {f.name: f.dataType for f in rows.schema}
    shaped = located(checked(rows, profile), profile)
    others = [c for c in profile.columns if c != profile.primary_key and isinstance(kinds[c], T.AtomicType) and not isinstance(kinds[c], T.StringType | T.BinaryType)]
    order = ["_ymin", "_xmin"] if profile.of("geo") else []
    ties = [F.col(f"`{c}`") for c in (*order, profile.primary_key, *others)]
    ties.append(F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in profile.columns)))))
    placed = indexes.placed(shaped, ties)
    new = indexed(placed, profile)
    if profile.of("geo"):
        new = new.sortWithinPartitions("_xmin", "_ymin")
    table = storage.written(new, "staged", path)
    before = indexes.bases(table)
    if profile.of("geo") and kind is None:
        kind = geometry_kind(table)
    return Staged(indexes.dense_ids(table, before), profile, kind if profile.of("geo") else None, size=before[-1], bases=before)


def build(spark: SparkSession, profile: Profile, output: str, with_postings: bool = False, with_bins: bool = False, keep: int = 2) -> Staged:
    """Runs the source query and publishes a new version of the collection under `output`: the staged table
    sorted by id, its metadata, and postings and bins of numbers (exact quantiles, a sort of each column) if asked
    for. Readers of older versions aren't disturbed: the pointer to the newest version is created last. The newest
    `keep` versions stay; a build that fails takes away what it wrote."""
    from frostline.plans import catalog

    version, output = uuid.uuid4().hex, output.rstrip("/")
    home = f"{output}/{version}"
    try:
        log.debug("%s: staging %s", profile.collection, version)
        done = stage(readers.source(spark, profile.query, profile.path), profile, path=f"{home}/documents")
        if with_bins:
            log.debug("%s: %d rows staged; finding bins", profile.collection, done.size)
            done = replace(done, bounds={i.column: indexes.boundaries(done.rows, i.column, i.bins) for i in profile.of("range", "date", "datetime")})
        if with_postings and profile.of("text"):
            log.debug("%s: gathering postings", profile.collection)
            table = indexes.postings(done.rows, [i.column for i in profile.of("text")])
            table.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{home}/postings")
            done = replace(done, postings=spark.read.parquet(f"{home}/postings"))
        catalog.write_text(spark, f"{home}/metadata.json", json.dumps(metadata(done) | {"postings": done.postings is not None}, ensure_ascii=False))
    except Exception:
        storage.removed(spark, home)
        raise
    catalog.publish(spark, output, version)
    log.debug("%s: %s published, removed: %s", profile.collection, version, catalog.cleaned(spark, output, max(1, keep)))
    return done


def metadata(staged: Staged) -> dict:
    p = staged.profile
    return {"name": p.collection, "size": staged.size, "indexes": [{"name": i.column, "type": i.type, "field": i.column} for i in p.indexes], "geometry_type": staged.geometry, "bounds": staged.bounds, "bases": staged.bases, "profile": asdict(p)}
