"""Collections on disk, and a catalog of them that reloads as a whole."""

from __future__ import annotations

import json
import logging
import re
import time
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.operators import indexes
from frostline.plans import render
from frostline.plans import search as plan
from frostline.plans.stage import Staged
from frostline.sources.profile import Index, Profile

log = logging.getLogger(__name__)


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file in any store that Spark reaches."""
    fs, where, _ = _file_system(spark, path)
    out = fs.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()


POINTER = re.compile(r"CURRENT-(\d{10})-(\w+)$")


def pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of the published versions of a collection, the current one last."""
    fs, where, _ = _file_system(spark, path)
    names = (POINTER.match(s.getPath().getName()) for s in fs.listStatus(where) if s.isFile()) if fs.exists(where) else ()
    return sorted((int(m[1]), m[2]) for m in names if m)


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Makes a version the current one. A pointer is an empty file whose name says it all; it is created at once and
    never changed, and the greatest number counts, so at each moment readers find one version or the other."""
    while True:
        told = pointers(spark, path)
        fs, where, _ = _file_system(spark, f"{path}/CURRENT-{(told[-1][0] if told else 0) + 1:010d}-{version}")
        if fs.createNewFile(where):
            return


def cleaned(spark: SparkSession, path: str, keep: int, age: float = 86_400) -> list[str]:
    """Removes all but the newest `keep` versions of a collection, pointers first, and what builds that never
    published have left if it is older than so many seconds. Gives the versions removed."""
    told, out = pointers(spark, path), []
    fs, where, jvm = _file_system(spark, path)
    for number, version in told[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT-{number:010d}-{version}"), False)
    kept, old = {v for _, v in told[-keep:]}, {v for _, v in told[:-keep]}
    for s in fs.listStatus(where):
        name = s.getPath().getName()
        if s.isDirectory() and name not in kept and VERSION.match(name) and (name in old or s.getModificationTime() < 1000 * (time.time() - age)):
            fs.delete(s.getPath(), True)
            out.append(name)
    return out


VERSION = re.compile(r"[0-9a-f]{32}$")


def read_text(spark: SparkSession, path: str) -> str:
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def children(spark: SparkSession, path: str) -> list[str]:
    fs, where, _ = _file_system(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []


class Collection:
    def __init__(self, name: str, staged: Staged, version: str = "") -> None:
        self.name, self.staged, self.version = name, staged, version

    def search(self, **parameters: object) -> DataFrame:
        """See search(); for the nearest points of a written collection, see nearest()."""
        if self.staged.bases is not None and plan.is_nearest(self.staged, **parameters):
            return plan.nearest(self.staged, **parameters)
        return plan.search(self.staged, **parameters)

    def get(self, key: str | int) -> DataFrame:
        """The document with this primary key, of equal keys the one of the greatest id; else the one with this id."""
        rows = self.staged.rows
        hit = F.col("_pk") == str(key)
        if str(key).isascii() and str(key).isdigit() and int(key) < 2**63:
            hit = hit | self._place(int(key))
        best = rows.where(hit).withColumn("_by_key", F.coalesce(F.col("_pk") == str(key), F.lit(False))).orderBy(F.desc("_by_key"), F.desc("_doc_id")).limit(1)
        return best.select("_doc_id", *(F.col(f"`{c}`") for c in self.staged.profile.columns))

    def _place(self, number: int) -> Column:
        """The row of this id, by its range and place, which the scan can prune by."""
        before = self.staged.bases
        if before is None:
            return F.col("_doc_id") == number
        part = bisect_left(before, number) - 1
        return (F.col("_part") == part) & (F.col("_at") == number - before[part] - 1) if 1 <= number <= before[-1] else F.lit(False)

    def get_json(self, key: str | int) -> str | None:
        found = render.json_documents(self.get(key), self.staged).first()
        return found["document"] if found else None

    def render(self, output: str = "geojson", **parameters: object) -> str:
        return "".join(self.rendered(output, **parameters))

    def rendered(self, output: str = "geojson", **parameters: object) -> Iterator[str]:
        """render() piece by piece, of which the driver holds those of one partition."""
        return render.rendered(self.search(**parameters), self.staged, output)

    def bins(self, field: str) -> DataFrame:
        """bin, low, high (its boundaries, null at the ends) and n of a number's bins, of a collection built with bins."""
        bounds = [None, *(self.staged.bounds or {}).get(field, []), None]
        listed = self.staged.rows.sparkSession.createDataFrame([(k, *b) for k, b in enumerate(zip(bounds, bounds[1:], strict=False))], "bin int, low double, high double")
        return listed.join(self.staged.rows.groupBy(F.col(f"`_bin_{field}`").alias("bin")).agg(F.count("*").alias("n")), "bin")

    def info(self) -> dict[str, list[str]]:
        """Indexed columns by kind of index."""
        out: dict[str, list[str]] = {}
        for i in self.staged.profile.indexes:
            out.setdefault(i.type, []).append(i.column)
        return out

    def health(self) -> dict:
        return {"name": self.name, "size": self.staged.size or 0, "indexes": [{"name": i.column, "type": i.type, "field": i.column} for i in self.staged.profile.indexes]}


def open_collection(spark: SparkSession, path: str) -> Collection:
    path = path.rstrip("/")
    version = pointers(spark, path)[-1][1]
    home = f"{path}/{version}"
    data = json.loads(read_text(spark, f"{home}/metadata.json"))
    known = {f.name for f in fields(Profile)}
    own = {k: v for k, v in data["profile"].items() if k in known}
    profile = Profile(**own | {"columns": tuple(own["columns"]), "indexes": tuple(Index(**i | {"stopwords": tuple(i["stopwords"])}) for i in own["indexes"])})
    rows = indexes.dense_ids(spark.read.parquet(f"{home}/documents"), data["bases"])
    rows = rows.withColumns({f"_bin_{c}": indexes.bin_of(F.col(f"`_num_{c}`"), b) for c, b in (data["bounds"] or {}).items()})
    staged = Staged(rows, profile, data["geometry_type"], data["bounds"], data["size"], data["bases"], spark.read.parquet(f"{home}/postings") if data["postings"] else None)
    return Collection(path.rsplit("/", 1)[-1], staged, version)


class Catalog:
    """Collections by name. refresh() makes a new set and puts it in place at once: who holds a collection
    keeps the version that they have."""

    def __init__(self, spark: SparkSession, paths: list[str]) -> None:
        self.spark, self.paths, self.collections = spark, paths, {}
        self.refresh()

    def homes(self) -> list[str]:
        """A path is a collection, or its direct subfolders may be."""
        out = []
        for path in self.paths:
            out += [path] if pointers(self.spark, path) else [c for c in children(self.spark, path) if pointers(self.spark, c)]
        return out

    def refresh(self) -> None:
        """Broken collections are left out with a warning; of equal names the later one counts."""
        found = {}
        for home in self.homes():
            try:
                one = open_collection(self.spark, home)
                found[one.name] = one
            except Exception as e:  # noqa: BLE001
                log.warning("%s isn't loaded: %s", home, e)
        self.collections = found

    def versions(self) -> dict[str, str]:
        return {h: pointers(self.spark, h)[-1][1] for h in self.homes()}

    def health(self) -> list[dict]:
        return [c.health() for c in self.collections.values()]
