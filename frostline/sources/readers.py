"""Source queries: file functions in FROM clauses, of one path or a list in brackets, become views that Spark
reads, and {path} the path. Tables and views that the session knows need no function."""

from __future__ import annotations

import re
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession

from frostline.functions import geo

FORMATS = {"csv": "csv", "csv_auto": "csv", "parquet": "parquet", "json": "json", "json_auto": "json", "ndjson": "json", "orc": "orc", "text": "text"}
PATHS = r"'[^']*'|\[\s*'[^']*'(?:\s*,\s*'[^']*')*\s*\]"
CALL = re.compile(rf"\b(?:read_(?P<kind>csv_auto|csv|parquet|json_auto|json|ndjson|orc|text)|parquet_scan)\s*\(\s*(?P<paths>{PATHS})\s*(?P<options>(?:,\s*\w+\s*=\s*(?:'[^']*'|\w+)\s*)*)\)", re.IGNORECASE)
OPTION = re.compile(r"(\w+)\s*=\s*(?:'([^']*)'|(\w+))")
#: Options of file functions that Spark's reader has under other names.
NAMES = {"delim": "sep", "sep": "sep", "header": "header", "quote": "quote", "escape": "escape", "nullstr": "nullValue", "dateformat": "dateFormat", "timestampformat": "timestampFormat", "all_varchar": "all_varchar"}


def read(spark: SparkSession, kind: str, paths: list[str], options: dict[str, str]) -> DataFrame:
    """Files or folders; compressed files are read as such. CSV has a header and typed columns unless told otherwise."""
    reader = spark.read
    if kind == "csv":
        given = {NAMES[k.lower()]: v for k, v in options.items() if k.lower() in NAMES}
        plain = given.pop("all_varchar", "false").lower() in ("true", "1")
        return reader.options(**({"header": "true", "inferSchema": str(not plain).lower()} | given)).csv(paths)
    return reader.format(kind).load(paths)


def rewritten(spark: SparkSession, query: str, path: str) -> str:
    """The query with its file functions replaced by views, and {path} by the path."""

    def view(m: re.Match) -> str:
        options = {k: a or b for k, a, b in OPTION.findall(m["options"] or "")}
        name = f"source_{md5(m[0].encode()).hexdigest()}"  # the same call takes the place of its older view
        read(spark, FORMATS[(m["kind"] or "parquet").lower()], re.findall("'([^']*)'", m["paths"]), options).createOrReplaceTempView(name)
        return name

    return CALL.sub(view, query.replace("{path}", path))


def source(spark: SparkSession, query: str, path: str = "") -> DataFrame:
    """The rows of a source query: any SQL that Spark knows, over files, views and tables."""
    geo.register(spark)
    return spark.sql(rewritten(spark, query, path))
