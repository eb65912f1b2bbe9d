"""Removal of repeated passages by overlapping windows of three lines.

Lines are what line feeds part, without blanks, tabs and carriage returns at their ends; blank lines
don't count. Each three consecutive lines are a window. Windows are told apart by a 128-bit hash. Of
a window that stands in several places, the first place in order of (doc_id, position) stays; the
lines of all later places go. What later places cover is merged, blank lines within it included, so
overlapping windows take a whole passage out. Copies within one text count as well.

Texts of fewer than three lines, null and empty texts stay as they are. Rows of one id and different
texts are ordered by a hash of the text; rows that are equal throughout are one document and come
out alike. A null id comes first. A very long text needs memory in proportion to itself in one task. An
empty table gives no rows. Columns of any name pass through, but for those called like new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm import shared

WINDOW = 3


def windows(lines: Column) -> Column:
    """(first, last, hash) of each window of an array of lines; first and last are places in the array."""
    solid = F.filter(F.transform(lines, lambda line, i: F.struct(F.btrim(line, F.lit(" \t\r")).alias("line"), i.alias("at"))), lambda x: x["line"] != "")

    def all_of(solid: Column) -> Column:
        n = F.size(solid)

        def window(i: Column) -> Column:
            part = [F.element_at(solid, i + k) for k in range(1, WINDOW + 1)]
            return F.struct(part[0]["at"].alias("first"), part[-1]["at"].alias("last"), F.unhex(F.md5(F.concat_ws("\n", *(p["line"] for p in part)).cast("binary"))).alias("hash"))

        return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), window))

    return shared.let(solid, all_of)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with its text less the repeated passages, and n_lines, n_removed (lines, blank ones included), which
    take the place of columns of these names."""
    row = docs.select(F.struct("*").alias("_row"))  # whatever the columns are called, they don't clash below
    id_, text = F.col("_row")[id_col], F.col("_row")[text_col]
    lines = F.split(text, "\n", -1)
    keyed = row.select(id_.alias("id"), F.xxhash64(text).alias("key"), F.explode(windows(lines)).alias("w")).select("id", "key", "w.*")
    found = shared.written(keyed, "windows")
    place = F.struct("id", "key", "first")
    # how often a window stands somewhere and where first: partial minima and counts come before the shuffle
    repeated = found.groupBy("hash").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1").select("hash", "origin")
    repeated = shared.written(repeated, "repeated")  # a table of its own, so that Spark can split the join at a common window
    later = found.join(repeated, "hash").where(~place.eqNullSafe(F.col("origin")))
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last"))))
    cuts = later.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(covered.alias("_cut"))  # within one document
    joined = row.join(cuts, id_.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_key")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_cut"))
    cut = shared.let(lines, lambda own: F.array_join(F.transform(kept, lambda i: F.get(own, i)), "\n"))
    done = joined.select(
        "_row",
        F.when(F.col("_cut").isNull(), text).otherwise(cut).alias("_text"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("_lines"),
        F.coalesce(F.size("_cut"), F.lit(0)).cast("long").alias("_removed"),
    )
    own = (F.col("_row")[c].alias(c) for c in docs.columns if c not in (text_col, "n_lines", "n_removed"))
    return done.select(*own, F.col("_text").alias(text_col), F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"))


#: The same by DuckDB, over the table documents.
SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), solid AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), found AS (
  SELECT doc_id, pos AS first, lead(pos, 2) OVER w AS last, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS passage
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY passage ORDER BY doc_id, first) AS k FROM found WHERE passage IS NOT NULL
), cut AS (
  SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS pos FROM ranked WHERE k > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lines l ANTI JOIN cut c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
), counts AS (
  SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN counts c ON c.doc_id = d.doc_id
"""
