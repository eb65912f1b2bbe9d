"""Text conditions: each word of a query is a prefix of some token in some text field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.textnorm import slugify
from frostline.operators import indexes
from frostline.sources.profile import Profile


def words(query: str, profile: Profile) -> list[tuple[str, list[str]]]:
    """(prefix, fields to look in) of each word that counts. A stopword of a field skips that field; of all fields, it is ignored."""
    fields = [(i.column, {slugify(w) for w in i.stopwords}) for i in profile.of("text")]
    found = ((s, [f for f, stops in fields if s not in stops]) for s in map(slugify, query.split()))
    return [(s, f) for s, f in found if f]


def condition(query: str, profile: Profile) -> Column:
    """All words, each in any field. No word that counts: nothing is found. A word of
    marks alone, whose slug is empty, is in all that have a token."""
    tests = []
    for prefix, fields in words(query, profile):
        tests.append(reduce(Column.__or__, (F.coalesce(F.exists(f"`_tok_{f}`", lambda t: t.startswith(prefix)), F.lit(False)) for f in fields)))
    return reduce(Column.__and__, tests) if tests else F.lit(False)


def ids(postings: DataFrame, query: str, profile: Profile) -> DataFrame | None:
    """_doc_id of the documents that have all words, by the postings table (field, term, block, ids), sorted by field
    and term: prefixes are pushed down to its scan. The words' ids are intersected, few rows each next to the staged
    table. None: no word counts."""
    hits = [
        postings.where(F.col("field").isin(*fields) & F.col("term").startswith(prefix)).select(F.explode("ids").alias("_doc_id"))
        for prefix, fields in sorted(words(query, profile), key=lambda w: -len(w[0]))
    ]
    return reduce(lambda a, b: a.join(b, "_doc_id", "left_semi"), hits) if hits else None


def by_postings(staged: DataFrame, postings: DataFrame, query: str, profile: Profile, before: list[int] | None = None) -> DataFrame:
    """The rows that meet condition(), by ids(): one semi-join of the staged table, on the columns that its scan has
    (range and place) where `before` tells how many rows stand before each range."""
    found = ids(postings, query, profile)
    if found is None:
        return staged.where(F.lit(False))
    if before is None or len(before) > indexes.LISTED_RANGES:
        return staged.join(found, "_doc_id", "left_semi")
    part, at = indexes.range_of(F.col("_doc_id"), before)
    return staged.join(found.select(part.alias("_part"), at.alias("_at")), ["_part", "_at"], "left_semi")
