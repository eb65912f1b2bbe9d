"""Sets of documents as frames of one column, _doc_id. Conditions of a search are predicates on one scan and
need none of these; they are for sets that come from index tables or from outside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def holding(index: DataFrame, *values: str) -> DataFrame:
    """Ids of some values of an exact-match index table (value, ids)."""
    return index.where(F.col("value").isin(*values)).select(F.explode("ids").alias("_doc_id"))


def universe(staged: DataFrame) -> DataFrame:
    return staged.select("_doc_id")


def union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, sets).distinct()


def intersection(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "_doc_id", "left_semi"), others, first)


def difference(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "_doc_id", "left_anti"), others, first)
