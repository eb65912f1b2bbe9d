"""Order, limit, and the first rows of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, PER_GROUP = 100, 10


def first(rows: DataFrame, by_distance: bool, limit: int | None) -> DataFrame:
    """By distance, then id, or by id alone; Spark keeps only so many rows per task."""
    order = [F.col("__distance").asc_nulls_last(), F.col("_doc_id")] if by_distance else [F.col("_doc_id")]
    return rows.orderBy(*order).limit(LIMIT if limit is None else limit)


def first_of_groups(rows: DataFrame, key: str, by_distance: bool, limit: int | None) -> DataFrame:
    """So many rows of each group, null keys left out; then all by distance and id, or by key and id."""
    order = [F.col("__distance").asc_nulls_last(), F.col("_doc_id")] if by_distance else [F.col("_doc_id")]
    ranked = rows.where(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    kept = ranked.where(F.col("_rank") <= (PER_GROUP if limit is None else limit)).drop("_rank")
    return kept.orderBy(*(order if by_distance else [F.col(key), F.col("_doc_id")]))
