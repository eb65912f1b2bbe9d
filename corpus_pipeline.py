"""From raw documents to packed token sequences: language ID, line dedup, near-copy removal, surrogates
for personal data, best-fit packing. Each stage takes (spark, docs, sf_dir) and works on all that the
stage before kept; each result is written as Parquet in the shared folder and read again.

Every stage takes nulls in any column, empty and very long texts, ties and repeated rows, and empty tables,
which stay empty; columns besides those of documents pass through all stages but the last, whatever they are
called. What becomes of such rows is told at each stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import langid, linededup, neardup, packing, pii, queries, shared

#: A text of so many characters or more that needs more bits per symbol than this in its best language is in
#: none of the learned ones. Texts of a learned language need 2 to 4, short ones up to 6, random letters 9 to 11.
LEAST_CHARS, MOST_BITS = 50, 8.0


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """`changed` with the columns of `docs`, n_chars counted anew."""
    n = F.coalesce(F.length("text"), F.lit(0))
    return changed.select(*(n.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts are such) or in none of the learned languages go; a null lang
    is filled. Repeated rows are judged alike; a null doc_id is judged but not learned from. Where nothing can be
    learned, all documents go. Long texts are parsed whole."""
    found = langid.identified(docs, langid.learn(docs))
    fits = (F.col("found.bits") <= MOST_BITS) | (F.length("row.text") < LEAST_CHARS)
    kept = found.where((F.col("found.lang_pred") != langid.UNKNOWN) & fits)
    return kept.select(*(F.coalesce("row.lang", "found.lang_pred").alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document of which nothing else is left goes with them. Null and empty texts stay; rows
    equal in id and text come out alike; a null doc_id comes first. A long text is one row in memory."""
    found = linededup.dedup(docs)
    return _with_text(docs, found.where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(" \t\r\n")) != "")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least doc_id, null last, of equal ones that with the
    least hash of its text. Null, empty and blank texts are copies of each other; rows equal throughout leave one."""
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced. Null and empty texts stay; rows equal in id and text come out alike; mentions in a
    long text are found wherever they stand."""
    return _with_text(docs, pii.pseudonymise(docs, queries.SURROGATE_KEY))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, a row per piece. A null or empty text is its end id alone; repeated
    rows are packed one by one; a long text is cut into pieces of 2048 tokens."""
    return packing.pack_documents(docs, queries.TOKENIZER, capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("PII surrogates", personal_data),
    ("best-fit packing", packed),
]

#: Hashing, tokens and learned models are beyond SQL; the tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
