"""Queries of this subpackage, each over its whole tables, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from frostline.llm import encoding, knn, langid, licenses, linededup, minhash, packing, pii, shared, simhash, tokenfile

#: The key that surrogates are drawn with; a deployment gives its own secret.
SURROGATE_KEY = "frostline"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_edited(shared.table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(shared.table(spark, sf_dir, "documents"), distance=4, words=4)
    return found.withColumn("fingerprint", simhash.hexadecimal("fingerprint"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(shared.table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end_id=0)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.round_trip(shared.table(spark, sf_dir, "documents"), TOKENIZER)


def op7_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(shared.table(spark, sf_dir, "embeddings"), 5, "vec_id % 50 = 0")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.new_path(spark, "token-files")
    return tokenfile.read(spark, tokenfile.write(shared.table(spark, sf_dir, "documents"), folder, TOKENIZER, end_id=2))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(shared.table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "bits")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_simhash, op3_line_dedup, op4_pii, op5_best_fit_packing, op6_bpe, op7_voronoi_top_k, op8_token_files, op9_licenses, op10_language)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": linededup.SQL, "op7_voronoi_top_k": knn.SQL, "op9_licenses": licenses.sql()}
