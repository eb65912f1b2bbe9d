"""Token ids of documents and the texts they decode to, by the encoder and decoder in bpe.py.

Null texts count as empty; an empty text has no ids. Rows with equal ids or texts are treated one by
one. Long texts need memory in proportion to themselves. Columns besides the id and the text are
left out, so their names never clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm import bpe, shared


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col and ids (array of int), a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.own_encoder(tokenizer)
        for batch in batches:
            ids = [np.frombuffer(table.ids(t), "<u4").astype(np.int32) for t in shared.texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], names=[id_col, "ids"])

    shared.batched(docs.sparkSession)
    return _two(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns id_col and text, a row per row; bytes that aren't UTF-8 become U+FFFD. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocabulary(tokenizer)
        for batch in batches:
            texts = [v.decode(np.asarray(ids.values if ids.is_valid else [], dtype=np.int64)) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    shared.batched(encoded.sparkSession)
    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each whole text in one pass: id_col, n_tokens, ids_sha256 (of the decimal
    ids joined by commas), decoded_sha256 (of the decoded text in UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, v = bpe.own_encoder(tokenizer), bpe.vocabulary(tokenizer)
        decimal = [str(i) for i in range(len(v.offsets) - 1)]
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in shared.texts_of(batch):
                ids = np.frombuffer(table.ids(text), "<u4")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                of_text.append(hashlib.sha256(v.decode(ids.astype(np.int64)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    shared.batched(docs.sparkSession)
    return _two(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32()))
