"""Best-fit-decreasing packing of documents into sequences of fixed capacity.

Documents become ids, the end id, and, if longer than a sequence, pieces of full length (the first
takes what is left over). Best fit decreasing looks only at lengths, so it runs on the histogram of
lengths, which has no more rows than a sequence has places however many documents there are. A
segment tree over remaining capacities finds the tightest open sequence; all pieces of a length that
meet alike sequences are laid down in one step, which places each piece just where one-by-one
placement would. The steps come back as runs: so many pieces of this length, from this rank, into
these sequences from this place on. Each piece then finds its own sequence from its rank among
pieces of its length. Ranks come from counts over salted groups, so no length is ever in one task.

Null texts count as empty: such a document is its end id alone. Equal rows are packed one by one: pieces
are numbered when they are written, and ranks go by that number, so rows of one id, or without any, are
dealt out like others. A very long text is one row in memory, its ids 4 bytes each, before it is cut. An
empty table gives no rows. Extra columns are left out, so their names never clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.llm import bpe, shared

PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
RUNS = "length long, from_rank long, to_rank long, first_sequence long, in_each long, first_offset long"


class OpenBins:
    """Counts of open bins by remaining capacity, as a segment tree; finds the tightest that fits."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        i = remaining + self.leaves
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, needed: int) -> int | None:
        """The least remaining capacity of needed or more that an open bin has."""
        i = needed + self.leaves
        if self.tree[i]:
            return needed
        while i > 1:  # up to where a right neighbour has bins, then down to its first
            if not i & 1 and self.tree[i + 1]:
                i += 1
                break
            i >>= 1
        if i <= 1:
            return None
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, from_rank, to_rank, first_sequence, in_each, first_offset) that pack counts[length]
    pieces of each length. A run's pieces go to sequences first_sequence, first_sequence + 1 and so on,
    in_each to a sequence, one after another from first_offset."""
    tree, open_runs, runs, made = OpenBins(capacity), defaultdict(list), [], 0

    def opened(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_runs[remaining].append((first, n))
            tree.add(remaining, n)

    for length in sorted((k for k, n in counts.items() if n and k), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, n = capacity, -(-left // (capacity // length))
                first, made = made, made + n
            else:
                first, n = open_runs[room].pop()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                opened(room - each * length, first, full)
            if full < n and left:  # the last pieces share one bin
                runs.append((length, rank, rank + left, first + full, left, capacity - room))
                opened(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            opened(room, first + full, n - full)
    return runs


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    end = np.uint32(end_id).tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        table = bpe.library_encoder(tokenizer)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), shared.texts_of(batch), strict=True):
                ids = table.ids(text) + end
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    yield doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])

    shared.batched(docs.sparkSession)
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(lambda b: shared.in_batches(rows(b), PIECE), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, key: str = "number") -> DataFrame:
    """`pieces` (read more than once: give a written table) with sequence_id and offset, less the key. It needs
    a column length, from 1 to capacity, and the key, which differs in all rows; others pass through."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per length at most
    runs = spark.createDataFrame(best_fit_decreasing(counts, capacity), RUNS)
    in_group = max(200, sum(counts.values()) // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    groups = spark.createDataFrame([(k, -(-n // min(in_group, 50_000))) for k, n in counts.items()], "length long, groups long")
    salted = pieces.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64(key), "groups")).drop("groups")
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = base.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(key)) - 1)
    ranked = ranked.join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    # as many runs as the capacity allows, whatever the input: at most a few for each pair of lengths
    placed = ranked.join(F.broadcast(runs.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    step = F.col("rank") - F.col("from_rank")
    return placed.select(
        *(c for c in pieces.columns if c != key),
        (F.col("first_sequence") + F.floor(step / F.col("in_each"))).alias("sequence_id"),
        (F.col("first_offset") + step % F.col("in_each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece."""
    pieces = cut(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("number", F.monotonically_increasing_id())
    return pack(shared.written(pieces, "pieces"), capacity)
