"""SimHash fingerprints and near-duplicate groups.

A fingerprint has 64 bits; a bit is 1 if it is 1 in over half of the hashes of the text's shingles.
Fingerprints link if they differ in a few bits. Pigeonhole blocks find all such pairs: the bits are
split into blocks, two more than the allowed difference, so the fingerprints of a pair agree in two
blocks at least; each fingerprint goes to one bucket for every two blocks. Different fingerprints
only are compared, not documents. Within a small bucket a join compares pairs. A large bucket is
dealt into chunks by hash, and every two chunks meet in a task of bounded size, which gives back a
spanning forest of its links, so no group of near copies is ever written out as all its pairs.
Linked fingerprints then make up components (components.py).

Texts are lower-cased (A-Z) and split at ASCII white space; fewer words than a shingle has make one
shingle; null, empty and blank texts have no words and the fingerprint 0, which is linked like any
other. Equal rows are in one group. A very long text needs some 30 bytes for each of its shingles in one
task. An empty table gives no rows. Columns besides the id and the text are left out, so their names never
clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm import shared
from frostline.llm.components import components

BITS, SEED = 64, 42
#: Buckets of up to so many fingerprints are joined; larger ones are dealt into chunks of about that many.
JOINED, CHUNK = 32, 1024
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint_of(text: bytes, words: int) -> int:
    plain = b" ".join(text.translate(LOWER).split())
    if not plain:
        return 0
    spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(plain)]
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(plain[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)] or [hashed(plain, SEED)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint (long: the 64 bits) of each document, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint_of(t.encode(), words) for t in shared.texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64), pa.int64())], names=[id_col, "fingerprint"])

    shared.batched(docs.sparkSession)
    two = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint long")


def block_masks(distance: int) -> list[int]:
    """Bits of every two blocks, as signed 64-bit integers."""
    n = distance + 2
    cuts = [round(k * BITS / n) for k in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(blocks, 2))]


def forest(bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints (unsigned) with one of their group, a spanning forest."""
    rest, a, b = bits, [], []
    while len(rest) > 1:
        root, rest, edge = rest[0], rest[1:], rest[:1]
        while len(edge) and len(rest):
            near = np.zeros(len(rest), bool)
            for k in range(0, len(edge), 256):
                near |= (np.bitwise_count(edge[k : k + 256, None] ^ rest[None, :]) <= distance).any(axis=0)
            edge, rest = rest[near], rest[~near]
            a.append(np.full(len(edge), root, np.uint64))
            b.append(edge)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """Links a, b of different fingerprints (a written table with a column fingerprint) that differ in
    `distance` bits or fewer: not all, but enough to connect all that are connected."""
    masks = F.array(*(F.lit(m) for m in block_masks(distance)))
    keyed = distinct.select("fingerprint", F.posexplode(masks).alias("two", "mask")).select("fingerprint", "two", F.expr("fingerprint & mask").alias("bits"))
    sizes = shared.written(keyed.groupBy("two", "bits").agg(F.count("*").alias("n")).where("n > 1"), "sizes")  # a table of its own, so that Spark can split the join at a large bucket
    # Spark takes exploded rows for as small as the table they come from; without the hint it may broadcast them
    full = shared.written(keyed.hint("merge").join(sizes, ["two", "bits"]), "buckets")

    small = full.where(F.col("n") <= JOINED)
    pair = small.alias("x").join(small.alias("y"), F.expr(f"x.two = y.two AND x.bits = y.bits AND x.fingerprint < y.fingerprint AND bit_count(x.fingerprint ^ y.fingerprint) <= {int(distance)}"))
    pair = pair.select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b"))

    chunks = F.ceil(F.col("n") / CHUNK)
    own = F.pmod(F.xxhash64("fingerprint"), chunks)
    large = full.where(F.col("n") > JOINED).select("two", "bits", "fingerprint", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other"))
    large = large.select("two", "bits", "fingerprint", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(group["fingerprint"].to_numpy().astype(np.int64).view(np.uint64), distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return pair.union(large.groupBy("two", "bits", "low", "high").applyInPandas(meet, "a long, b long"))


def groups(docs: DataFrame, distance: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (long), component_id: the smallest id that is linked to the document, directly or
    through others, itself included. Rows with a null id link too, but their id is never the smallest."""
    of_docs = shared.written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = shared.written(of_docs.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "distinct")
    linked = components(links(distinct, distance)).withColumnRenamed("node", "fingerprint")
    labelled = distinct.join(linked, "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fingerprint = shared.written(labelled.join(least, "component").select("fingerprint", "component_id"), "labels")
    return of_docs.join(of_fingerprint, "fingerprint", "left").select(id_col, "fingerprint", "component_id")


def hexadecimal(bits: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")
