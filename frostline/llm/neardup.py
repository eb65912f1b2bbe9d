"""Near copies: one document of each group stays.

Documents link in two ways. SimHash fingerprints of five-word shingles that differ in four bits or
fewer link, by the pigeonhole blocks of simhash.py. A 64-bit SimHash can't find all texts with a
Jaccard similarity of 0.8, though: their fingerprints differ in ten bits or so, for which no blocks
are both safe and selective. So one-permutation MinHash minima (minhash.py) are cut into bands as
well; texts that agree in a band are candidates. Those whose whole fingerprints are not far apart
(estimated similarity LOOSE or more, eight standard errors below the threshold) are compared by their
shingle sets themselves, as 64-bit hashes, and link if the exact similarity reaches the threshold. A
pair of similarity 0.8 shares none of the 16 bands of 4 minima in about 2 of 10,000 cases.

Documents with equal shingle sets and SimHash are one node. Shingle sets are made again from the texts,
for nodes with candidates only. Within a small bucket pairs are compared; a large bucket is dealt into
chunks, bounded in nodes and in shingles, that meet two by two and give back spanning forests (see
simhash.py).
Null, empty and blank texts are copies of each other. Of each group the row with the smallest id
stays, of equal ids the one with the least hash of the text; null ids go last. Rows equal throughout leave
one. A very long text is hashed in blocks, its shingles are 8 bytes each. An empty table gives no rows.
Columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm import minhash, shared, simhash
from frostline.llm.components import components

WORDS, SIMILARITY, DISTANCE, BANDS, ROWS = 5, 0.8, 4, 16, 4
JOINED, CHUNK = 16, 1024
#: Candidates of a lower estimate are dropped unseen; shingles of a chunk.
LOOSE, CHUNK_SHINGLES = 0.6, 1 << 20


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (hash of the text), node (hash of SimHash and shingles), bits, print, bands, length (different
    shingles) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in shared.texts_of(batch)]
            bits = np.array([simhash.fingerprint_of(t, WORDS) for t in texts], np.uint64)
            prints, sets = minhash.in_chunks(texts), shingle_sets(texts)
            whole = [b.tobytes() + s.tobytes() for b, s in zip(bits, sets, strict=True)]
            bands = [p[: BANDS * ROWS].view("<i4").astype(np.int64).tolist() for p in prints]  # ROWS minima of a byte each
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([xxhash.xxh3_128_digest(w) for w in whole]), pa.array(bits.view(np.int64)), pa.array([p.tobytes() for p in prints]), pa.array(bands, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64())],
                names=["id", "key", "node", "bits", "print", "bands", "length"],
            )

    shared.batched(docs.sparkSession)
    three = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    return three.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, key long, node binary, bits long, print binary, bands array<long>, length long")


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted hashes of the different shingles of each text."""
    out: list[np.ndarray] = []
    for part in minhash.parted(texts):
        if len(part) == 1 and len(part[0]) > minhash.TOGETHER:
            out.append(np.unique(np.concatenate([np.unique(h) for h in minhash.long_hashes(part[0], WORDS)])))
            continue
        of, h = minhash.shingle_hashes(part, WORDS)
        out += map(np.unique, np.split(h[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=len(part)))[:-1]))
    return out


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of fingerprints may be of similar texts."""
    return minhash.likeness(a, b) >= LOOSE


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets reach the threshold, exactly."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) >= SIMILARITY


def comparison(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function (at, rows): which of these rows of `sets` are similar to the row `at`."""
    size = np.array([len(s) for s in sets])
    starts = np.cumsum(size) - size
    values, numbers = np.unique(np.concatenate(sets), return_inverse=True)

    def compare(at: int, rows: np.ndarray) -> np.ndarray:
        if len(rows) <= 16:
            return np.array([similar(sets[at], sets[k]) for k in rows], bool)
        own = np.zeros(len(values), bool)
        own[numbers[starts[at] : starts[at] + size[at]]] = True
        common = np.add.reduceat(own[numbers], starts, dtype=np.int64)[rows]
        return common / (size[rows] + size[at] - common) >= SIMILARITY

    return compare


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, minhash.BINS)


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def sets_of(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, shingles of the nodes `wanted` (a written table: node, first), each from the text of its first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([t.encode() for t in shared.texts_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    return texts.join(wanted, same).select("node", "text").mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


def band_links(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links a, b between nodes (a written table: node, print, bands, length, first) that share a band and are similar."""
    keyed = nodes.select("node", "length", F.posexplode("bands").alias("band", "value"))
    sizes = shared.written(keyed.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum("length").alias("shingles")).where("n > 1"), "sizes")  # a table of its own, so that Spark can split the join at a large bucket
    # Spark takes exploded rows for as small as the table they come from; without the hint it may broadcast them
    full = shared.written(keyed.drop("length").hint("merge").join(sizes, ["band", "value"]), "bands")
    small = full.where(F.col("n") <= JOINED)
    pairs = small.alias("x").join(small.alias("y"), F.expr("x.band = y.band AND x.value = y.value AND x.node < y.node"))
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    prints = nodes.select("node", "print")
    both = pairs.join(prints.select(F.col("node").alias("a"), F.col("print").alias("of_a")), "a").join(prints.select(F.col("node").alias("b"), F.col("print").alias("of_b")), "b")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = pa.array(alike(_prints(batch.column("of_a")), _prints(batch.column("of_b"))))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], names=["a", "b"])

    candidates = shared.written(both.select("a", "b", "of_a", "of_b").mapInArrow(sift, "a binary, b binary"), "candidates")
    large = full.where(F.col("n") > JOINED)
    some = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).union(large.select("node")).distinct()
    wanted = shared.written(nodes.select("node", "first").join(some, "node"), "wanted")
    sets = shared.written(sets_of(wanted, docs, id_col, text_col), "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = pa.array([similar(x, y) for x, y in zip(_sets(batch.column("of_a")), _sets(batch.column("of_b")), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], names=["a", "b"])

    both = candidates.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    linked = both.select("a", "b", "of_a", "of_b").mapInArrow(check, "a binary, b binary")

    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES))
    dealt = large.select("band", "value", "node", F.pmod(F.xxhash64("node"), chunks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other"))
    dealt = dealt.select("band", "value", "node", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).join(prints, "node").join(sets, "node")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        names = group["node"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        a, b = forest(np.frombuffer(b"".join(group["print"]), np.uint8).reshape(-1, minhash.BINS), comparison(sets))
        return pd.DataFrame({"a": names[a], "b": names[b]})

    return linked.union(dealt.groupBy("band", "value", "low", "high").applyInPandas(meet, "a binary, b binary"))


def forest(prints: np.ndarray, compare: Callable[[int, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among rows of fingerprints: each later row with the first of its tree.
    Rows that are alike link if compare() says so of them."""
    rest, a, b = np.arange(len(prints)), [], []
    while len(rest) > 1:
        root, rest, edge = rest[0], rest[1:], [rest[0]]
        while edge and len(rest):
            at = edge.pop()
            near = alike(prints[rest], prints[at][None, :])
            if compare:
                near[near] = compare(at, rest[near])
            found, rest = rest[near], rest[~near]
            a += [root] * len(found)
            b += found.tolist()
            edge += found.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def groups(signed: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key and group of each row of written signatures() of `docs`."""
    first = F.min(F.struct("id", "key")).alias("first")
    nodes = shared.written(signed.groupBy("node").agg(first, *(F.any_value(c).alias(c) for c in ("bits", "print", "bands", "length"))), "nodes")
    of_bits = shared.written(nodes.groupBy("bits").agg(F.min("node").alias("least")), "distinct")
    same = nodes.join(of_bits, "bits").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    close = simhash.links(of_bits.select(F.col("bits").alias("fingerprint")), DISTANCE)
    close = close.join(of_bits.select(F.col("bits").alias("a"), F.col("least").alias("of_a")), "a").join(of_bits.select(F.col("bits").alias("b"), F.col("least").alias("of_b")), "b")
    linked = components(same.union(close.select("of_a", "of_b")).union(band_links(nodes, docs, id_col, text_col)))
    return signed.select("id", "key", "node").join(linked, "node", "left").select("id", "key", F.coalesce("component", "node").alias("group"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    order = F.struct(F.col("id").isNull(), "id", "key")
    signed = shared.written(signatures(docs, id_col, text_col), "signatures")
    stay = groups(signed, docs, id_col, text_col).groupBy("group").agg(F.min(order).alias("x")).select(F.col("x.id").alias("_id"), F.col("x.key").alias("_key"))
    row = docs.select(F.struct("*").alias("_row"))  # whatever the columns are called, they don't clash below
    same = F.col("_row")[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("_row")[text_col]) == F.col("_key"))
    kept = row.join(stay, same, "left_semi").select("_row.*")
    if signed.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept
    return kept.dropDuplicates([id_col, text_col])
