"""One-permutation MinHash fingerprints of documents.

Each shingle of five words is hashed once. The high bits of the hash choose a bin, the rest compete
for the bin's minimum. An empty bin takes over a full one: each bin has its own fixed random order of
the others and borrows from the first full one in it (optimal densification: the borrowed bin is
chosen alike in all documents and evenly among all bins). A fingerprint packs the low eight bits of
each of the 256 minima into 256 bytes. Two minima that differ agree in these bits by chance in one of
256 cases; the likeness takes that out: (agreeing share - 1/256) / (1 - 1/256), not under 0.

Words are runs of other bytes than ASCII white space, A-Z lower-cased. A text of fewer words is one
shingle; a text without words, an empty or a null one is a shingle of no words, so all these are
alike. Repeated shingles count once, as the minimum does. Equal rows have equal fingerprints. A very long
text, or word, is hashed in blocks: beyond the text itself it needs 8 bytes a word. An empty table gives
no rows. Columns besides the id and the text are left out, so their names never clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm import shared

BINS, BITS, WORDS = 256, 8, 5
#: Texts are hashed together up to so many bytes.
TOGETHER = 1 << 18
FULL = np.uint64(2**64 - 1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
TIMES = np.random.default_rng(5).integers(1, 2**63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(1)
def borrow_orders() -> np.ndarray:
    """For each bin, the order in which it looks for a full one."""
    return np.argsort(np.random.default_rng(11).random((BINS, BINS)), axis=1).astype(np.int64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        out = np.empty(max(n, TOGETHER * 2), np.uint64)
        out[0], done = 1, 1
        while done < len(out):
            k = min(done, len(out) - done)
            out[done : done + k] = out[:k] * np.uint64(pow(base, done, 2**64))
            done += k
        got = _powers[base] = out
    return got[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of each shingle, by a hash of word hashes. All texts at once."""
    buffer = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    space = IS_SPACE[buffer]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    # a word's hash: its bytes times powers of the base, by difference of sums from the left, moved to power 0
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buffer)), dtype=np.uint64)])
    word = mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(buffer))[starts])
    of = np.searchsorted(ends_of_texts, starts, "right")
    counts = np.bincount(of, minlength=len(texts))
    m = len(word) - words + 1
    inside = np.flatnonzero(of[: max(m, 0)] == of[words - 1 :]) if m > 0 else np.empty(0, np.int64)
    h = np.full(len(inside), words, np.uint64)
    for k in range(words):
        h += word[inside + k] * TIMES[k]
    short = np.flatnonzero(counts < words)
    first = (np.cumsum(counts) - counts)[short]
    g = counts[short].astype(np.uint64)
    for k in range(words - 1):
        has = counts[short] > k
        g[has] += word[first[has] + k] * TIMES[k]
    return np.concatenate([of[inside], short]), mixed(np.concatenate([h, g]))


def word_hashes(text: bytes) -> np.ndarray:
    """The hashes of the words of one text, as shingle_hashes() has them, block by block."""
    out, open_sum, open_size = [], 0, 0  # of a word that goes on in the next block
    for at in range(0, len(text), TOGETHER):
        buffer = LOWER[np.frombuffer(text, np.uint8, min(TOGETHER, len(text) - at), at)]
        space = IS_SPACE[buffer]
        before = np.concatenate([[open_size == 0], space[:-1]])
        starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & np.concatenate([[open_size > 0], ~space[:-1]]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buffer)), dtype=np.uint64)])
        if open_size:
            end = int(ends[0]) if len(ends) else len(buffer)
            open_sum, open_size, ends = (open_sum + int(sums[end]) * pow(BASE, open_size, 2**64)) % 2**64, open_size + end, ends[1:]
            if end == len(buffer):
                continue
            out.append(mixed(np.array([open_sum], np.uint64)))
            open_size = 0
        whole = starts[: len(ends)]
        out.append(mixed((sums[ends] - sums[whole]) * powers(INVERSE, len(buffer))[whole]))
        if len(starts) > len(ends):
            first = int(starts[-1])
            open_sum, open_size = (int(sums[-1]) - int(sums[first])) * pow(INVERSE, first, 2**64) % 2**64, len(buffer) - first
    if open_size:
        out.append(mixed(np.array([open_sum], np.uint64)))
    return np.concatenate([np.empty(0, np.uint64), *out])


def long_hashes(text: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """The shingle hashes of one text, in blocks."""
    word = word_hashes(text)
    if len(word) < words:
        yield shingle_hashes([b" ".join(text.split())], words)[1] if len(text) < TOGETHER else _shingle(word[None, :])
        return
    for at in range(0, len(word) - words + 1, TOGETHER):
        yield _shingle(np.lib.stride_tricks.sliding_window_view(word[at : at + TOGETHER + words - 1], words))


def _shingle(words: np.ndarray) -> np.ndarray:
    """The hashes of shingles, a row of word hashes each."""
    return mixed((words * TIMES[: words.shape[1]]).sum(axis=1, dtype=np.uint64) + np.uint64(words.shape[1]))


SHIFT = np.uint64(64 - (BINS - 1).bit_length())
REST = np.uint64((1 << int(SHIFT)) - 1)


def minima(texts: list[bytes]) -> np.ndarray:
    """A row of BINS minima per text, FULL where a bin is empty."""
    of, h = shingle_hashes(texts)
    least = np.full(len(texts) * BINS, FULL, np.uint64)
    np.minimum.at(least, of * BINS + (h >> SHIFT).astype(np.int64), h & REST)
    return least.reshape(len(texts), BINS)


def long_minima(text: bytes) -> np.ndarray:
    """minima() of one long text, block by block."""
    least = np.full(BINS, FULL, np.uint64)
    for h in long_hashes(text):
        np.minimum.at(least, (h >> SHIFT).astype(np.int64), h & REST)
    return least[None, :]


def densified(least: np.ndarray) -> np.ndarray:
    """A row of BINS bytes per row of minima."""
    full, orders = least != FULL, borrow_orders()
    row, col = np.nonzero(~full)
    out = least.copy()
    for step in range(BINS):
        if not len(row):
            break
        other = orders[col, step]
        found = full[row, other]
        out[row[found], col[found]] = least[row[found], other[found]]
        row, col = row[~found], col[~found]
    return (out & np.uint64(2**BITS - 1)).astype(np.uint8)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A row of BINS bytes per text."""
    return densified(minima(texts))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of fingerprints, corrected for chance agreement."""
    chance = 2.0**-BITS
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def parted(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, some MB at a time, long ones alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > TOGETHER:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def in_chunks(texts: list[bytes]) -> np.ndarray:
    """fingerprints() of many texts."""
    parts = [fingerprints(p) if len(p) > 1 or len(p[0]) <= TOGETHER else densified(long_minima(p[0])) for p in parted(texts)]
    return np.concatenate(parts) if parts else np.empty((0, BINS), np.uint8)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint (binary, BINS bytes) of each document. It needs no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = in_chunks([t.encode() for t in shared.texts_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=[id_col, "fingerprint"])

    shared.batched(docs.sparkSession)
    two = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint binary")


def with_next(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) sorted by doc_id within partitions that are ranges of doc_id, each followed by
    the first of the next range, marked ahead; the last range by the first of all. Ties go by a hash of the
    text; a null doc_id comes first. An id that fills several ranges is dealt out by that hash as well, so many
    texts of one id, or of none, are several tasks. No more than a document per range travels twice."""
    spark = docs.sparkSession
    place, mark = F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(place.alias("place"), mark.alias("mark"))
    found = ids.agg(F.percentile_approx("place", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("cuts")).first()["cuts"] or []
    values, times = np.unique(np.array(found[: n - 1], np.int64), return_counts=True)  # a number per partition
    # a cut is a place and a mark: rows up to a value's first cut come before it, and a value of m cuts takes m - 1 parts more
    cuts = [(int(v), int(m)) for v, t in zip(values, times, strict=True) for m in np.linspace(-(2.0**63), 2.0**63, t + 1)[:-1].tolist()]
    of_place, of_mark = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], float)

    def part_of(place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(of_place, place, "left"), np.searchsorted(of_place, place, "right")
        out = low.copy()
        for v in np.unique(place[high > low]):
            own = place == v
            a, b = np.searchsorted(of_place, [v, v], "left")[0], np.searchsorted(of_place, v, "right")
            out[own] = a + np.searchsorted(of_mark[a:b], mark[own].astype(float), "right")
        return out

    @F.pandas_udf("int")
    def range_of(place: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series(part_of(place.to_numpy(), mark.to_numpy()).astype(np.int32))

    key = F.struct("place", "mark")
    first_of = ids.groupBy(range_of("place", "mark").alias("range")).agg(F.min(key).alias("first")).collect()  # a row per partition
    firsts = sorted((r["range"], tuple(r["first"])) for r in first_of)
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def ranges_of(place: pd.Series, mark: pd.Series) -> pd.Series:
        own = part_of(place.to_numpy(), mark.to_numpy())
        return pd.Series([[int(p), before[i, m]] if (i, m) in before else [int(p)] for p, i, m in zip(own, place, mark, strict=True)])

    dealt = docs.select("doc_id", "text", F.posexplode(ranges_of(place, mark)).alias("ahead", "range"))
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("range")).select("doc_id", "text", (F.col("ahead") == 1).alias("ahead"))
    return dealt.sortWithinPartitions("ahead", place, mark, F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last quarter of code points is replaced by as many
    first ones of the next document. Columns: see the query op1."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def made(rows: list[tuple], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [following]
        quarter = [len(t) // 4 for t in texts]
        edited = [(t[: len(t) - q] + after[:q]).encode() for t, q, after in zip(texts, quarter, texts[1:], strict=False)]
        whole, changed = in_chunks([t.encode() for t in texts]), in_chunks(edited)
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array([r.tobytes().hex() for r in whole[:-1]]), pa.array([r.tobytes().hex() for r in changed]),
            pa.array(likeness(whole[:-1], changed)), pa.array(likeness(whole[:-1], whole[1:])),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        ended = False
        for batch in batches:
            for i, text, ahead in zip(batch.column(0).to_pylist(), shared.texts_of(batch), batch.column(2).to_pylist(), strict=True):
                if ended:
                    break
                if rows and (size >= 8 * TOGETHER or len(rows) >= shared.BATCH_ROWS or ahead):
                    yield made(rows, text)
                    rows, size = [], 0
                ended = ahead
                rows.append((i, text))
                size += len(text)

    shared.batched(docs.sparkSession)
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_next(two).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
