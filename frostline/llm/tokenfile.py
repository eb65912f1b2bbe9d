"""Files of token ids: one zstandard frame per document, a seek table with checksums at the end.

A file holds, in this order,
- a frame per document: its ids as little-endian unsigned 32-bit integers, compressed on their own;
- a skippable frame with the documents' ids, an Arrow stream with one column doc_id;
- a skippable frame with the seek table, in the public seekable format of zstandard: for each frame
  the compressed size, the size and the low 32 bits of the XXH64 of the content, then the number of
  frames, a descriptor byte and a magic number.
Any zstandard decoder reads the whole file; a reader that wants some documents reads the two tables
and decompresses those documents' frames alone, checking their checksums.

A file is written under a name of its own attempt, and the manifest names the attempts that count,
so tasks may be tried again or twice. The manifest, a row per file, is one file that the driver has written. Documents are dealt out by ranges of doc_id and sorted; ties
go by a hash of the text; a null doc_id comes first, a null text counts as empty. No document, no file. A very
long text is one frame, its ids 4 bytes each in memory; a frame holds up to 4 GB. Columns besides the id
and the text are left out, so their names never clash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import bpe, shared

#: Fixed values of the seekable format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEK_MAGIC, CHECKSUMS, FOOTER = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80, struct.Struct("<IBI")
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
LEVEL = 3
#: Ids that a task of read() takes at least where there are more files than cores; a larger file is read by a task of its own.
IDS_OF_A_TASK = 1 << 23
MANIFEST = [("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())]


class TokenFileWriter:
    def __init__(self, out: pa.NativeFile) -> None:
        self.out, self.entries, self.docs, self.n_tokens, self.packer = out, [], [], 0, zstandard.ZstdCompressor(LEVEL, write_checksum=False)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: 4 bytes each."""
        frame = self.packer.compress(ids)
        self.out.write(frame)
        self.entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.docs.append(doc_id)
        self.n_tokens += len(ids) // 4

    def close(self) -> None:
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([pa.array(self.docs, pa.int64())], ["doc_id"])
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        index = sink.getvalue().to_pybytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array(self.entries, ENTRY).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + FOOTER.size) + table + FOOTER.pack(len(self.entries), CHECKSUMS, SEEK_MAGIC))
        self.out.close()


class TokenFileReader:
    def __init__(self, file: pa.NativeFile) -> None:
        self.file, size = file, file.size()
        n, flags, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a token file: it has no seek table with checksums")
        at = size - FOOTER.size - n * ENTRY.itemsize
        self.entries = np.frombuffer(file.read_at(n * ENTRY.itemsize, at), ENTRY)
        self.begins = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        _, length = struct.unpack("<II", file.read_at(8, int(self.begins[-1])))
        self.docs = pa.ipc.open_stream(file.read_at(length, int(self.begins[-1]) + 8)).read_all().column("doc_id").to_pylist()
        sizes = self.entries["size"].astype(np.int64) // 4
        self.starts = np.cumsum(sizes) - sizes
        self.unpacker = zstandard.ZstdDecompressor()

    def ids(self, k: int) -> bytes:
        """The ids of the k-th document, its frame alone read and decompressed."""
        e = self.entries[k]
        ids = self.unpacker.decompress(self.file.read_at(int(e["packed"]), int(self.begins[k])), max_output_size=int(e["size"]))
        if len(ids) != e["size"] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != e["check"]:
            raise ValueError(f"frame {k} is damaged: its checksum differs")
        return ids

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Requested documents of this file with their ids."""
        wanted = set(doc_ids)
        for k, doc in enumerate(self.docs):
            if doc in wanted:
                yield doc, np.frombuffer(self.ids(k), "<u4")


def opened(path: str) -> TokenFileReader:
    fs, name = pa.fs.FileSystem.from_uri(path)
    return TokenFileReader(fs.open_input_file(name))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes `docs` with the end id after each, writes files into `folder` (a URI that all executors
    reach) and returns the manifest, written beside them: part, path, n_docs, n_tokens, first_doc, last_doc."""
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        table, part, writer = bpe.library_encoder(tokenizer), TaskContext.get().partitionId(), None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), shared.texts_of(batch), strict=True):
                if writer is None:
                    fs, root = pa.fs.FileSystem.from_uri(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.zst"
                    writer = TokenFileWriter(fs.open_output_stream(str(PurePosixPath(root) / name), compression=None))
                writer.add(doc, table.ids(text) + end)
        if writer is not None:
            writer.close()
            yield part, f"{folder}/{name}", len(writer.docs), writer.n_tokens, writer.docs[0], writer.docs[-1]

    spark = docs.sparkSession
    shared.batched(spark)
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = two.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = ranged.mapInArrow(lambda b: shared.in_batches(run(b), MANIFEST), "part long, path string, n_docs long, n_tokens long, first_doc long, last_doc long")
    listed = spark.createDataFrame(manifest.collect(), manifest.schema)  # a row per file
    return shared.written(listed.coalesce(1), "manifest", f"{folder}/manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    files = sorted(manifest.collect(), key=lambda r: r["part"])  # a row per file
    starts = np.cumsum([0, *(r["n_tokens"] for r in files)])
    listed = spark.createDataFrame([(r["path"], int(s)) for r, s in zip(files, starts, strict=False)], "path string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for f in batch.to_pylist():
                reader = opened(f["path"])
                for k, doc in enumerate(reader.docs):
                    ids = reader.ids(k)
                    yield doc, f["start"] + int(reader.starts[k]), len(ids) // 4, zlib.crc32(ids)

    out = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    tasks = min(len(files), max(spark.sparkContext.defaultParallelism, -(-int(starts[-1]) // IDS_OF_A_TASK)))
    return listed.repartition(max(1, tasks)).mapInArrow(lambda b: shared.in_batches(run(b), out), "doc_id long, start long, n_tokens long, ids_crc32 long")


def find(spark: SparkSession, manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Requested documents with their ids: doc_id, ids. `doc_ids` is a frame of one column, of any number of rows;
    null and repeated ones count once or not at all. Each id goes to the files whose range holds it, by
    search in the ranges, then file by file; of a file the tables and the wanted frames are read, and files whose
    range holds none of the ids aren't opened."""
    files = sorted((r for r in manifest.collect() if r["last_doc"] is not None), key=lambda r: r["part"])  # a row per file
    paths, lasts = [r["path"] for r in files], np.array([r["last_doc"] for r in files], np.int64)
    firsts = np.array([-(2**63) if r["first_doc"] is None else r["first_doc"] for r in files], np.int64)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(lasts, doc, "left"), np.searchsorted(firsts, doc, "right")  # files from low to high - 1
            n = np.maximum(high - low, 0)
            k = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(np.repeat(doc, n))], names=["file", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, reader, places = None, None, {}
        for batch in batches:
            for k, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    now, reader, places = k, opened(paths[k]), {}
                    for place, held in enumerate(reader.docs):
                        places.setdefault(held, []).append(place)
                for place in places.get(doc, ()):
                    yield doc, np.frombuffer(reader.ids(place), "<u4").tolist()

    shared.batched(spark)
    asked = doc_ids.toDF("doc_id").select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
    placed = asked.mapInArrow(locate, "file int, doc_id long").repartition("file").sortWithinPartitions("file", "doc_id")
    return placed.mapInArrow(lambda b: shared.in_batches(run(b), [("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))], 200), "doc_id long, ids array<long>")
